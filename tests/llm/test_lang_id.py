import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import lang_id as L
from docframe.llm._common import remainder

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{DIR}/documents.parquet"), where=remainder(F.col("id"), 4) != 2)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter(remainder(F.col("doc_id"), 4) == 2)
    found = L.identify(docs, model, keep=["lang"], spans=False)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_spans_of_mixed_text(spark, model):
    parts = {}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("n_chars between 300 and 900 and lang is not null").orderBy("doc_id").collect():
        parts.setdefault(r.lang, " ".join(r.text.split()[:40]))
    a, b = sorted(parts)[:2]
    df = spark.createDataFrame([(1, f"{parts[a]} {parts[b]}", "x")], "doc_id long, text string, lang_score string")
    r = L.identify(df, model).first()
    assert {s["lang"] for s in r.lang_spans} >= {a, b} and r.lang_spans[0]["first"] == 0
    assert all(x["end"] == y["first"] for x, y in zip(r.lang_spans, r.lang_spans[1:], strict=False)) and r.lang_spans[-1]["end"] == len(f"{parts[a]} {parts[b]}".split())


def test_undetermined_and_scripts(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "漢字 かな"), (5, "word " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].lang_spans == [] and got[5].lang_pred in model.langs
    assert L.script("a") == "latin" and L.script("я") == "cyrillic" and L.script("漢") == "han" and L.script("⿿") == "other"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = rng.normal(0, 3, (50, 3)).astype(np.float32)
    lens = np.array([5, 1, 7, 0, 6])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    ids = rng.integers(0, 50, lens.sum())
    got = L.viterbi(scores, ids, starts, lens, 2.0)
    import itertools

    for s, n in zip(starts, lens, strict=True):
        own = scores[ids[s : s + n]]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert abs(value(tuple(got[s : s + n])) - best) < 1e-4


def test_nothing_learned_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(none)
    assert L.identify(none, model).count() == 0
    assert [r.lang_pred for r in L.identify(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()] == ["und"]


def test_texts_in_no_learned_language_score_low(spark, model):
    import random

    rng = random.Random(5)
    plain = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("n_chars between 500 and 900 and lang is not null").orderBy("doc_id").limit(20).collect()]
    gibberish = " ".join("".join(rng.choice("bcdfghjkqvwxz") for _ in range(rng.randint(4, 9))) for _ in range(60))
    thai = "ภาษาไทย เป็น ภาษา ที่ มี ระดับ เสียง"
    rows = [(1, "漢字 かな"), (2, thai), (3, gibberish), (4, f"{thai * 9} {plain[0][:30]}")] + list(enumerate(plain, 100))
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(got[i].lang_pred, got[i].lang_score, got[i].lang_spans) for i in (1, 2)] == [("und", 0.0, [])] * 2
    assert got[3].lang_score < 0.5 and got[4].lang_score < 0.5
    assert all(got[i].lang_score > 0.5 for i in got if i >= 100)


def test_a_small_language_keeps_all_its_trigrams(spark):
    """Beside languages with over 300,000 trigrams, all more frequent."""
    import itertools

    big = " ".join("".join(chr(0xAC00 + 70 * x + i) for x in w) for w in itertools.permutations(range(60), 3) for i in [0, 1])
    rows = [(i, big, "big") for i in range(2)] + [(9, "uno dos tres", "small")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"^un", "uno", "no$", "^do", "dos", "os$", "^tr", "tre", "res", "es$"} <= set(model.grams) and len(model.grams) > 300_000
    assert L.identify(spark.createDataFrame([(1, "dos")], "doc_id long, text string"), model).first().lang_pred == "small"
