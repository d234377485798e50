"""The corpus pipeline stage by stage against brute force, on documents with planted cases."""

import gc
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from docframe.llm.simhash import hashes
from tests.llm.test_mixing import poisson, uniform
from tests.llm.test_packing import PATH, ids_of
from tests.llm.test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """What each stage was given and what it made."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = random.Random(3)
    some = [r for r in rows if r[1] and 40 < len(r[1].split()) < 200]
    rows += [(10_000 + i, some[i][1], some[i][2], "copies", some[i][4]) for i in range(8)]
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "x", 0), (20_002, "123 456", "en", "x", 7), (20_003, some[9][1] + " token = 'abcdef0123456789abcdef'", "en", None, 0), (20_003, some[9][1] + " token = 'abcdef0123456789abcdef'", "en", None, 0)]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        made = spark.read.schema(out.schema).parquet(path)
        steps.append((docs, made))
        docs = made
    whole = sorted(map(str, C.run(spark, folder).collect()))
    return steps, whole


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns_and_order_of_stages(ran):
    steps, whole = ran
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(made.columns == docs.columns for docs, made in steps[:-1])
    assert whole == sorted(map(str, steps[-1][1].collect()))


def test_language_drops_what_has_none(ran):
    (docs, made), *_ = ran[0]
    left = {r[0] for r in rows_of(docs)} - {r[0] for r in rows_of(made)}
    assert {20_000, 20_001, 20_002} <= left and len(left) < 0.05 * docs.count()


def test_secrets_are_replaced_and_texts_without_any_stay(ran):
    docs, made = ran[0][2]
    before, after = {d: t for d, t, _ in rows_of(docs)}, {d: t for d, t, _ in rows_of(made)}
    assert before.keys() == after.keys()
    assert "[secret]" in after.get(20_003, "[secret]") and not any("abcdef0123456789abcdef" in t for t in after.values())
    assert sum(before[d] != after[d] for d in before) < 0.3 * len(before)
    assert made.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_copies_by_weight(ran):
    docs, made = ran[0][3]
    size = Counter()
    for _, t, s in rows_of(docs):
        size[s] += len(t) + 1
    roots = sum(math.sqrt(v) for v in size.values())
    want = Counter()
    for d, _, s in rows_of(docs):
        rate = math.sqrt(size[s]) / roots * sum(size.values()) / size[s]
        n = max(1, math.ceil(rate / 8))
        want[d] = poisson(rate, uniform(17, d, 0)) if n == 1 else sum(poisson(rate / n, uniform(17, d, j)) for j in range(n))
    assert Counter(d for d, *_ in rows_of(made)) == +want


def test_sequences_hold_every_token_once(ran):
    docs, made = ran[0][4]
    rows = made.collect()
    texts = {d: t for d, t, _ in rows_of(docs)}
    order = list(texts)
    ids = dict(zip(order, ids_of([texts[d] for d in order]), strict=True))
    copies = Counter(d for d, *_ in rows_of(docs))
    tokens = Counter()
    for r in rows:
        assert list(r.ids) == (ids[r.doc_id] + [2])[r.start : r.start + r.length] and r.length <= 1024
        tokens[r.doc_id] += r.length
    assert tokens == Counter({d: n * (len(ids[d]) + 1) for d, n in copies.items()})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert PATH


def test_one_document_of_each_component_of_similar_texts_stays(ran):
    docs, made = ran[0][1]
    own = rows_of(docs)
    sets = [set(hashes(t or "", 5)) for _, t, _ in own]
    least = brute_components([(d, s) for (d, *_), s in zip(own, sets, strict=True)], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert sorted(r[0] for r in rows_of(made)) == sorted(set(least))


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """After a stored table and between stages the driver settles: what is not used is gone from its heap."""
    from docframe.llm import _common

    own = spark._jvm.java.lang.StringBuilder("left")
    weak = spark._jvm.java.lang.ref.WeakReference(own)
    del own
    gc.collect()
    time.sleep(1)
    _common.settle(spark)
    assert weak.get() is None
    calls = []
    monkeypatch.setattr(_common, "settle", calls.append)
    _common.stored(spark.range(3), "memory")
    C._begin(spark)
    assert calls == [spark, spark]
