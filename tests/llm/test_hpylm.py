import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from docframe.llm import hpylm as H
from docframe.llm._common import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return [*WORD.findall((t or "").translate(LOWER)), None]


def corpus(seed, n=220):
    rng = random.Random(seed)
    pairs = {w: [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa Über ÉCOLE 漢字".split()) for _ in range(3)] for w in "alpha beta gamma delta eps zeta eta theta iota kappa Über ÉCOLE 漢字".split()}
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "Only Unknown wordz"), (None, "alpha beta"), (3, "alpha BETA"), (3, "alpha BETA")]
    for i in range(n):
        w, out = rng.choice(list(pairs)), []
        for _ in range(rng.randint(1, 60)):
            out.append(w if rng.random() > 0.03 else f"rare{rng.randint(0, 500)}")
            w = rng.choice(pairs[w])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(out)))
    return rows


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    test = remainder(F.col("doc_id"), 7) == 2
    model = H.train(df.filter(~test))
    return rows, H.score(df, model, held_out=test).collect()


def test_base_scores_match_brute_force(scored):
    rows, found = scored
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == want


def test_model_is_better_than_the_base_on_held_out_texts(scored):
    _, found = scored
    test = [r for r in found if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) * 0.8
    assert all(r.score < 0 and r.perplexity > 1 for r in found)


def test_probabilities_sum_to_one(spark):
    """Over all words and the unknown symbol, in a context that was seen and in one that was not."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(9, 60))]
    model = H.train(spark.createDataFrame(rows, "doc_id long, text string"))
    buckets = [(H.Bucket(r.asDict()), r.samples) for r in model.state.collect()]
    total = model.totals[-1]
    k = 3 * (len(model.totals) - 1)
    for ctx2 in (int(buckets[0][0].ctx2[0]), 77):
        ctx1, whole = ctx2 >> H.BITS2, 0.0
        for own, samples in buckets:
            t0, t1, t2 = (H.load(x, "<u4").astype(int) for x in samples[k : k + 3])
            p0, p1 = own.chances(total, np.bincount(own.up1, t1, len(own.words)), t0, np.bincount(own.up2, t2, len(own.key1)), t1)
            one = total.chance(1, ctx1, 0, 0, p0)
            at = own.ctx1 == ctx1
            one[own.up1[at]] = p1[at]
            two = total.chance(2, ctx2, 0, 0, one)
            at = own.ctx2 == ctx2
            w = own.up1[own.up2[at]]
            two[w] = total.chance(2, ctx2, own.c2[at], t2[at], one[w])
            whole += two.sum()
        whole += total.chance(2, ctx2, 0, 0, total.chance(1, ctx1, 0, 0, total.chance(0, 0, 0, 0, total.unknown)))
        assert abs(whole - 1) < 1e-9


def test_sweeps_keep_customers(spark):
    rng = np.random.default_rng(3)
    target = rng.integers(1, 40, 300)
    t = H.first_tables(target, np.full(300, 2.0), 0.7, rng)
    assert (t.customers == target).all()
    other = np.maximum(1, target + rng.integers(-5, 6, 300))
    s = t.sweep(other, np.full(300, 2.0), 0.7, 3, rng)
    assert (s.customers == other).all() and (s.count >= 1).all() and (s.count <= other).all() and (np.diff(s.owner) >= 0).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = H.train(none)
    assert H.score(none, model).count() == 0
    r = H.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_a_sweep_reseats_in_proportion_to_the_customers():
    """From one table, tables of large entries come as near to their expected number in a sweep as those of small ones."""
    rng = np.random.default_rng(8)
    target = np.array([2, 10, 3000, 3000])
    start = H.Tables(np.arange(4), target.copy(), 4)
    got = start.sweep(target, np.full(4, 200.0), 0.5, 3, rng)
    assert (got.customers == target).all() and (np.diff(got.owner) >= 0).all()
    assert (got.count[2:] > 50).all()  # three reseatings leave at most 4


def test_numbers_of_tables_follow_the_seatings():
    """Drawn counts have the mean that customers one by one lead to, by exact numbers and beyond them; many customers take no step each."""
    rng = np.random.default_rng(5)
    for d, c, fresh in ((0.5, 3, 0.7), (0.8, 40, 2.0), (0.3, H.EXACT, 30.0), (0.95, H.EXACT + 200, 3.0), (0.6, H.EXACT + 200, 900.0), (0.6, H.EXACT + 1, 1e6)):
        logs = [0.0]  # of the numbers of seatings, by tables
        for n in range(1, c):
            stay = np.array([*(x + math.log(n - d * (t + 1)) for t, x in enumerate(logs)), -np.inf])
            logs = np.logaddexp(stay, np.array([-np.inf, *logs]))
        t = np.arange(1, c + 1)
        p = np.exp((w := np.array(logs) + t * math.log(fresh)) - w.max())
        mean = (p * t).sum() / p.sum()
        spread = math.sqrt((p * (t - mean) ** 2).sum() / p.sum())
        got = H.draw_tables(np.full(800, c), np.full(800, fresh), d, rng)
        assert abs(got.mean() - mean) < 5 * spread / math.sqrt(800) + 0.01 * spread
    many = np.array([1, 2_000_000, 50_000_000])
    start = time.time()
    got = H.Tables(np.arange(3), many, 3).sweep(many, np.full(3, 40.0), 0.7, 3, rng)
    assert (got.customers == many).all() and got.count[0] == 1 and (got.count[1:] > 40).all() and time.time() - start < 20


def test_contexts_are_words_not_classes(spark):
    """One word always follows the same two words before, whose nearer one is the same everywhere; no other context says so."""
    rows = [(3 * i + k, f"x{i} m b{i}") for i in range(500) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = H.score(df, H.train(df)).collect()
    assert len(found) == len(rows)
    assert sum(r.score for r in found) / len(rows) > -3.6  # 2.7 of it for x


@pytest.mark.parametrize("hot", [100, 0.05])
def test_scores_follow_from_the_seating_by_words(spark, monkeypatch, hot):
    """Every count of the texts is seated in its own context, customers are the tables below, and scores are what dictionaries of these say."""
    monkeypatch.setattr(H, "HOT", hot)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(6, 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    test = remainder(F.col("doc_id"), 7) == 2
    model = H.train(df.filter(~test))
    assert (len(model.hot) > 3) == (hot < 1)

    def tokens(t):
        before = [int(H.START)] * 2
        for w in H.Words()([(t or "").encode()])[0].tolist():
            yield w, before[0], before[1]  # the word, the one before, the one before that
            before = [w, before[0]]

    want = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    count, samples = Counter(), [[Counter(), Counter(), Counter()] for _ in model.found]
    for r in model.state.collect():
        b = H.Bucket(r.asDict())
        word = b.words[b.up1].tolist()
        keys = [b.words.tolist(), list(zip(word, b.ctx1, strict=True)), [(word[i], c >> H.BITS2, c & (1 << H.BITS2) - 1) for i, c in zip(b.up2.tolist(), b.ctx2, strict=True)]]
        assert not set(keys[0]) & {w for w, *_ in count}
        count.update(dict(zip(keys[2], b.c2.tolist(), strict=True)))
        for k, s in enumerate(samples):
            for level in range(3):
                s[level].update(dict(zip(keys[level], H.load(r.samples[3 * k + level], "<u4").tolist(), strict=True)))
    assert count == want
    chances = []
    for total, tables in zip(model.found, samples, strict=True):
        customers = [Counter(), Counter(), count]
        for (w, a, _), t in tables[2].items():
            customers[1][w, a] += t
        for (w, _), t in tables[1].items():
            customers[0][w] += t
        assert (sum(customers[0].values()), sum(tables[0].values())) == (total.customers[0][0], total.tables[0][0])
        rest = []
        for level, context in enumerate((lambda k: 0, lambda k: k[1], lambda k: k[1:])):
            rest.append([Counter(), Counter()])
            for to, of in zip(rest[level], (customers[level], tables[level]), strict=True):
                for k, n in of.items():
                    to[context(k)] += n
                assert all(0 < tables[level][k] <= n for k, n in customers[level].items())
        known = {w for w, *_ in want}

        def chance(w, a, b, total=total, tables=tables, customers=customers, rest=rest, known=known):
            p = total.known() if w in known else total.unknown
            for level, key, context in ((0, w, 0), (1, (w, a), a), (2, (w, a, b), (a, b))):
                p = H.chance(total.discount[level], total.strength[level], customers[level][key], tables[level][key], rest[level][0][context], rest[level][1][context], p)
            return p

        chances.append(chance)
    texts = dict(rows)
    for r in H.score(df, model, held_out=test).collect():
        score = sum(math.log10(sum(c(*x) for c in chances) / len(chances)) for x in tokens(texts[r.doc_id]))
        assert abs(r.score - score) < 1e-4 * max(1, abs(score))


def test_common_words_go_by_place():
    rng = np.random.default_rng(2)
    common = rng.permutation(rng.integers(1, 2**63, 20_000, np.uint64))
    words = np.unique(np.concatenate([common[:4000], rng.integers(1, 2**63, 500, np.uint64)]))
    by, named = H.common_first(words, common)
    cells = H.word_cells(words[by], named)
    assert (common[named] == words[by][: len(named)]).all() and len(named) == 4000
    assert (H.load_words(cells, common) == words[by]).all() and sorted(by.tolist()) == list(range(len(words)))
    assert sum(map(len, cells)) < len(H.pack(words, "<u8", True)) / 3


def test_turns_have_the_same_scores(spark):
    """Postings of half of the texts at a time, with the same scores."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(7, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = H.train(df.filter("doc_id % 3 > 0"))
    one, three = (sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in H.score(df, model, turns=n).collect()) for n in (1, 3))
    assert one == three and len(one) == len(rows)


def test_a_bucket_tells_each_part_once(monkeypatch):
    """What a bucket tells the parts, and these the blocks, takes no row for each bucket, block and part."""
    monkeypatch.setattr(H, "TOKENS", 60)
    monkeypatch.setattr(H, "PIECE", 60)
    texts = [t for _, t in corpus(11, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array([(t or "").encode() for t in texts], pa.binary())], ["id", "held", "body"])
    none = np.zeros(0, np.uint64)
    rows = pa.Table.from_batches(list(H.post([batch], 2, {}, none, none, 0, 1)))
    rows = rows.filter(pc.equal(rows["kind"], H.POST))
    found, parts = [H.Totals([np.zeros(1), none], [np.zeros(1), none], [0.5] * 3, [1.0] * 3, 0, 0, 0.5)], 3
    told = pa.concat_tables([H.score_bucket(rows.filter(pc.equal(rows["bucket"], b)), found, parts, none) for b in (0, 1)])
    blocks = len(set(rows["block"].to_pylist()))
    assert blocks > 20 and len(told) == 2 * parts and set(told["kind"].to_pylist()) == {H.AWAY}
    sums = pa.concat_tables([H.score_part(told.filter(pc.equal(told["part"], p)), found) for p in range(parts)])
    assert blocks <= len(sums) <= parts * blocks and set(sums["kind"].to_pylist()) == {H.SUMS}
    n = sum(len(words(t)) for t in texts)
    assert abs(sum(H.load(c[3], "<f4").sum() for c in sums["cells"].to_pylist()) / n - math.log10(0.5)) < 1e-3


def test_cells_have_the_places_that_numbers_need():
    rng = np.random.default_rng(12)
    for top in (0, 200, 60_000, 1 << 20, (1 << 32) - 1):
        x = np.append(rng.integers(0, top + 1, 5000), top)
        assert (H.load(H.pack(x, "<u4"), "<u4") == x).all() and (H.load(H.pack(x, "<u8", True), "<u8", True) == x).all()
        order, head, n = H.by_three(x % 9, x % 7, x % 5, 9)
        assert [tuple(x) for x in np.stack([x % 9, x % 7, x % 5], 1)[order].tolist()] == sorted(zip((x % 9).tolist(), (x % 7).tolist(), (x % 5).tolist(), strict=True))
        assert n.sum() == len(x) and (order[1:] > order[:-1])[np.setdiff1d(np.arange(1, len(x)), head) - 1].all()
    x = rng.standard_normal(100)
    assert (H.load(H.pack(x, "<f8"), "<f8") == x).all() and not len(H.load(H.pack(np.zeros(0), "<u4"), "<u4"))
    big = rng.integers(0, 1 << 62, 300)  # no room for places
    assert (H.ordering(big, 1 << 62) == np.argsort(big, kind="stable")).all()
