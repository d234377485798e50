import hashlib
import math
from collections import Counter

from docframe.llm import mixing as M


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, draw):
    p = c = math.exp(-rate)
    k = 0
    while draw >= c and k < 64:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_and_places_match_brute_force(spark):
    rows = [(i, "abc" * (i % 7), ["a", "b", None][min(2, i % 9)]) for i in range(900)] + [(5000, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = M.mix(df, buckets=16).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "") + 1
    roots = sum(math.sqrt(v) for v in size.values())
    rates = {s: math.sqrt(v) / roots * sum(size.values()) / v for s, v in size.items()}
    assert rates["c"] > M.STEP  # drawn in pieces
    n = math.ceil(rates["c"] / M.STEP)
    want = Counter({i: sum(poisson(rates[s] / n, uniform(17, i, j)) for j in range(n)) if s == "c" else poisson(rates[s], uniform(17, i, 0)) for i, _, s in rows})
    assert Counter(r.doc_id for r in got) == +want
    assert sorted((r.doc_id, r.copy) for r in got) == sorted((i, k) for i, n in want.items() for k in range(n))
    order = sorted(got, key=lambda r: uniform(17, "shuffle", r.doc_id, r.copy))
    assert [r.position for r in order] == list(range(len(got)))
    spread = M.shuffled(df, buckets=16)
    assert Counter(r.doc_id for r in spread.collect()) == +want and spread.columns == df.columns and "Exchange hashpartitioning(__bucket" in spread._jdf.queryExecution().toString()


def test_weights_and_high_rates(spark):
    rows = [(i, "x", "rare") for i in range(40)] + [(100 + i, "x", "many") for i in range(4000)] + [(9000, "x", "unlisted")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.source for r in M.mix(df, weights={"rare": 0.5, "many": 0.5}).collect())
    assert abs(got["rare"] / sum(got.values()) - 0.5) < 0.06 and got["unlisted"] == 0 and abs(sum(got.values()) / 4041 - 1) < 0.1


def test_repeats_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "s", 5), (1, "a", "s", 5), (2, None, "s", 6)], "doc_id long, text string, source string, rate int")
    assert M.shuffled(df).columns == df.columns and M.mix(df).columns == ["doc_id", "text", "source", "rate", "copy", "position"]
    got = M.mix(df, epochs=3.0).collect()
    assert sorted(r.position for r in got) == list(range(len(got))) and len({r.copy for r in got if r.doc_id == 1}) * 2 == sum(r.doc_id == 1 for r in got)
    assert M.mix(df.limit(0)).count() == 0
