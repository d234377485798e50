from collections import Counter

from pyspark.sql import functions as F

from docframe.llm import sharding as S


def test_shards_slots_and_growth(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("text"), F.lit(1).alias("slots")).repartition(5)
    grown = [S.topology(n) for n in (8, 9, 10)]
    rows = S.shard(df, grown[0]).withColumn("nine", S.descend(grown[1], F.col("doc_id"))).withColumn("ten", S.descend(grown[2], F.col("doc_id"))).collect()
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(8)) and max(by.values()) < 1.35 * min(by.values())
    for k in by:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(by[k]))
    assert all(r.nine in (r.shard, 8) and r.ten in (r.nine, 9) for r in rows)
    assert 0.07 < sum(r.nine == 8 for r in rows) / len(rows) < 0.16
    again = {r.doc_id: r.shard for r in S.shard(df.repartition(2), grown[0]).collect()}
    assert again == {r.doc_id: r.shard for r in rows}


def test_weights_confine_movement(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"))
    before, after = S.topology(8), S.topology(8, weights={5: 3.0})
    rows = df.select(S.descend(before, F.col("doc_id")).alias("a"), S.descend(after, F.col("doc_id")).alias("b")).collect()
    assert all(r.a == r.b or r.b in (4, 5, 6, 7) for r in rows)  # into the region whose weight grew
    assert not any(r.a in (6, 7) and r.b in (6, 7) and r.a != r.b for r in rows)
    share = sum(r.b == 5 for r in rows) / len(rows)
    assert 0.25 < share < 0.35
    off = S.topology(8, weights={2: 0.0, 3: 0.0})
    assert {r[0] for r in df.select(S.descend(off, F.col("doc_id"))).distinct().collect()} == {0, 1, 4, 5, 6, 7}


def test_nulls_repeats_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 1), (None, "a", 2), (4, "b", 3), (4, "b", 3)], "doc_id long, text string, shard_no int")
    rows = S.shard(df, S.topology(8)).collect()
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({(r.shard, r.slot) for r in rows}) == 4
    assert S.shard(df.limit(0), S.topology(8)).count() == 0
    S.write(S.shard(df, S.topology(8)), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
