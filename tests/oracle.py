"""Runs registered queries beside their DuckDB SQL: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    cols = [c[0] for c in found.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def value(v):
        if isinstance(v, dict):
            return tuple(value(x) for x in v.values())
        return plain(v) if not isinstance(v, list) else tuple(value(x) for x in v)

    return [cols[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in found.fetchall()), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """The empty string, or what differs."""
    a_names, a = spark_rows(query(spark, sf_dir))
    b_names, b = duck_rows(sql, sf_dir)
    if a_names != b_names:
        return f"{name}: columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{name}: {len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{name}: {len(bad)} rows differ, such as {str(bad[0][0])[:700]} and {str(bad[0][1])[:700]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for q in sys.argv[2:] or queries:
        start = time.time()
        try:
            said = compare(session, q, queries[q], sqls[q], sf) if q in sqls else f"{queries[q](session, sf).count()} rows, no SQL"
        except Exception as e:
            said = f"{q}: {type(e).__name__} {str(e)[:1500]}"
        print(f"{q} {time.time() - start:.1f}s", said or "equal", flush=True)
