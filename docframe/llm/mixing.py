"""Mixing sources to target weights by Poisson replication.

A source of size S has the mean repetition rate weight * total / S. Each document draws its number of copies by inverting the
Poisson distribution at a uniform number hashed from seed and id, is exploded by that number, and all copies are shuffled
globally by another hash. A rate above ``STEP`` is drawn as the sum of independent Poisson numbers of at most that
mean, so no rate is capped and no table grows with it. Everything is DataFrame functions.

A null source is a source of its own. A null text has size 1, like an empty one: size is code points plus one. Rows that
share an id draw the same number and follow each other in the shuffle. Extra columns pass through. An
empty table gives an empty one. A source without a weight has weight 0 if weights are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import stored, text_of

#: Largest mean that is inverted at once, and the terms of its distribution: beyond them less than 2**-60 is left.
STEP, TERMS = 8, 64
#: Most sources whose rates are broadcast; with more, documents and rates are shuffled by source.
BROADCAST = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts as text."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def rates(docs: DataFrame, *, source: str = "source", text: str = "text", weights: dict[str | None, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate): one row per source. Without weights a source's is its size to the power ``alpha``, normed.

    The mixture's expected size is ``epochs`` times that of ``docs``.
    """
    sized = docs.select(F.col(f"`{source}`").alias("source"), (F.length(text_of(text)) + 1).cast("long").alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is not None:
        given = F.lit(0.0)
        for name, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(given)
        sized = sized.withColumn("w", given)
    else:
        sized = sized.withColumn("w", F.sqrt(F.col("size").cast("double")) if alpha == 0.5 else F.pow(F.col("size").cast("double"), F.lit(alpha)))
    # two numbers reach the driver
    sized = stored(sized, "sizes")
    whole = sized.agg(F.sum("size").alias("total"), F.sum("w").alias("ws")).first()
    rate = F.lit(epochs) * F.col("w") / F.lit(float(whole.ws or 1)) * F.lit(whole.total or 0) / F.col("size")
    return sized.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson(rate: Column, draw: Column) -> Column:
    """The least k whose cumulative probability exceeds ``draw``, for a rate up to ``STEP``."""
    terms = F.sequence(F.lit(1), F.lit(TERMS))
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.when(draw >= first, 1).otherwise(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (acc["k"] + F.when(draw >= c, 1).otherwise(0)).alias("k"))

    return F.aggregate(terms, start, step, lambda acc: acc["k"])


def copies(docs: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str | None, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """The columns of ``docs``, __rate, __copy (from 0), and the shuffle's __key in [0, 1) and __bucket."""
    own = rates(docs, source=source, text=text, weights=weights, alpha=alpha, epochs=epochs).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    if own.count() <= BROADCAST:
        own = F.broadcast(own)
    rows = docs.join(own, docs[f"`{source}`"].eqNullSafe(own["__source"]), "left").drop("__source")
    rows = rows.withColumn("__u", uniform(F.lit(seed), F.col(f"`{id}`"), F.lit(0)))
    pieces = F.greatest(F.ceil(F.col("__rate") / STEP), F.lit(1)).cast("int")
    small = poisson(F.col("__rate"), F.col("__u"))
    large = F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0), lambda acc, j: acc + poisson(F.col("__rate") / pieces, uniform(F.lit(seed), F.col(f"`{id}`"), j)))
    rows = rows.withColumn("__n", F.when(F.col("__rate") <= STEP, small).otherwise(large)).filter("__n > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    rows = rows.withColumn("__key", uniform(F.lit(seed), F.lit("shuffle"), F.col(f"`{id}`"), F.col("__copy")))
    return rows.withColumn("__bucket", F.floor(F.col("__key") * buckets).cast("int")).drop("__u", "__n")


def shuffled(docs: DataFrame, *, id: str = "doc_id", source: str = "source", buckets: int = 1024, **options) -> DataFrame:
    """The columns of ``docs``: every copy, in a global shuffle. A task, and its file, has whole buckets of the order of :func:`mix`."""
    rows = copies(docs, id=id, source=source, buckets=buckets, **options)
    ties = [F.col(f"`{c}`") for c in (id, "__copy", source)]
    return rows.repartition("__bucket").sortWithinPartitions("__bucket", "__key", *ties).select(*[f"`{c}`" for c in docs.columns])


def mix(docs: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", buckets: int = 1024, **options) -> DataFrame:
    """The columns of ``docs``, and rate, copy (from 0) and position: a gapless place from 0 in the global shuffle;
    they replace columns of these names.

    ``buckets`` of the shuffle's hash are ordered each on its own; their counts give the offsets. For ``options`` see :func:`copies`.
    """
    rows = copies(docs, id=id, source=source, text=text, buckets=buckets, **options)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    offsets = counts.select("__bucket", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__from"))
    ties = [F.col(f"`{c}`") for c in (id, "__copy", source)]
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", *ties, F.xxhash64(text_of(text)))) - 1)
    out = ranked.join(F.broadcast(offsets), "__bucket")  # at most ``buckets`` rows
    own = [f"`{c}`" for c in docs.columns if c not in ("rate", "copy", "position")]
    return out.select(*own, F.col("__rate").alias("rate"), F.col("__copy").alias("copy"), (F.col("__r") + F.col("__from")).cast("long").alias("position"))


def oracle(seed: int = 17) -> str:
    """DuckDB SQL for :func:`mix` with ``alpha`` 0.5 over distinct ids, for rates up to ``STEP``."""
    draw = lambda *parts: "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
    return f"""
WITH RECURSIVE sized AS (SELECT source, sum(length(coalesce(text, '')) + 1)::BIGINT AS size FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM sized) * (SELECT sum(size)::DOUBLE FROM sized) / size::DOUBLE AS rate FROM sized),
cdf(source, rate, i, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, i + 1, p * rate / (i + 1), c + p * rate / (i + 1) FROM cdf WHERE i < {TERMS}),
drawn AS (SELECT d.doc_id, d.source, d.text, r.rate, {draw(f"'{seed}'", "d.doc_id::VARCHAR", "'0'")} AS u FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT d.doc_id, d.source, d.text, d.rate, (SELECT count(*) FROM cdf x WHERE x.source IS NOT DISTINCT FROM d.source AND d.u >= x.c) AS n FROM drawn d),
copies AS (SELECT doc_id, source, text, rate, unnest(range(n))::INTEGER AS copy FROM counted)
SELECT doc_id, source, copy, round(rate, 6) AS rate, md5(coalesce(text, '')) AS text_md5,
  row_number() OVER (ORDER BY {draw(f"'{seed}'", "'shuffle'", "doc_id::VARCHAR", "copy::VARCHAR")}, doc_id, copy) - 1 AS position
FROM copies"""
