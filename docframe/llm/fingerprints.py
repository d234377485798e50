"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences.

A text is cut, without loss, into sections (up to 16 lines, or up to a blank line), these into paragraphs (lines), and these into
leaves (sentences, of at most 160 code points). A leaf is a digest and its length; a paragraph's digest is that of its
leaves, a section's that of its paragraphs, and the root that of the sections, each made from digests of 128 bits: equal texts have equal
roots, and different ones have not, short of a collision of MD5. Where two trees differ, only differing sections, and in
them only differing paragraphs, need a look. All of it is DataFrame functions.

The tree is written as one string: ``root|section(paragraph[leaf leaf]paragraph[leaf])|section(...)``. It shows 128 bits of the root and the first
64 of any other digest; what is above was made from the whole ones.

Null and empty texts have a root and no section. Each row is treated on its own; repeated rows get equal fingerprints; extra columns
pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import text_of

SECTION = r"(?:[^\n]+\n){0,15}[^\n]*\n*"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
LEAF = r"[^\n.!?]{1,160}[.!?\n]*\x20*|[.!?\n]+\x20*"
#: Hexadecimal digits that the string shows of a leaf's, a paragraph's and a section's digest, of 32.
SHORT = 16
LEAF_TOKEN = rf"[0-9a-f]{{{SHORT}}}:[0-9]+"


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _digest(joined: Column) -> Column:
    return F.md5(joined.cast("binary"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _node(parts: Column, left: str, right: str) -> Column:
    """(full, shown) of the node above ``parts``, which have both."""
    whole = _digest(F.array_join(F.transform(parts, lambda x: x["full"]), ""))
    shown = F.array_join(F.transform(parts, lambda x: x["shown"]), " " if left == "[" else "")
    return _let(whole, lambda d: F.struct(d.alias("full"), F.concat(F.substring(d, 1, SHORT), F.lit(left), shown, F.lit(right)).alias("shown")))


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string; of null as of the empty text."""

    def leaf(x: Column) -> Column:
        size = F.concat(F.lit(":"), F.length(x).cast("string"))
        return _let(_digest(x), lambda d: F.struct(F.concat(d, size).alias("full"), F.concat(F.substring(d, 1, SHORT), size).alias("shown")))

    paragraph = lambda p: _let(F.transform(_cut(p, LEAF), leaf), lambda own: _node(own, "[", "]"))
    section = lambda s: _let(F.transform(_cut(s, PARAGRAPH), paragraph), lambda own: _node(own, "(", ")"))
    sections = F.transform(F.filter(_cut(F.coalesce(text, F.lit("")), SECTION), lambda s: s != ""), section)
    root = lambda own: F.substring(F.sha2(F.array_join(F.transform(own, lambda x: x["full"]), "").cast("binary"), 256), 1, 32)
    return _let(sections, lambda own: F.concat(root(own), F.lit("|"), F.array_join(F.transform(own, lambda x: x["shown"]), "|")))


def leaves(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(LEAF_TOKEN), 0))


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, x: acc + F.substring_index(x, ":", -1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Share of code points in leaves that both trees have, 1 if neither has any."""
    total = _weight(leaves(a)) + _weight(leaves(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _weight(F.array_intersect(leaves(a), leaves(b))) / total)


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: places, from 0, of paragraphs of ``a`` in sections that ``b`` lacks and that ``b`` lacks too.

    Nothing is looked at if the roots agree.
    """
    sections = lambda fp: F.filter(F.split(F.substring(fp, 34, F.length(fp) - 33), r"\|"), lambda s: s != "")
    paragraphs = lambda s: F.regexp_extract_all(s, F.lit(rf"([0-9a-f]{{{SHORT}}})\["), 1)
    theirs = F.transform(sections(b), lambda s: F.substring(s, 1, SHORT))
    others = F.flatten(F.transform(sections(b), paragraphs))
    marked = F.transform(
        sections(a),
        lambda s, i: F.when(F.array_contains(theirs, F.substring(s, 1, SHORT)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.filter(F.transform(paragraphs(s), lambda p, j: F.when(~F.array_contains(others, p), F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))), lambda x: x.isNotNull())
        ),
    )
    same = F.substring(a, 1, 32) == F.substring(b, 1, 32)
    return F.when(same, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(marked))


def fingerprinted(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns and ``name``."""
    return docs.withColumn(name, fingerprint(text_of(text)))


def following(docs: DataFrame, *, id: str, carry: list[str], prefix: str = "next_", per_bucket: int = 4096, most: int = 4096) -> DataFrame:
    """Adds the columns ``carry`` of the next row in descending order of ``id`` as ``next_*``; after the last row comes the first.

    Ids are dealt into ranges, whose first ids are exact and at most ``most``; the first rows of a range are also guests
    at the end of the range before, so every range finds its rows' next ones alone. Rows without an id come last; rows of
    one id follow each other by the hash of the carried columns.
    """
    key = F.col(f"`{id}`")
    ids = docs.select(key.alias("i")).filter("i is not null")
    n = ids.count()
    parts = max(1, min(most, math.ceil(n / per_bucket)))
    ranges = ids.repartitionByRange(parts, F.desc("i")).groupBy(F.spark_partition_id().alias("p")).agg(F.max("i").alias("i"))
    bounds = sorted((r.i for r in ranges.collect()), reverse=True)  # one value per range
    last = max(0, len(bounds) - 1)
    kind = docs.select(key).schema[0].dataType
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    nested = F.array(*[F.array(*[F.lit(x).cast(kind) for x in g]) for g in groups]) if groups else None
    if nested is None:
        bucket = F.lit(0)
    else:  # how many ranges begin at or before the id, less one: first among groups of ranges, then in the group
        outer = F.greatest(F.size(F.filter(nested, lambda g: F.get(g, F.lit(0)) >= key)) - 1, F.lit(0))
        inner = F.size(F.filter(F.get(nested, outer), lambda x: x >= key)) - 1
        bucket = F.when(key.isNull(), F.lit(last)).otherwise(outer * step + inner).cast("int")
    rows = docs.withColumn("__b", bucket)
    starts = F.col("__b").isNotNull() if nested is None else F.coalesce(F.get(F.get(nested, (F.col("__b") / step).cast("int")), F.col("__b") % step) == key, F.lit(n == 0))
    before = F.when(F.col("__b") == 0, F.lit(last)).otherwise(F.col("__b") - 1)
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("guest"))
    rows = rows.withColumn("__x", F.explode(F.when(starts, F.array(own, F.struct(before.cast("int").alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    rows = rows.withColumn("__b", F.col("__x.b")).withColumn("__guest", F.col("__x.guest")).drop("__x")
    order = Window.partitionBy("__b").orderBy("__guest", key.desc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in carry]))
    for c in carry:
        rows = rows.withColumn(f"{prefix}{c}", F.lead(F.col(f"`{c}`")).over(order))
    return rows.filter("not __guest").drop("__b", "__guest")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last third replaced by as many code points from the beginning of ``other``."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def oracle() -> str:
    """DuckDB SQL for the query over distinct ids."""
    tree = lambda t: f"""list_filter(regexp_extract_all({t}, '{SECTION}'), lambda s: s <> '')"""
    each = lambda x, f: f"list_transform({x}, lambda v: v.{f})"
    node = lambda parts, left, right, sep: f"list_transform({parts}, lambda own: {{'d': md5(array_to_string({each('own', 'd')}, '')), 's': '{left}' || array_to_string({each('own', 's')}, '{sep}') || '{right}'}})"
    shown = lambda nodes: f"list_transform({nodes}, lambda q: {{'d': q.d, 's': substr(q.d, 1, {SHORT}) || q.s}})"
    leaf = f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: {{'d': md5(x) || ':' || length(x), 's': substr(md5(x), 1, {SHORT}) || ':' || length(x)}})"
    para = shown(node(f"list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: {leaf})", "[", "]", " "))
    nodes = lambda t: shown(node(f"list_transform({tree(t)}, lambda s: {para})", "(", ")", ""))
    whole = lambda n: f"substr(sha256(array_to_string({each(n, 'd')}, '')), 1, 32) || '|' || array_to_string({each(n, 's')}, '|')"
    leaf_set = lambda f: f"list_distinct(regexp_extract_all({f}, '{LEAF_TOKEN}'))"
    weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: split_part(y, ':', 2)::BIGINT)), 0)"
    like = lambda a, b: f"CASE WHEN {weight(a)} + {weight(b)} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {weight(f'list_intersect({a}, {b})')} / ({weight(a)} + {weight(b)}) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited FROM n),
b AS (SELECT *, {nodes("text")} AS own, {nodes("edited")} AS other, {nodes("next_text")} AS next FROM e),
f AS (SELECT *, {whole("own")} AS fingerprint, {whole("other")} AS edited_fingerprint, {whole("next")} AS next_fingerprint FROM b),
l AS (SELECT *, {leaf_set("substr(fingerprint, 34)")} AS la, {leaf_set("substr(edited_fingerprint, 34)")} AS le, {leaf_set("substr(next_fingerprint, 34)")} AS ln FROM f)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {like("la", "le")} AS near_edited, {like("la", "ln")} AS near_next FROM l"""
