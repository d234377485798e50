"""Quality rules: per-document counts, and the frequency of lines across the documents of a host.

Lines are normalised (lower case, digits as 0, white space collapsed), hashed, and counted by host over distinct documents: copies
of one text count once. A line that more than ``max(min_docs, share * documents of the host)`` documents hold is
boilerplate there and is removed; a document that keeps too few words, or too small a share of them, is depleted and rejected. So is
one that fails the base rules (too few words, too many in repeated windows).

A null text has no word and is rejected; a null host is a host of its own. Whole texts are read. Repeated rows get
equal results and count once; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_RE, stored, text_of

SYMBOLS = "#*$%&|<>"
#: str.split() would also split at other white space, so it serves texts without any.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000]")
DIGITS = str.maketrans("123456789", "000000000")


def words_of(text: str) -> list[str]:
    return WORD_RE.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeated(words: list[str], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = ids[:n].copy()
    for k in range(1, width):  # numbers for windows of k + 1 words, dense again at each step
        codes = np.unique(codes * len(number) + ids[k : k + n], return_inverse=True)[1]
    twice = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normalised(line: str) -> str:
    return " ".join(line.lower().translate(DIGITS).split())


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes of distinct normalised lines, and words in each."""
    words = words_of(text)
    seen: set[str] = set()
    dup, lines = 0, Counter()
    for line in text.split("\n"):
        if n := len(words_of(line)):
            dup += line in seen
            seen.add(line)
            lines[xxhash.xxh64_intdigest(normalised(line).encode("utf-8", "replace")) - (1 << 63)] += n
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated(words), list(lines), list(lines.values())


def measured(docs: DataFrame, *, text: str, keep: list[str]) -> DataFrame:
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.simpleString()[len("struct<") : -1]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(0).to_pylist()
                rows = [measure(t) for t in texts]
                key = [xxhash.xxh128_digest(t.encode("utf-8", "replace")) for t in texts]
                own = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
                lists = [pa.array([r[5] for r in rows], pa.list_(pa.int64())), pa.array([r[6] for r in rows], pa.list_(pa.int64())), pa.array(key, pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *own, *lists], [*b.schema.names[1:], *names, "lines", "line_words", "text_key"])

    rows = docs.select(text_of(text).alias("__text"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, f"{schema}, {', '.join(f'{n} long' for n in names)}, lines array<long>, line_words array<long>, text_key binary")


def assess(docs: DataFrame, *, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.01, min_words: int = 10, max_repeat: float = 0.2, min_left: float = 0.3) -> DataFrame:
    """One row per document: ``id``, the counts, n_removed_words, base_failed and kept."""
    keyed = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("-")).alias("host"))
    rows = stored(measured(keyed, text="text", keep=["id", "host"]), "lines")
    distinct = rows.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))  # equal texts have equal lines
    size = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    common = stored(counts.join(size, "host").filter(F.col("n") > F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("docs"))).select("host", "line"), "common")
    texts = rows.groupBy("host", "text_key").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    flat = texts.select("host", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "text_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
    removed = flat.join(common, ["host", "line"]).groupBy("host", "text_key").agg(F.sum("w").alias("n_removed_words"))
    out = rows.drop("lines", "line_words").join(removed, ["host", "text_key"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))
    return out.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"), kept.alias("kept"))


def oracle() -> str:
    """DuckDB SQL for :func:`assess` with its defaults, for texts whose only white space is space, tab and line feed."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(source, '-') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, words[i:i+4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM real),
common AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM norm GROUP BY host, line) JOIN (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host) USING (host) WHERE n > greatest(20.0, 0.01 * docs)),
gone AS (SELECT doc_id, sum(n) AS n FROM norm JOIN common USING (host, line) GROUP BY doc_id),
o AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_removed_words AS l FROM o)
SELECT * EXCLUDE (l), NOT base_failed AND l >= 10 AND l >= 0.3 * n_words AS kept FROM f"""
