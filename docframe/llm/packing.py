"""Best-fit packing of tokenised documents into sequences.

A document is its token ids and one end id. Longer ones than a sequence are cut into full pieces, of which the first may be
shorter. Full pieces are sequences by themselves; the others are packed by bulk-synchronous best-fit decreasing:

* documents and gaps are ranges of equal size, sorted: a superstep takes the longest class of documents left,
* a successor sweep matches it with the smallest gaps that hold it, gap class by gap class, and opens sequences for the rest,
* conflicts, many documents for one class of gaps, are resolved by rank: the i-th document of the class takes the i-th place,
* the gaps are updated and the next superstep begins.

Sizes are whole numbers up to the sequence's length, so the sweep runs over at most that many classes with counts: its state is
as small at 100 TB as on a laptop, and the supersteps are as many as there are lengths. What grows with the data is
distributed: tokenising, the ranks of documents within their class, and the lookup of a rank's place. A task that tokenises
numbers its own pieces of each length; with the counts of the tasks before it, that is the rank. So ids are not shuffled
as long as these counts, one per task and length, are few enough to be broadcast.

Null and empty texts are one piece with the end id only. Repeated rows are packed each on their own. Extra columns are ignored.
An empty table gives an empty one. Ties within a length go by task and place in it.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import sliced, stored, text_of, tidy

#: The pattern by which byte-level vocabularies of this family split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Counts of a task and length, and places, that are broadcast; beyond, the tables are joined by sort.
COUNTS, PLACES = 500_000, 50_000


class Tokens(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of chunks that the splitting pattern never crosses.

    The merges are the vocabulary's, applied by another library that is faster for one text at a time; added tokens of
    the vocabulary's file stand for themselves wherever a text holds them, as they do in the library the file is made for.
    A chunk is a line feed or what follows a space, the space included. Where white space meets white space the
    pattern looks ahead, so such texts are encoded whole. Short chunks are kept, up to ``LIMIT`` of them.
    """

    LIMIT, SHORT = 200_000, 40
    AHEAD = re.compile(r"\s\s|\x00")

    def __init__(self, path: str) -> None:
        import tiktoken

        file = json.load(open(path, encoding="utf-8"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in file.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in byte for c in token) and token not in self.added}
        self.encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        found = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= self.SHORT:
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.cut and any(t in text for t in self.added):
            return b"".join(self.added.get(part) or self._ids(part) for part in self.cut.split(text) if part)
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        if self.AHEAD.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        if len(self) > self.LIMIT:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def pieces(docs: DataFrame, tokenizer: str, *, id: str, text: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = True, numbered: bool = False) -> DataFrame:
    """(``id``, piece, start, length, ids_crc32 and, if asked, ids): one row per piece; ``tokenizer`` is a path on every executor.

    ``numbered`` adds part, the task's number, and nth, the piece's among those of its length in the task.
    """
    kind = docs.select(F.col(f"`{id}`")).schema[0]

    @tidy
    def cut(batches):
        tokens = Tokens(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part_id, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in sliced(batches, 1):
            take, piece, start, length, crc, ids, nth = [], [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = tokens.ids(t.encode("utf-8", "replace").decode() if not t.isascii() else t) + end
                n = len(own) // 4
                first = n % capacity or min(n, capacity)
                for k, a in enumerate([0, *range(first, n, capacity)]):
                    part = own[4 * a : 4 * (a + (capacity if k else first))]
                    take.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part) // 4)
                    nth.append(seen[length[-1]])
                    seen[length[-1]] += 1
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                more.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if numbered:
                more += [pa.array([part_id] * len(take), pa.int32()), pa.array(nth, pa.int64())]
                names += ["part", "nth"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), *more], names)

    schema = f"`{id}` {kind.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", part int, nth long" * numbered
    return docs.select(F.col(f"`{id}`"), text_of(text).alias("__text")).mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for ``counts`` documents of each length: rows (length, rank, end rank, sequence, per sequence, offset), and the sequences used.

    The document of rank r in [rank, end rank) goes to sequence + (r - rank) // per at offset + (r - rank) % per * length.
    """
    places: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: (first sequence, how many)
    sizes: list[int] = []
    used = 0

    def leave(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
            else:
                size, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            per = size // length
            full, rest = min(n, left // per), 0
            if full < n:
                rest = left - full * per if left < n * per else 0
            took = full * per + rest
            places.append((length, rank, rank + took, first, per, capacity - size))
            leave(size - per * length, first, full)
            if rest:
                leave(size - rest * length, first + full, 1)
            leave(size, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + took, left - took
    return places, used


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """(``id``, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids): every piece and its place."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # the table holds the tasks' numbers, so they stay what they are
    cut = stored(pieces(keyed, tokenizer, id="id", capacity=capacity, end_id=end_id, keep_ids=keep_ids, numbered=True), "pieces")
    sizes = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places, used = best_fit({x: n for x, n in counts.items() if x < capacity}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if sizes.count() <= COUNTS:
        offsets = F.broadcast(offsets)
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 1, 0)], "size long, r0 long, r1 long, first long, per long, at long")
    if capacity in counts:
        table = table.union(spark.createDataFrame([(capacity, 0, counts[capacity], used, 1, 0)], table.schema))
    if len(places) <= PLACES:
        table = F.broadcast(table)
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(table, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    nth = F.col("rank") - F.col("r0")
    out = placed.withColumn("sequence_id", (F.col("first") + F.floor(nth / F.col("per"))).cast("long")).withColumn("offset", (F.col("at") + nth % F.col("per") * F.col("length")).cast("long"))
    return out.select(F.col("id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
