"""SimHash near-duplicates: a self-join of fingerprints by a binary trie, and the components of its links.

A text's fingerprint has bit i set if over half of its shingles' hashes have it set. Fingerprints are joined as leaves of a
binary trie: pairs of nodes are traversed together from the root, each level adds a differing bit to those whose
children differ, and a pair is pruned as soon as its bits exceed the budget. The first ``depth`` levels are the
same for all data, so their surviving pairs are dealt out as tasks: a subtree meets the lesser-or-equal subtrees within the
budget. A subtree with very many leaves is dealt in blocks, every pair of blocks once. In a task the traversal goes on
over sorted arrays. It returns a spanning forest of the links it finds, never all pairs.

A :class:`Budget` of many bits would prune little. So it has the trie built several times, each with another part of the fingerprint at
the top and a small budget there, and has pairs checked by further words of a longer fingerprint: ``SIMILAR`` links most texts with a similarity
of 0.8 or more by bits alone; ``WIDE`` proposes nearly all such pairs, and within the components of what it proposes
:func:`similar_documents` compares sets of shingles exactly.

Equal fingerprints are one leaf, so copies cost nothing beyond one aggregation. Null and empty texts have no word and
fingerprint zero, linked like any other. Repeated rows get equal results; a null id is allowed and is nobody's least id
unless its whole component has none. Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BYTES_LOWER, col, sliced, stored, text_of, tidy
from .components import components
from .hpylm import Words
from .repeats import mix


def hashes(text: str, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(BYTES_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    at, starts, ends = 0, [], []
    for n in map(len, words):
        starts.append(at)
        at += n
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(found: list[int]) -> int:
    """The fingerprint as a signed long."""
    if not len(found):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):  # blocks bound the memory of long texts
        block = np.asarray(found[at : at + 65_536], dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(">i8")[0])


def mixed(found: list[int], word: int) -> list[int] | np.ndarray:
    """Hashes for the fingerprint's further words, made of the first one's."""
    if not word or not len(found):
        return found
    h = np.array(found, np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[word % 3] + 2 * (word // 3))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str], width: int = 3, words: int = 1) -> DataFrame:
    """``keep``, fp and, for longer fingerprints, more: an array of ``words`` - 1 further words."""

    @tidy
    def make(batches):
        for b in sliced(batches):
            own = []
            for t in b.column(0).to_pylist():
                h = np.array(hashes(t, width), np.uint64)  # of one text at a time
                own.append([fingerprint(mixed(h, k)) for k in range(words)])
            more = [pa.array([x[0] for x in own], pa.int64())] + [pa.array([x[1:] for x in own], pa.list_(pa.int64()))] * (words > 1)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], [*b.schema.names[1:], *["fp", "more"][: len(more)]])

    rows = docs.select(text_of(text).alias("__text"), *[col(c) for c in keep])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType()), *[T.StructField("more", T.ArrayType(T.LongType()))] * (words > 1)])
    return rows.mapInArrow(make, schema)


class _Forest:
    """Disjoint sets over positions; ``edges`` are the links that joined two of them."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = np.arange(n), []

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.up[at]
        while not ((higher := self.up[found]) == found).all():
            found = higher
        self.up[at] = found
        return found

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def connect(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins the sets of all pairs (x, y), ordered by x."""
        while True:
            apart = self.roots(x) != self.roots(y)
            x, y = x[apart], y[apart]
            if not len(x):
                return
            heads = np.concatenate([[True], np.diff(x) != 0])
            for i, j in zip(x[heads].tolist(), y[heads].tolist(), strict=True):
                a, b = self.find(i), self.find(j)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
                    self.edges.append((i, j))


def trie_links(fp: np.ndarray, home: np.ndarray, budget: int, depth: int, tile: int = 256, *, early: tuple[int, int] | None = None, more: np.ndarray | None = None, whole: int = 64) -> np.ndarray:
    """Links (i, j), two rows: a forest that connects all leaves within the budget of which either is at home, each a pair within it.

    The leaves share no more than their order: the traversal starts below ``depth`` bits and counts the bits above.
    ``early`` is (levels, budget of these first levels); ``more`` has further words of each fingerprint, and ``whole`` is
    the budget of all of it.
    """
    order = np.lexsort((fp, ~home))
    fp, n_home = fp[order], int(home.sum())
    more = more[order] if more is not None else None
    levels, first = early or (64, budget)
    forest = _Forest(len(fp))

    def leaves(a: slice, b: slice) -> None:
        tree, other = forest.roots(np.arange(a.start, a.stop)), forest.roots(np.arange(b.start, b.stop))
        if (tree == other[0]).all() and (other == other[0]).all():
            return
        both = fp[a][:, None] ^ fp[b][None, :]
        near = np.bitwise_count(both) <= budget
        if levels < 64:
            near &= np.bitwise_count(both >> np.uint64(64 - levels)) <= first
        if a == b:
            near = np.triu(near, 1)
        i, j = np.nonzero(near & (tree[:, None] != other[None, :]))
        if more is not None and len(i):
            own = np.bitwise_count(both[i, j]) + np.bitwise_count(more[a][i] ^ more[b][j]).sum(axis=1, dtype=np.int64) <= whole
            i, j = i[own], j[own]
        forest.connect(i + a.start, j + b.start)

    def split(s: slice, bit: int) -> tuple[slice, slice]:
        part = fp[s]
        # sorted, and equal above this bit: ones follow zeros
        ones = (part >> np.uint64(63 - bit)) & np.uint64(1)
        cut = s.start + int(np.searchsorted(ones, 1))
        return slice(s.start, cut), slice(cut, s.stop)

    stack: list[tuple[slice, slice, int, int]] = []
    if n_home:
        stack.append((slice(0, n_home), slice(0, n_home), depth, 0))
        prefixes = fp[n_home:] >> np.uint64(64 - depth) if depth else np.zeros(len(fp) - n_home, np.uint64)
        own = fp[0] >> np.uint64(64 - depth) if depth else np.uint64(0)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(prefixes)) + 1, [len(prefixes)]]) if len(prefixes) else np.zeros(1, int)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            bits = int(np.bitwise_count(prefixes[i] ^ own))
            stack.append((slice(0, n_home), slice(n_home + int(i), n_home + int(j)), depth, bits))
    while stack:
        a, b, bit, bits = stack.pop()
        n, m = a.stop - a.start, b.stop - b.start
        if not n or not m or bits > (first if bit <= levels else budget):
            continue
        if n <= tile and m <= tile or bit == (levels if budget >= 64 else 64):
            for i in range(a.start, a.stop, tile):
                for j in range(b.start, b.stop, tile):
                    if a != b or i <= j:
                        leaves(slice(i, min(i + tile, a.stop)), slice(j, min(j + tile, b.stop)))
            continue
        a0, a1 = split(a, bit)
        if a == b:
            stack += [(a0, a0, bit + 1, bits), (a1, a1, bit + 1, bits), (a0, a1, bit + 1, bits + 1)]
        else:
            b0, b1 = split(b, bit)
            stack += [(a0, b0, bit + 1, bits), (a1, b1, bit + 1, bits), (a0, b1, bit + 1, bits + 1), (a1, b0, bit + 1, bits + 1)]
    return order[np.array(forest.edges, np.int64).reshape(-1, 2).T]


@dataclass(frozen=True)
class Budget:
    """How many bits linked fingerprints may differ in.

    The trie is built ``turns`` times, each time with the next ``levels`` bits (by default ``64 / turns``) at the top, where no more than
    ``first`` may differ. ``bits`` is the budget of the word that has them, and of all words, ``words`` of 64 bits, it is ``whole``.
    """

    bits: int = 2
    turns: int = 1
    first: int = 2
    words: int = 1
    whole: int = 64
    levels: int = 0


#: For texts with a similarity (of their sets of shingles) of 0.8 or more by bits alone: such differ in about 15 of 100 bits.
SIMILAR = Budget(bits=11, turns=4, first=2, words=3, whole=31)


def links(fps: DataFrame, *, budget: int | Budget = 2, leaves: int = 8192) -> DataFrame:
    """(a, b): links that connect what fingerprints (``fp``, distinct; with ``node`` and ``more`` if longer) within the budget connect.

    ``leaves`` is the number of fingerprints that a task's subtree should have.
    """
    plan = budget if isinstance(budget, Budget) else Budget(budget, 1, budget)
    levels, n = plan.levels or 64 // plan.turns, fps.count()
    depth = max(2, min(24, levels, math.ceil(math.log2(max(1, n) / leaves)))) if n > leaves else 0
    if plan.first > 2:
        depth = min(depth, 16)
    masks = [m for k in range(plan.first + 1) for m in (sum(1 << i for i in own) for own in itertools.combinations(range(depth), k))]
    long = plan.words > 1
    rest = ["id", *["more"] * long]
    rows = fps.select("fp", F.col("node" if long else "fp").alias("id"), *["more"] * long)
    if plan.turns > 1:
        words = [F.col("fp"), *[F.get("more", F.lit(k)) for k in range(plan.words - 1)]]

        def turn(t: int) -> Column:
            """The part at the top of its word, and the other words."""
            word, by = t * levels // 64, t * levels % 64
            top = words[word] if by == 0 else F.shiftleft(words[word], by).bitwiseOR(F.shiftrightunsigned(words[word], 64 - by))
            return F.struct(F.lit(t).alias("turn"), top.alias("fp"), F.array(*[w for k, w in enumerate(words) if k != word]).cast("array<bigint>").alias("more"))

        rows = rows.select(F.explode(F.array(*[turn(t) for t in range(plan.turns)])).alias("t"), "id").select("t.turn", "t.fp", "id", *["t.more"] * long)
    else:
        rows = rows.withColumn("turn", F.lit(0))
    rows = rows.withColumn("node", F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long"))
    size = rows.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n"))
    blocks = size.filter(F.col("n") > 4 * leaves).select("turn", "node", F.ceil(F.col("n") / (2 * leaves)).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["turn", "node"], "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    dealt = rows.withColumn("mask", F.explode(F.lit(masks).cast("array<bigint>"))).withColumn("target", F.col("node").bitwiseXOR(F.col("mask"))).filter("target <= node")
    dealt = dealt.join(blocks.select("turn", F.col("node").alias("target"), "blocks"), ["turn", "target"], "left")
    first = F.when(F.col("mask") == 0, F.col("block")).otherwise(0)
    dealt = dealt.withColumn("task", F.explode(F.sequence(first, F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("turn", "target", "task", "fp", *rest, ((F.col("mask") == 0) & (F.col("block") == F.col("task"))).alias("home"))

    def join(t: pa.Table) -> pa.Table:
        ids, fp = t["id"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        more = np.array(t["more"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(len(t), -1) if long else None
        a, b = trie_links(fp, t["home"].to_numpy(), plan.bits, depth, early=(levels, plan.first), more=more, whole=plan.whole)
        return pa.table([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return dealt.groupBy("turn", "target", "task").applyInArrow(join, "a long, b long")


def _near(keyed: DataFrame, keep: list[str], budget: int | Budget, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, placed): ``keep``, fp and node of every row, and the root of every node."""
    words = budget.words if isinstance(budget, Budget) else 1
    rows = fingerprints(keyed, keep=keep, width=width, words=words)
    rows = stored(rows.withColumn("node", F.xxhash64("fp", "more")) if words > 1 else rows.withColumn("node", F.col("fp")), "fingerprints")
    more = [F.first("fp").alias("fp"), F.first("more").alias("more")] if words > 1 else [F.first("fp").alias("fp")]
    own = stored(rows.groupBy("node").agg(*more), "leaves")
    roots = components(links(own, budget=budget))
    return rows.select(*keep, "fp", "node"), stored(own.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "components")


def _least(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, component_id): a node's least id is found first, so copies are aggregated where they are."""
    own = placed.join(rows.groupBy("node").agg(F.min("id").alias("least")), "node")
    return stored(own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id"), "least")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", budget: int | Budget = 2, width: int = 3) -> DataFrame:
    """One row per document: ``id``, fp (long) and component_id, the least id among all that can be reached."""
    keyed = docs.select(col(id).alias("id"), col(text).alias("text"))
    rows, placed = _near(keyed, ["id"], budget, width)
    return rows.join(_least(rows, placed).drop("root"), "node").select(F.col("id").alias(id), "fp", "component_id")


# similarity of sets of shingles

#: Least similarity, as a fraction, of texts that are linked.
SHARE = (4, 5)
#: What may have a similarity of 0.8 or more: such sets differ in about 39 of 256 bits, with a standard deviation of 6, and in 2 bits or fewer
#: of one of 8 parts of 16 bits but for 1 pair in 600.
WIDE = Budget(bits=64, turns=8, first=2, words=4, whole=72, levels=16)
#: Shingles that a task holds of a component it compares within, and of those that it has as columns at once.
BLOCK, COLUMNS = 600_000, 8192


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; fewer words than ``width`` are one shingle."""
    token, doc = Words()(texts)
    n = np.bincount(doc, minlength=len(texts)) - 1  # without the end token
    first = np.cumsum(n + 1) - n - 1
    size = np.minimum(n, width)
    h = mix(np.repeat(size, n + 1).astype(np.uint64) + np.uint64(11))
    for k in range(min(width, len(h))):  # a few short texts may have fewer words than one shingle
        h[: len(h) - k] = np.where((k < size)[doc[: len(h) - k]], mix(h[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + token[k:]), h[: len(h) - k])
    return [np.unique(h[a : a + m - k + 1]) if m else h[:0] for a, m, k in zip(first.tolist(), n.tolist(), size.tolist(), strict=True)]


def sketch(own: np.ndarray, words: int) -> np.ndarray:
    """``words`` signed longs: a bit is 1 if over half of the set's hashes have it; zeros for an empty set."""
    if not len(own):
        return np.zeros(words, np.int64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), 32_768):  # blocks bound the memory of long texts
        part = own[at : at + 32_768]
        wide = np.stack([mixed(part, k) for k in range(words)], axis=1).astype(">u8")
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(own)).view(">i8").astype(np.int64)


def _node(own: np.ndarray) -> int:
    """A set's number: a hash, as a signed long."""
    return xxhash.xxh64_intdigest(own.tobytes(), 7) - (1 << 63)


def _sets(batch: pa.RecordBatch, column: int, width: int) -> list[np.ndarray]:
    return shingle_sets([bytes(x.as_buffer()) for x in batch.column(column).cast(pa.binary())], width)


def _signed(keyed: DataFrame, keep: list[str], width: int, words: int) -> DataFrame:
    """``keep``, node, fp and more of the text's set of shingles, and n, its size."""

    @tidy
    def make(batches):
        for b in sliced(batches, rows=500, size=1_000_000):
            sets = _sets(b, 0, width)
            bits = np.stack([sketch(x, words) for x in sets])
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (words - 1), pa.int32()), pa.array(bits[:, 1:].ravel()))
            own = [pa.array([_node(x) for x in sets], pa.int64()), pa.array(bits[:, 0]), more, pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *own], [*b.schema.names[1:], "node", "fp", "more", "n"])

    fields = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("more", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]
    return keyed.select("text", *keep).mapInArrow(make, T.StructType([*[keyed.schema[c] for c in keep], *fields]))


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``, as a product of matrices, some elements at a time."""
    flat, other = np.concatenate(a), np.concatenate(b)
    columns = np.intersect1d(flat, other)
    out = np.zeros((len(a), len(b)), np.float32)

    def cells(x: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(columns, x)
        own = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == x) if len(columns) else np.zeros(len(x), bool)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[own], at[own]

    (row_a, at_a), (row_b, at_b) = cells(flat, a), cells(other, b)
    for start in range(0, len(columns), COLUMNS):
        wide = []
        for row, at, n in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            own = (at >= start) & (at < start + COLUMNS)
            wide.append(np.zeros((n, min(COLUMNS, len(columns) - start)), np.float32))
            wide[-1][row[own], at[own] - start] = 1
        out += wide[0] @ wide[1].T
    return out


def exact_links(sets: list[np.ndarray], left: np.ndarray, share: tuple[int, int], tile: int = 512) -> list[tuple[int, int]]:
    """A forest of the pairs of sets with the similarity, of which one is ``left`` and the other not, or any two where all are left.

    A tile's worth of sets meets all others first: what these connect need not meet again.
    """
    low, high = share
    size = np.array([len(x) for x in sets])
    forest = _Forest(len(sets))

    def meet(rows: np.ndarray, cols: np.ndarray) -> None:
        rows, cols = (x[np.argsort(size[x], kind="stable")] for x in (rows, cols))  # so that few tiles meet
        for i in range(0, len(rows), tile):
            for j in range(0, len(cols), tile):
                a, b = rows[i : i + tile], cols[j : j + tile]
                if high * size[a[-1]] < low * size[b[0]] or high * size[b[-1]] < low * size[a[0]]:
                    continue
                x, y = size[a][:, None], size[b][None, :]
                open = (forest.roots(a)[:, None] != forest.roots(b)[None, :]) & (high * np.minimum(x, y) >= low * np.maximum(x, y))
                some, others = open.any(axis=1), open.any(axis=0)
                if not some.any():
                    continue
                a, b, open = a[some], b[others], open[np.ix_(some, others)]
                if len(a) * len(b) <= 16:
                    both = np.array([[len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in b] for x in a])
                else:
                    both = common([sets[x] for x in a], [sets[y] for y in b])
                x, y = np.nonzero(open & (high * both >= low * (size[a][:, None] + size[b][None, :] - both)))
                forest.connect(a[x], b[y])

    def apart(own: np.ndarray) -> np.ndarray:
        """Those not in the largest set of all."""
        return own[forest.roots(own) != np.bincount(forest.roots(np.arange(len(sets)))).argmax()]

    spread = lambda x: x[:: max(1, len(x) // tile)][:tile]
    every = np.arange(len(sets))
    rows, cols = (every, every) if left.all() else (np.flatnonzero(left), np.flatnonzero(~left))
    if not len(rows) or not len(cols):
        return []
    meet(spread(rows), cols)
    if left.all():
        meet(apart(every), every)
    else:
        meet(rows, spread(cols))
        meet(apart(rows), cols)
        meet(rows, apart(cols))
    return forest.edges


def _compared(texts: DataFrame, share: tuple[int, int], width: int) -> DataFrame:
    """(a, b): verified links between nodes of a component, for rows (bucket, cc, left, text) of which a bucket is a task."""

    @tidy
    def run(t: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        t = t.sort_by("cc").combine_chunks()
        cc = t["cc"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cc)) + 1).tolist(), len(cc)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = t.slice(a, b - a)
            own, left = {}, {}
            for batch in sliced(part.select(["text", "left"]).to_batches(), rows=500, size=1_000_000):
                for x, side in zip(_sets(batch, 0, width), batch.column(1).to_pylist(), strict=True):
                    node = _node(x)
                    own[node] = x
                    left[node] = side
            nodes = list(own)
            found += [(nodes[i], nodes[j]) for i, j in exact_links(list(own.values()), np.array(list(left.values())), share)]
        yield pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return texts.groupBy("bucket").applyInArrow(lambda t: next(run(t)), "a long, b long")


def _similar(keyed: DataFrame, keep: list[str], share: tuple[int, int], width: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, placed): ``keep``, with digest (a hash of the text), and node of every row, and the root of every node.

    Nodes are distinct sets of shingles. The trie proposes links; a component of proposals is compared in one task if it has at most
    ``block`` shingles, together with other small ones, and otherwise in blocks: every block with the first, and, if that does not
    connect the component, every block with every other.
    """
    rows = stored(_signed(keyed, keep, width, WIDE.words), "fingerprints")
    own = stored(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "more", "n")], F.min("digest").alias("digest")), "leaves")
    proposed = components(links(own.select("node", "fp", "more"), budget=WIDE, leaves=16_384)).withColumnRenamed("root", "cc")
    members = stored(own.select("node", "n", "digest").join(proposed, "node"), "members")
    sized = members.groupBy("cc").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("nodes"))
    total = sized.agg(F.sum("all")).first()[0] or 0
    buckets = max(1, math.ceil(2 * total / block))
    blocks = F.ceil(2 * F.col("all") / block).cast("int")
    members = stored(members.join(sized, "cc").withColumn("blocks", F.when(F.col("all") <= block, 1).otherwise(blocks)).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")), "members")
    texts = keyed.select("digest", "text").join(members.select("digest", "cc", "blocks", "block"), "digest")  # of copies in one task, one
    texts = stored(texts.groupBy("digest").agg(F.first("text").alias("text"), F.first(F.struct("cc", "blocks", "block")).alias("m")).select("digest", "text", "m.*"), "texts")
    small = texts.filter("blocks = 1").select(F.pmod(F.xxhash64("cc"), F.lit(buckets)).alias("bucket"), "cc", F.lit(True).alias("left"), "text")

    def met(rows: DataFrame, first: bool) -> DataFrame:
        """Rows for pairs of blocks: with the first one alone, or all others."""
        others = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("blocks") - 1)
        pairs = F.transform(F.when((F.col("block") == 0) & F.lit(first), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(others), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        dealt = rows.withColumn("p", F.explode(pairs)).withColumn("left", (F.col("p.i") == F.col("p.j")) | (F.col("block") == F.col("p.i")))
        return dealt.select(F.xxhash64("cc", "p.i", "p.j").alias("bucket"), "cc", "left", "text")

    found = stored(_compared(small, share, width), "similar")
    large = texts.filter("blocks > 1")
    if not large.isEmpty():
        found = found.union(stored(_compared(met(large, True), share, width), "similar"))
        roots = members.filter("blocks > 1").select("node", "cc").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = roots.groupBy("cc").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("cc")
        found = found.union(stored(_compared(met(large.join(left, "cc", "left_semi"), False), share, width), "similar"))
    placed = own.select("node").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows.select(*keep, "node"), stored(placed, "components")


def similar_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE, width: int = 5) -> DataFrame:
    """One row per document: ``id`` and component_id, the least id that links of the similarity ``share`` or more reach.

    No link is made up: each is verified. The fingerprints may miss one, see ``WIDE``.
    """
    keyed = docs.select(col(id).alias("id"), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("digest"))
    rows, placed = _similar(keyed, ["id", "digest"], share, width)
    return rows.join(_least(rows, placed).drop("root"), "node").select(F.col("id").alias(id), "component_id")


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", budget: int | Budget = 2, width: int = 3, share: tuple[int, int] | None = None) -> DataFrame:
    """One document of each component: that with the least id, and of those the one with the least hash of its text.

    With ``share`` components are those of :func:`similar_documents`, otherwise of fingerprints within ``budget``. All columns stay, of
    any name and type. A document without an id stays only where its component has none with an id. Rows that share an id are
    documents of their own: each component they lead keeps one. Of rows with equal id and text any one stays.
    """
    digest = F.xxhash64(text_of(text))  # a text has one component, so its hash leads back to it
    keyed = docs.select(col(id).alias("id"), text_of(text).alias("text"), digest.alias("digest"))
    rows, placed = _similar(keyed, ["id", "digest"], share, width) if share else _near(keyed, ["id", "digest"], budget, width)
    # the least row of a node first, so copies are aggregated where they are
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("digest"))
    least = placed.join(rows.groupBy("node").agg(F.min(key).alias("k")), "node").groupBy("root").agg(F.min("k").alias("k"))
    plain = lambda x: F.coalesce(x.cast("string"), F.lit(""))  # noqa: E731  a null id as a value to join by
    kept = stored(least.select(F.col("k.none").alias("none"), plain(F.col("k.id")).alias("key"), F.col("k.digest").alias("digest")), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    mine = docs.select(col(id).isNull().alias("none"), plain(col(id)).alias("key"), digest.alias("digest"), F.struct(*[col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row"))
    one = mine.groupBy("none", "key", "digest").agg(F.first("row").alias("row"))
    return one.join(kept, ["none", "key", "digest"], "left_semi").select(*[F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])
