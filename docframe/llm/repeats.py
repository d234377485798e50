"""Removal of byte strings that also start in an earlier document, by a suffix order built column by column.

Every string of ``width`` bytes is cut out of its document with its neighbours of one minimizer (the substring of ``MINI`` bytes with the
least hash), so that equal strings of any two documents meet in one bucket, whose number grows with the data. A bucket's
segments are a collection of short documents. Their Burrows-Wheeler transform is built column by column, from the right: each round
inserts one symbol of every segment, at the place that the last round's transform gives it, and updates the common prefixes of the
inserted suffixes and of their successors, in one sequential sweep over the piles. Runs of suffixes that
share ``width`` bytes then name the least document of each string, and a document's strings with a lesser one are removed.

A minimizer that very many segments have would be too much for one task. Its strings are dealt out one by one instead, with their hashes.

Segments without a partner (no other document has the minimizer with 19 more bytes on either side, which every shared string needs)
and repeated segments are left out before. That loses nothing. The piles are arrays of a bounded block of segments rather than
files: a machine's own folder would be lost with its executor.

A null text is empty. Documents without an id have no lesser id and are nobody's, so they lose nothing. Rows that share an id do not
remove each other's strings. Overlaps count, and very long texts are cut into overlapping pieces. Extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored, text_of

MINI = 12
#: Text bytes that are cut at once, segment bytes that are sent at once, symbols of a block of segments, text bytes for each bucket.
PIECE, FLUSH, BLOCK, BUCKET = 1_000_000, 32_000_000, 1_500_000, 8_000_000
#: Segments that make a minimizer hot, and those in a part of a task from which on it is counted.
HOT, OFTEN = 200_000, 8
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _C3
    return h ^ (h >> np.uint64(32))


def eights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the 4 and of the 8 bytes that start at each place."""
    x = x.astype(np.uint64)
    two = x[:-1] | (x[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four, four[:-4] | (four[4:] << np.uint64(32))


def mini_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the ``MINI`` bytes from each place on."""
    four, eight = eights(x)
    return mix(eight[:-4] * _C1 + mix(four[8:] * _C2))


def rows_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view("<u8")
    h = np.full(len(rows), 7, np.uint64)
    for k in range(words.shape[1]):
        h = mix((h ^ words[:, k]) * _C1 + _C2)
    return h


def segments(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, strings, minimizer's offset, hash) of the segments of pieces that lie one after the other in ``buf``."""
    n, per = len(buf), width - MINI + 1
    none = np.zeros(0, np.int64)
    if n < width or not (lens >= width).any():
        return none, none, none, none.astype(np.uint64)
    h = mini_hashes(buf)
    mask = np.uint64((1 << 24) - 1)
    least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= per:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < per:
        least = np.minimum(least[: len(least) - (per - size)], least[per - size :])
    at = (least & mask).astype(np.int64)
    edge = np.zeros(len(at) + 1, np.int32)
    long = lens >= width
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + lens[long] - width + 1, -1)
    ok = np.cumsum(edge[:-1]) > 0
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | ~ok[:-1] | ~ok[1:]
    first = np.flatnonzero(ok & change[:-1])
    last = np.flatnonzero(ok & change[1:])
    return first, last - first + 1, at[first] - first, h[at[first]]


def pieces(batches, width: int):
    """(doc, key, place, buffer, first, strings, offset, hash): segments of a task's texts, about ``PIECE`` bytes at a time."""

    def cut_up(own: list[tuple[int, int, int, bytes]]):
        buf = np.frombuffer(b"".join(p[3] for p in own), np.uint8)
        lens = np.array([len(p[3]) for p in own], np.int64)
        starts = np.cumsum(lens) - lens
        first, strings, off, h = segments(buf, starts, lens, width)
        piece = np.searchsorted(starts, first, side="right") - 1
        doc, key, at = (np.array([p[i] for p in own], np.int64)[piece] for i in range(3))
        return doc, key, first - starts[piece] + at, buf, first, strings, off, h

    waiting, own = 0, []
    for b in batches:
        for i in range(b.num_rows):
            doc, key, body = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_buffer()
            for at in range(0, len(body) - width + 1, PIECE):  # neighbouring pieces share width - 1 bytes
                own.append((doc, key, at, bytes(body[at : at + PIECE + width - 1])))
                waiting += len(own[-1][3])
                if waiting >= PIECE:
                    yield cut_up(own)
                    waiting, own = 0, []
    if own:
        yield cut_up(own)


def among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ``hot`` ones."""
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def frequent(batches, width: int):
    """Rows (hash, n): minimizers that ``OFTEN`` or more segments of a part of a task have."""

    def count(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["hash", "n"])

    held, size = [], 0
    for *_, h in pieces(batches, width):
        held.append(h)
        size += len(h)
        if size >= 4_000_000:
            yield count(held)
            held, size = [], 0
    if held:
        yield count(held)


def strings_of(batches, width: int, hot: np.ndarray):
    """Rows (doc, key, at, h0, h1): the strings whose minimizer is a hot one, each with two hashes."""
    names = ["doc", "key", "at", "h0", "h1"]
    for doc, key, start, buf, first, strings, _, h in pieces(batches, width):
        own = np.flatnonzero(among(h, hot))
        for some in np.array_split(own, max(1, len(own) // 10_000)):
            if len(some):
                n = strings[some]
                seg = np.repeat(some, n)
                nth = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
                rows = np.lib.stride_tricks.sliding_window_view(buf, width)[first[seg] + nth]
                both = [rows_hash(rows).view(np.int64), rows_hash(rows[:, ::-1]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[seg], key[seg], start[seg] + nth, *both)], names)


def cut(batches, width: int, buckets: int, hot: np.ndarray):
    """Rows (bucket, docs, refs, starts, strings, offs, bytes): the segments of a task for each bucket, compressed."""
    most = 2 * width - MINI
    held: dict[int, list[tuple]] = {}
    size = 0
    pack = zstandard.ZstdCompressor(level=3).compress

    def flush():
        nonlocal size
        for bucket, parts in held.items():
            ids, keys, start, strings, off, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
            both, ref = np.unique(np.stack([ids, keys]), axis=1, return_inverse=True)
            row = [both.astype("<i8"), np.diff(ref.ravel(), prepend=0).astype("<i4"), np.diff(start, prepend=0).astype("<i8"), strings.astype("u1"), off.astype("u1"), flat]
            cells = [x.view("u1").reshape(-1, x.itemsize).T.tobytes() for x in row[1:3]]  # bytes of one place together
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([pack(x)], pa.binary()) for x in (row[0].tobytes(), *cells, *[x.tobytes() for x in row[3:]])]], ["bucket", *NAMES])
        held.clear()
        size = 0

    for doc, key, start, buf, first, strings, off, h in pieces(batches, width):
        bucket = (mix(h * _C2) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        order = order[~among(h[order], hot)]
        if not len(order):
            continue
        doc, key, start, first, strings, off, bucket = (x[order] for x in (doc, key, start, first, strings, off, bucket))
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(most, np.uint8)]), most)[first]
        flat = wide[np.arange(most)[None, :] < (strings + width - 1)[:, None]]
        ends = np.concatenate([[0], np.cumsum(strings + width - 1)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            held.setdefault(int(bucket[x]), []).append((doc[x:y], key[x:y], start[x:y], strings[x:y], off[x:y], flat[ends[x] : ends[y]]))
        size += len(flat)
        if size >= FLUSH:
            yield from flush()
    yield from flush()


NAMES = ["docs", "refs", "starts", "strings", "offs", "bytes"]


class RangeMin:
    """Least values of ranges of a byte array: windows of up to 64, and a sparse table over blocks of 64."""

    def __init__(self, x: np.ndarray) -> None:
        self.small = [x]
        for k in range(6):
            last = self.small[-1]
            self.small.append(np.minimum(last[: -(1 << k)], last[1 << k :]) if len(last) > 1 << k else last[:0])
        pad = np.full(-len(x) % 64, 255, np.uint8)
        self.large = [np.concatenate([x, pad]).reshape(-1, 64).min(axis=1) if len(x) else x]
        while len(self.large[-1]) > 1 << (len(self.large) - 1):
            k = len(self.large) - 1
            self.large.append(np.minimum(self.large[-1][: -(1 << k)], self.large[-1][1 << k :]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = last - first + 1
        out = np.empty(len(n), np.uint8)
        level = np.minimum(np.frexp(n.astype(np.float64))[1] - 1, 6)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.small[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        far = np.flatnonzero(n > 128)
        if len(far):
            a, b = -(-first[far] // 64), (last[far] + 1) // 64 - 1  # whole blocks within
            level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                at, x, y = far[own], a[own], b[own]
                out[at] = np.minimum(out[at], np.minimum(self.large[k][x], self.large[k][y - (1 << k) + 1]))
        return out


def least_docs(rows: np.ndarray, lens: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """For each segment and each of its strings the least of ``docs`` over all segments that hold the string.

    The collection's transform and common prefixes grow by one symbol of every segment a round, right to left.
    """
    m = len(rows)
    by_len = np.argsort(-lens, kind="stable")
    rows, lens, own_docs = rows[by_len], lens[by_len], docs[by_len]
    longest = int(lens[0])
    inside = np.arange(rows.shape[1])[None, :] < lens[:, None]
    present = np.zeros(256, bool)
    present[rows[inside]] = True
    kind = np.uint8 if present.sum() < 256 else np.uint16
    code = np.zeros(256, kind)
    code[present] = np.arange(1, present.sum() + 1)
    coded = code[rows]
    active = np.searchsorted(-lens, -np.arange(longest + 2), side="right")  # segments of at least t symbols
    every = np.arange(m)

    def preceding(t: int) -> np.ndarray:
        """The symbol before each active segment's suffix of t symbols, 0 where there is none."""
        a = active[t]
        at = lens[:a] - t - 1
        return np.where(at >= 0, coded[every[:a], np.maximum(at, 0)], 0).astype(kind)

    bwt, lcp = preceding(0), np.zeros(m, np.uint8)
    place = every
    for t in range(1, longest + 1):
        a = active[t]
        order = np.argsort(bwt, kind="stable")  # the transform's symbols in suffix order: a pile for each
        ends = int(np.count_nonzero(bwt == 0))
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        rank = where[place[:a]]  # among all old suffixes by their extension
        new = rank + (m - ends)
        total = m + len(bwt) - ends
        grown = np.zeros(total, bool)
        grown[new] = True
        kept = np.flatnonzero(~grown)
        prefixes = np.empty(total, np.uint8)
        prefixes[kept] = lcp
        symbols = np.empty(total, kind)
        symbols[kept] = bwt
        symbols[new] = preceding(t)
        # common prefixes of the new suffixes and of those that follow them
        asked = np.zeros(len(order) + 1, bool)
        asked[rank] = True
        asked[rank + 1] = True
        asked = np.flatnonzero(asked[:-1])
        asked = asked[asked >= ends]
        before = np.maximum(asked - 1, 0)
        same = (asked > ends) & (bwt[order[asked]] == bwt[order[before]])
        prefixes[asked[~same] + (m - ends)] = 0
        asked, before = asked[same], before[same]
        if len(asked):
            found = RangeMin(lcp)(order[before] + 1, order[asked])
            prefixes[asked + (m - ends)] = np.minimum(found + 1, width)
        bwt, lcp, place = symbols, prefixes, new
    order = np.argsort(bwt, kind="stable")
    ends = int(np.count_nonzero(bwt == 0))
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order)) + (m - ends)
    heads = np.flatnonzero(lcp < width)
    run = np.cumsum(lcp < width) - 1
    least = np.full(len(bwt), np.iinfo(np.int64).max)
    walk, place = [], every
    for t in range(1, longest + 1):
        place = where[place[: active[t]]]
        if t >= width:
            walk.append((t, place))
            least[place] = own_docs[: len(place)]
    least = np.minimum.reduceat(least, heads)[run]
    out = np.full((m, rows.shape[1] - width + 1), np.iinfo(np.int64).max)
    for t, place in walk:
        out[by_len[: len(place)], lens[: len(place)] - t] = least[place]
    return out


def _shared(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a row's hash is also another document's."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    d = docs[order]
    many = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(many, np.diff(np.concatenate([heads, [len(h)]])))
    return out


def bucket_runs(docs: np.ndarray, strings: np.ndarray, offs: np.ndarray, flat: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first string, last string): runs of strings of a segment that a lesser document also holds."""
    most = 2 * width - MINI
    lens = strings + width - 1
    begins = np.cumsum(lens) - lens
    padded = np.concatenate([flat, np.zeros(most, np.uint8)])
    near = (width - MINI) // 2  # of the bytes beside the minimizer, one side has as many
    view = np.lib.stride_tricks.sliding_window_view(padded, MINI + near)
    keep = np.zeros(len(docs), bool)
    for at, fits in ((offs, offs + MINI + near <= lens), (offs - near, offs >= near)):
        own = np.flatnonzero(fits)
        keep[own] |= _shared(rows_hash(view[begins[own] + at[own]]), docs[own])
    own = np.flatnonzero(keep)
    none = np.zeros(0, np.int64)
    if not len(own):
        return none, none, none
    mini = rows_hash(np.lib.stride_tricks.sliding_window_view(padded, MINI)[begins[own] + offs[own]])
    order = np.argsort(mini, kind="stable")
    own, mini = own[order], mini[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(mini) != 0, [True]]))  # equal minimizers stay together
    view = np.lib.stride_tricks.sliding_window_view(padded, most)
    out, at = [], 0
    while at < len(heads) - 1:
        to = int(np.searchsorted(heads, heads[at] + BLOCK // most, side="right")) - 1
        to = max(at + 1, min(to, len(heads) - 1))
        block = own[heads[at] : heads[to]]
        rows = view[begins[block]]
        rows[np.arange(most)[None, :] >= lens[block][:, None]] = 0
        out.append(block_runs(block, rows, mini[heads[at] : heads[to]], docs[block], strings[block], width))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def block_runs(segment: np.ndarray, rows: np.ndarray, mini: np.ndarray, docs: np.ndarray, strings: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`bucket_runs` of a block, whose equal segments are one in the suffix order.

    Where all segments of a minimizer are equal, so are their strings, and no order is needed.
    """
    order = np.lexsort((rows_hash(rows), mini))
    segment, rows, mini, docs, strings = segment[order], rows[order], mini[order], docs[order], strings[order]
    same = np.zeros(len(rows), bool)
    same[1:] = (mini[1:] == mini[:-1]) & (rows[1:] == rows[:-1]).all(axis=1) & (strings[1:] == strings[:-1])
    heads = np.flatnonzero(~same)
    first_docs = np.minimum.reduceat(docs, heads)
    least = np.repeat(first_docs[:, None], rows.shape[1] - width + 1, axis=1)
    own = mini[heads]
    many = np.zeros(len(heads), bool)
    many[1:] = own[1:] == own[:-1]
    many[:-1] |= many[1:]
    if many.any():
        at = heads[many]
        least[many] = least_docs(rows[at], strings[at] + width - 1, first_docs[many], width)
    edge = np.zeros((len(rows), least.shape[1] + 2), np.int8)
    edge[:, 1:-1] = (least[np.cumsum(~same) - 1] < docs[:, None]) & (np.arange(least.shape[1])[None, :] < strings[:, None])
    step = np.diff(edge, axis=1)
    seg, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return segment[seg], first, last - 1


def found_in(bucket: pa.Table, width: int, parts: int) -> pa.Table:
    """Rows (bucket, docs, spans): the byte ranges to remove that a bucket's segments show, for each bucket of documents."""
    load = zstandard.ZstdDecompressor().decompress
    cells: list[list[np.ndarray]] = []
    for r in bucket.select(NAMES).to_pylist():
        both = np.frombuffer(load(r["docs"]), "<i8").reshape(2, -1)
        ref, start = (np.cumsum(np.ascontiguousarray(np.frombuffer(load(r[n]), "u1").reshape(int(k[2]), -1).T).view(k).ravel()) for n, k in (("refs", "<i4"), ("starts", "<i8")))
        cells.append([both[0][ref], both[1][ref], start, np.frombuffer(load(r["strings"]), "u1").astype(np.int64), np.frombuffer(load(r["offs"]), "u1").astype(np.int64), np.frombuffer(load(r["bytes"]), np.uint8)])
    docs, keys, starts, strings, offs, flat = (np.concatenate(x) for x in zip(*cells, strict=True))
    cells.clear()
    seg, first, last = bucket_runs(docs, strings, offs, flat, width)
    return answers(docs[seg], keys[seg], starts[seg] + first, last - first + width, parts)


def answers(docs: np.ndarray, keys: np.ndarray, begin: np.ndarray, size: np.ndarray, parts: int) -> pa.Table:
    """Rows (bucket, docs, spans) of byte ranges to remove, for each bucket of documents."""
    place = place_of(docs, keys, parts)
    order = np.lexsort((begin, keys, docs, place))
    docs, keys, begin, size, place = (x[order] for x in (docs, keys, begin, size, place))
    new = np.ones(len(docs), bool)
    new[1:] = (np.diff(docs) != 0) | (np.diff(keys) != 0) | (np.diff(place) != 0)
    cuts = np.concatenate([np.flatnonzero(np.diff(place, prepend=-1)), [len(place)]])
    out: list[tuple] = []
    pack = zstandard.ZstdCompressor(level=1).compress
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        heads = np.flatnonzero(new[a:b])
        named = np.stack([docs[a:b][heads], keys[a:b][heads], np.diff(np.append(heads, b - a))])
        out.append((int(place[a]), pack(named.astype("<i8").tobytes()), pack(np.stack([begin[a:b], size[a:b]]).astype("<i8").tobytes())))
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "docs", "spans"])


def hot_answers(batches, width: int, parts: int):
    """The same of single strings (doc, key, at); neighbours are one range."""
    for b in batches:
        docs, keys, at = (b.column(i).to_numpy() for i in range(3))
        order = np.lexsort((at, keys, docs))
        docs, keys, at = docs[order], keys[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(docs) != 0) | (np.diff(keys) != 0) | (np.diff(at) != 1)
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(at)))
        yield from answers(docs[heads], keys[heads], at[heads], runs + width - 1, parts).to_batches()


def place_of(docs: np.ndarray, keys: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a document by its id and the hash of its text."""
    return (mix(docs.astype(np.int64).view(np.uint64) * _C1 + keys.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def cover(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the ranges."""
    order = np.argsort(begin, kind="stable")
    a, b = begin[order], np.maximum.accumulate((begin + size)[order])
    heads = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[heads], b[np.concatenate([heads[1:], [len(a)]]) - 1]


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 50, keep_text: bool = True, bucket_bytes: int = BUCKET, hot_segments: int = HOT) -> DataFrame:
    """``id``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, removed (array of byte ranges) and kept (binary).

    What is left of a text may end within a character, so it is bytes. Texts meet their ranges in buckets of documents.
    Strings whose minimizer ``hot_segments`` segments have, or a millionth of all, are compared one by one, by two hashes,
    with partial aggregates before they are sent.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{id}`").cast("long").alias("doc"), F.xxhash64(text_of(text)).alias("key"), text_of(text).cast("binary").alias("body"))
    total = docs.agg(F.sum(F.octet_length(text_of(text)).cast("long"))).first()[0] or 0
    buckets = max(8, math.ceil(total / bucket_bytes))
    parts = max(8, buckets // 4)
    named = rows.filter(F.col("doc").isNotNull()).select("doc", "key", "body")
    often = named.mapInArrow(lambda it: frequent(it, width), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(hot_segments, total // 20_000_000))
    hot = np.sort(np.array([r.hash for r in often.select("hash").collect()], np.int64).view(np.uint64))  # at most a million
    sent = named.mapInArrow(lambda it: cut(it, width, buckets, hot), "bucket int, " + ", ".join(f"{n} binary" for n in NAMES))
    found = sent.groupBy("bucket").applyInArrow(lambda t: found_in(t, width, parts), "bucket int, docs binary, spans binary")
    both = rows.mapInArrow(lambda it: text_blocks(it, parts), "bucket int, docs binary, spans binary").union(found)
    if len(hot):
        one = stored(named.mapInArrow(lambda it: strings_of(it, width, hot), "doc long, key long, at long, h0 long, h1 long"), "strings")
        least = one.groupBy("h0", "h1").agg(F.min("doc").alias("least"))
        hits = one.join(least, ["h0", "h1"]).filter("least < doc").select("doc", "key", "at")
        both = both.union(hits.mapInArrow(lambda it: hot_answers(it, width, parts), "bucket int, docs binary, spans binary"))
    fields = [f"id {rows.schema['id'].dataType.simpleString()}", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
    fields += ["removed array<struct<start:bigint,end:bigint>>", "kept binary"] * keep_text
    return both.groupBy("bucket").applyInArrow(lambda t: cut_out(t, keep_text), ", ".join(fields)).withColumnRenamed("id", id)


def text_blocks(batches, parts: int):
    """Rows (bucket, docs) without spans: a task's texts for each bucket of documents, as compressed Arrow tables."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        table = pa.Table.from_batches(held)
        place = place_of(table["doc"].fill_null(0).to_numpy(), table["key"].to_numpy(), parts)
        order = np.argsort(place, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            sink = pa.BufferOutputStream()
            part = table.take(pa.array(own))
            with pa.ipc.new_stream(sink, part.schema) as w:
                w.write_table(part)
            cell = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([place[own[0]]], pa.int32()), pa.array([cell], pa.binary()), pa.nulls(1, pa.binary())], ["bucket", "docs", "spans"])

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            held.append(whole.slice(at, 500))
            size += sum(len(x.as_buffer()) for x in held[-1].column(3))
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def cut_out(t: pa.Table, keep_text: bool) -> pa.Table:
    load = zstandard.ZstdDecompressor().decompress
    spans: dict[tuple, list[tuple]] = {}
    for r in t.select(["docs", "spans"]).to_pylist():
        if r["spans"] is not None:
            docs, keys, n = np.frombuffer(load(r["docs"]), "<i8").reshape(3, -1).tolist()
            begin, size = np.frombuffer(load(r["spans"]), "<i8").reshape(2, -1)
            ends = np.cumsum(n).tolist()
            for doc, key, x, y in zip(docs, keys, [0, *ends[:-1]], ends, strict=True):
                spans.setdefault((doc, key), []).append((begin[x:y], size[x:y]))
    tables = []
    for cell, runs_cell in zip(t["docs"], t["spans"], strict=True):
        if runs_cell.is_valid:
            continue
        block = pa.ipc.open_stream(load(cell.as_buffer())).read_all()
        out: list[list] = [[] for _ in range(6)]
        for body, doc, key in zip(block["body"], block["doc"].to_pylist(), block["key"].to_pylist(), strict=True):
            own = body.as_buffer()
            digest, left, runs, gone, end = hashlib.sha256(), [], [], 0, 0
            if (doc, key) in spans:
                for x, y in zip(*(v.tolist() for v in cover(*(np.concatenate(v) for v in zip(*spans[doc, key], strict=True)))), strict=True):
                    digest.update(own[end:x])
                    left.append(bytes(own[end:x]) if keep_text else b"")
                    runs.append({"start": x, "end": y})
                    gone, end = gone + y - x, y
            digest.update(own[end:])
            left.append(bytes(own[end:]) if keep_text else b"")
            for to, v in zip(out, (len(own), gone, len(runs), digest.hexdigest(), runs, b"".join(left)), strict=True):
                to.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
        n = 6 if keep_text else 4
        tables.append(pa.table([block["id"], *[pa.array(v, x) for v, x in zip(out, types, strict=True)][:n]], names=["id", *names[:n]]))
    return pa.concat_tables(tables)


def oracle() -> str:
    """DuckDB SQL for the query over distinct ids: every string of 50 bytes, in hexadecimal, by brute force."""
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(h, '.{1,512}') AS parts FROM d)),
p AS (SELECT doc_id, k, length(c) // 2 AS own, c || coalesce(lead(c) OVER (PARTITION BY doc_id ORDER BY k), '') AS s FROM c),
w AS (SELECT doc_id, k * 256 + i AS pos, substr(s, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(own)) AS i FROM p)),
f AS (SELECT g, min(doc_id) AS first FROM w WHERE length(g) = 100 GROUP BY g),
hit AS (SELECT doc_id, pos FROM w JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS e FROM r GROUP BY doc_id, run),
pieces AS (SELECT doc_id, e AS pos, substr(h, 2 * e + 1, 2 * (coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(h) // 2) - e)) AS piece FROM runs JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, -1, substr(h, 1, 2 * coalesce(a, length(h) // 2)) FROM d LEFT JOIN (SELECT doc_id, min(a) AS a FROM runs GROUP BY doc_id) m USING (doc_id)),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS kept FROM pieces GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - a) AS n, count(*) AS s FROM runs GROUP BY doc_id) x USING (doc_id)"""
