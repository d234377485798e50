"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Three levels of Chinese restaurants: one for each two words before, their parents for each word before, and the root, over a base
distribution that gives ``unknown`` of its mass to the one symbol for words never seen and shares out the rest evenly. A word's
customers sit at tables; each table is a customer of the parent. Gibbs sweeps seat all customers of a word in a restaurant anew, at a
number of tables drawn at once; the predictive probability of a token is averaged over the sweeps after the burn-in.

Restaurants are dealt into buckets by the word before, so that one is whole in a bucket, with its children. A word before that is too
frequent for that is hot: its children are dealt by both words, and its own entries are seated with the root. The root is dealt into
parts by word: in a sweep a bucket writes to the parts how many customers it sends for each word, and the parts' answers, customers and
tables of the bucket's words, go back to it. Which words are hot is found on a sample and changes where things are counted, not what.
Texts are scored where the restaurants are: a task's block of documents is sent as postings by bucket, a bucket holding very frequent
pairs of words is split by block, and its sums return to the block; tokens whose word the bucket has not seen go by the parts first.
The corpus's counts are never in one place.

Words are told apart by 64-bit hashes. A null text is empty: it has the end token only. Documents without an id are scored like
others; repeated rows count as often as they occur and get equal scores; extra columns are ignored; an empty table gives an
empty one. If there is nothing to train from, all words are unknown.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BYTES_LOWER, discard, settle, stored, text_of, tidy
from .repeats import mix

#: Bits of a word in the number of a context of two: the word before, then the one before that.
BITS2 = 64
#: Text bytes for each bucket, tokens of a block of documents, and bytes that are hashed at once.
BUCKET, TOKENS, PIECE = 8_000_000, 2_000_000, 250_000
#: Words of the sample, the most frequent ones, that blocks name by their place among them and not by their hash.
COMMON = 1 << 18
#: A word before with more than this share of a usual bucket is hot; at least so many bytes, or this share of the text, are looked at.
HOT, LOOK, SHARE = 0.5, 8_000_000, 1 / 64
_K = 0x9E3779B97F4A7C15
_KINV = pow(_K, -1, 1 << 64)
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_K))
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray, kind: str, delta: bool = False) -> bytes:
    """An array's cell: differences if asked, the bytes of one place together, as many places as the numbers have, compressed."""
    x = np.ascontiguousarray(np.asarray(x).astype(kind))
    if delta:
        step = x.copy()
        step[1:] -= x[:-1]
        x = step
    width = x.itemsize if x.dtype.kind == "f" else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw, places = x.view("u1").reshape(-1, x.itemsize), np.empty((width, len(x)), "u1")
    for k in range(width):
        places[k] = raw[:, k]
    return bytes([width]) + _ZIP.compress(places)


def load(cell: bytes, kind: str, delta: bool = False) -> np.ndarray:
    places = np.frombuffer(_UNZIP.decompress(memoryview(cell)[1:]), "u1").reshape(cell[0], -1)
    raw = np.zeros((places.shape[1], np.dtype(kind).itemsize), "u1")
    for k, place_k in enumerate(places):
        raw[:, k] = place_k
    x = raw.view(kind).ravel()
    return np.cumsum(x, dtype=kind) if delta else x


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            step = np.full(n, _K, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step)
            step = np.full(n, _KINV, np.uint64)
            step[0] = 1
            self.down = np.cumprod(step)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token, document), in order; every text ends with the end token."""
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined.translate(BYTES_LOWER), np.uint8)
        self.powers(len(buf))
        inner = ~_SPACE[buf]
        edge = np.diff(inner.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[buf] * self.up[: len(buf)])])
        words = mix((sums[ends] - sums[starts]) * self.down[starts])
        doc_ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(doc_ends, starts, side="right")
        n = np.bincount(doc, minlength=len(texts)) + 1
        at = np.cumsum(n)
        out = np.empty(int(at[-1]), np.uint64)
        out[np.arange(len(words)) + doc] = words
        out[at - 1] = END
        return out, np.repeat(np.arange(len(texts)), n)


def _grouped(batches, column: int, most: int):
    """(rows, texts): consecutive rows, whose texts have about ``most`` bytes or are one long text."""
    rows, texts, size = [], [], 0
    for b in batches:
        for i, t in enumerate(b.column(column)):
            body = bytes(t.as_buffer()) if t.is_valid else b""
            rows.append((b, i))
            texts.append(body)
            size += len(body) + 1
            if size >= most:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


# dealing tokens into buckets


def home(one: np.ndarray, two: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context whose word before is hot: by both words."""
    return mix(two + one * np.uint64(_K)) % np.uint64(buckets)


def place(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is among the ordered ones, -1 if it isn't."""
    if not len(ordered):
        return np.full(len(values), -1)
    if min(len(ordered), len(values)) > 20_000:  # many are found sooner in order
        by = np.argsort(values)
        at = np.empty(len(values), np.int64)
        at[by] = np.searchsorted(ordered, values[by])
    else:
        at = np.searchsorted(ordered, values)
    at = np.minimum(at, len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def ordering(x: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers from 0 to ``most``: they are sorted with their places in the low bits, if there is room for these."""
    bits = len(x).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.argsort(x, kind="stable")
    x = x.astype(np.int64) << bits
    x |= np.arange(len(x))
    x.sort()
    x &= (1 << bits) - 1
    return x


def by_three(one: np.ndarray, two: np.ndarray, word: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of threes of v words by the word before, the one before that, the word; starts and lengths of runs of equal ones there."""
    key = one * np.int64(v) + two
    order = ordering(key, v * v)
    key = key[order]
    pair = np.cumsum(np.concatenate([np.zeros(min(1, len(key)), bool), key[1:] != key[:-1]]), dtype=np.int64)
    key = pair * v + word[order]
    del pair
    last = ordering(key, max(1, len(key)) * v)
    key, order = key[last], order[last]
    return order, *runs(key)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each there."""
    found = pa.array(x).dictionary_encode()
    own = found.dictionary.to_numpy()
    order = np.argsort(own)
    number = np.empty(len(own), np.int32)
    number[order] = np.arange(len(own), dtype=np.int32)
    return own[order], number[found.indices.to_numpy()]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return head, np.diff(np.append(head, len(ordered)))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, n of them."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def deal(token: np.ndarray, doc: np.ndarray, buckets: int, hot: np.ndarray, common: np.ndarray):
    """(bucket, words, places of the common ones, word before, the one before that, word, times, documents) of a block.

    The three are places in words, ordered by context and word. Common words come first, the most frequent ones ahead."""
    own, word = coded(token)
    del token
    by, named = common_first(own, common)
    number = np.empty(len(own), np.int32)
    number[by] = np.arange(len(own), dtype=np.int32)
    word, doc = number[word], doc.astype(np.int32)
    v = len(own) + 1
    own = np.append(own[by], START)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    one, two = np.empty_like(word), np.empty_like(word)
    one[1:] = word[:-1]
    one[first] = v - 1
    two[1:] = one[:-1]
    two[first] = v - 1
    order, head, times = by_three(one, two, word, v)
    at = order[head]
    one, two, word, doc = one[at], two[at], word[at], doc[order]
    del order, at
    bucket = (own % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)[one]
    warm = np.flatnonzero((place(hot, own) >= 0)[one])
    bucket[warm] = home(own[one[warm]], own[two[warm]], buckets)
    by = np.argsort(bucket, kind="stable")
    cuts, n = runs(bucket[by])
    seen, number = np.zeros(v, bool), np.empty(v, np.int32)
    for a, n_a in zip(cuts.tolist(), n.tolist(), strict=True):
        e = by[a : a + n_a]
        three = one[e], two[e], word[e]
        for x in three:
            seen[x] = True
        used = np.flatnonzero(seen)
        number[used] = np.arange(len(used))
        seen[used] = False
        yield int(bucket[e[0]]), own[used], named[used[: np.searchsorted(used, len(named))]], *(number[x] for x in three), times[e], doc[ranges(head[e], times[e])]


def common_first(words: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of words, the common ones first and as ``common`` has them; the places of these there."""
    by = np.argsort(common)
    at = place(common[by], words)
    known = np.flatnonzero(at >= 0)
    named = by[at[known]]
    order = np.argsort(named)
    return np.concatenate([known[order], np.flatnonzero(at < 0)]), named[order]


def word_cells(words: np.ndarray, named: np.ndarray) -> list[bytes]:
    """Words of which the first are common: the places of these, hashes of the others."""
    return [pack(named, "<u4", True), pack(words[len(named) :], "<u8", True)]


def load_words(cells: list[bytes], common: np.ndarray) -> np.ndarray:
    return np.concatenate([common[load(cells[0], "<u4", True)], load(cells[1], "<u8", True)])


def entry_cells(words, named, one, two, word, times) -> list[bytes]:
    return [*word_cells(words, named), pack(one, "<u4", True), pack(two, "<u4"), pack(word, "<u4"), pack(times, "<u4")]


#: Cells of :func:`entry_cells`.
ENTRY = 6


def load_entries(cells: list[bytes]) -> tuple[np.ndarray, ...]:
    """Places of the common words, hashes of the others, and the entries."""
    return load(cells[0], "<u4", True), load(cells[1], "<u8", True), *(load(c, "<u4", i == 0).view(np.int32) for i, c in enumerate(cells[2:ENTRY]))


def union(named: list[np.ndarray], others: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All words of blocks in order, and the places there of each block's."""
    met = np.zeros(len(common), bool)
    for x in named:
        met[x] = True
    met = np.flatnonzero(met)
    words = np.sort(np.concatenate([common[met], *others]))
    words = words[runs(words)[0]]
    at = np.empty(len(common), np.int32)
    at[met] = place(words, common[met])
    return words, [np.concatenate([at[x], np.searchsorted(words, y).astype(np.int32)]) for x, y in zip(named, others, strict=True)]


def in_batches(rows, schema: pa.Schema, most: int = 1_000_000):
    """Batches of rows, whose last column has cells, of about ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r[-1]))
        if size >= most:
            yield from table(held, schema).to_batches()
            held, size = [], 0
    if held:
        yield from table(held, schema).to_batches()


#: A bucket's seating, its letter to a part, the answer to it, what a part keeps, and a bucket's words; ``sweep`` is -1 for counts.
STATE, LETTER, ANSWER, PART, LOOKUP = range(5)
ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("sweep", pa.int32()), ("cells", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
COUNTED = pa.schema([("bucket", pa.int32()), ("cells", pa.list_(pa.binary()))])
ROWS = "kind int, bucket int, part int, sweep int, cells array<binary>, sums array<bigint>"


def table(rows: list[tuple], schema: pa.Schema = ROW) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def lean(run):
    """The function of a group's table; the worker gives large arrays back when they are freed, and other free memory after it."""

    def leaned(t: pa.Table) -> pa.Table:
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which glibc would raise
        except (AttributeError, OSError):  # not glibc
            pass
        return next(tidy(lambda one: iter([run(one)]))(t))

    return leaned


def frequent(batches):
    """Rows (word, n) of a sample's words before, by task."""
    words = Words()
    for _, texts in _grouped(batches, 0, PIECE):
        token, doc = words(texts)
        token = np.append(token[:-1][doc[1:] == doc[:-1]], np.full(len(texts), START))
        own, n = np.unique(token, return_counts=True)
        own, n = np.append(own, np.uint64(0)), np.append(n, len(token))  # the number of all stands at 0
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n)], ["word", "n"])


def joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and documents of a block, whose pieces (texts, token, document) are taken out."""
    base, n = [], 0
    for texts, *_ in held:
        base.append(n)
        n += texts
    token, doc = np.concatenate([h[1] for h in held]), np.concatenate([(h[2] + b).astype(np.int32) for h, b in zip(held, base, strict=True)])
    held.clear()
    return token, doc


def count_blocks(batches, buckets: int, hot: np.ndarray, common: np.ndarray):
    """Rows (bucket, cells) of a task's training texts."""
    words, held, waiting = Words(), [], 0

    def flush():
        yield from in_batches(((bucket, entry_cells(*entries)) for bucket, *entries, _ in deal(*joined(held), buckets, hot, common)), COUNTED)

    for _, texts in _grouped(batches, 0, PIECE):
        held.append((len(texts), *words(texts)))
        waiting += len(held[-1][1])
        if waiting >= TOKENS:
            yield from flush()
            waiting = 0
    if held:
        yield from flush()


def merge_counts(t: pa.Table, parts: int, hot: np.ndarray, common: np.ndarray) -> pa.Table:
    """A bucket's state and its letters with counts; tokens, and how many have been counted once or twice at the lower levels."""
    loaded = [load_entries(c) for c in t["cells"].to_pylist()]
    words, at = union([x[0] for x in loaded], [x[1] for x in loaded], common)
    v = len(words)
    one, two, word = (np.concatenate([to[x[i]] for to, x in zip(at, loaded, strict=True)]) for i in (2, 3, 4))
    times = np.concatenate([x[5] for x in loaded])
    del loaded, at
    order, head, _ = by_three(one, two, word, v)
    count = np.add.reduceat(times[order].astype(np.int64), head)
    one, two, word = (x[order[head]] for x in (one, two, word))
    del times, order, head
    start, n = runs(one * np.int64(v) + two)  # ordered
    context = np.repeat(np.arange(len(start)), n)
    before, two = one[start], two[start]
    key = one * np.int64(v) + word
    lower = ordering(key, v * v)
    start, n2 = runs(key[lower])
    del key
    word, one, context, count = word[lower][start], one[lower][start], context[lower], count[lower]
    start, n1 = runs(one)
    own = one[start]
    nx = np.bincount(np.searchsorted(own, before), minlength=len(own))
    context -= np.repeat((np.cumsum(nx) - nx), n1)[np.repeat(np.arange(len(word)), n2)]
    slots = np.flatnonzero(np.bincount(word, minlength=v))
    number = np.empty(v, np.int64)
    number[slots] = np.arange(len(slots))
    seats = [pack(n1, "<u4"), pack(nx, "<u4"), pack(number[word], "<u4", True), pack(n2, "<u4"), pack(context, "<u4"), pack(count, "<u4")]
    seats += [pack(place(hot, words[own]) + 1, "<u4"), pack(mix(words[slots]) % np.uint64(parts), "<u4")]
    bucket = t["bucket"][0].as_py()
    g = Group(seats)
    cold, warm = g.hot1 < 0, g.hot1 >= 0
    once = [int((x == k).sum()) for x in (n2[cold], count) for k in (1, 2)]
    total = np.bincount(g.up2, count, len(word)).astype(np.int64)
    sent = [np.bincount(g.up1[cold], x, len(slots)) for x in (total[cold], np.ones(cold.sum()))]
    letters = []
    for p, mine, own_p, at in g.dealt():
        at = at[own_p]
        named = [pack(words[slots[mine]], "<u8", True), pack(np.searchsorted(mine, g.up1[at]), "<u4"), pack(g.hot1[at], "<u4")]
        values = [pack(x, "<u4") for x in (*(y[mine] for y in sent), total[at], n2[at])]
        letters.append((LETTER, bucket, p, -1, [*named, *values], None))
    none = pack(np.zeros(0), "<u4")
    by, named = common_first(words, common)
    look = [*word_cells(words[by], named), pack(own, "<u4", True), pack(two, "<u4", True), pack(slots, "<u4", True)]
    return table([(STATE, bucket, -1, -1, [*seats, none, none], [int(count.sum()), *once]), (LOOKUP, bucket, -1, -1, look, None), *letters])


# seating


def chance(discount: float, strength: float, c, t, customers, tables, parent):
    """A word's predictive probability in a restaurant."""
    return (c - discount * t + (strength + discount * tables) * parent) / (strength + customers)


@dataclass
class Totals:
    """Customers and tables of restaurants by level and context; discounts, strengths, words and tokens.

    Tasks get those of the root and of hot words before, by their number; others are in the buckets. :attr:`Model.totals` finds them there.
    """

    customers: list
    tables: list
    discount: list[float]
    strength: list[float]
    v: int
    tokens: int
    unknown: float

    def known(self) -> float:
        return (1 - self.unknown) / max(1, self.v)

    def chance(self, level: int, ctx, c, t, parent):
        return chance(self.discount[level], self.strength[level], c, t, self.customers[level][ctx], self.tables[level][ctx], parent)


class Group:
    """Entries of a bucket: (word before, word) at level 1, in order, and within these by the word before that at level 2.

    ``up2`` is a level 2 entry's entry at level 1, ``up1`` that one's slot, a word that occurs; ``part`` is where a slot's word is.
    ``at1`` and ``at2`` are the entries' contexts, ``hot`` and ``hot1`` the number of a hot word before or -1. With a lookup row
    there are ``words`` and, as places among them, the ``slots``, the words before (``own``) and those before these (``two``).
    """

    def __init__(self, seats: list[bytes], look: list[bytes] | None = None, common: np.ndarray | None = None) -> None:
        n1, self.nx, up1, n2, context, c2, hot, part = (load(c, "<u4", i == 2).astype(np.int32) for i, c in enumerate(seats[:8]))
        self.up1, self.part = up1, part
        self.at1 = np.repeat(np.arange(len(n1), dtype=np.int32), n1)
        self.up2 = np.repeat(np.arange(len(n2), dtype=np.int32), n2)
        self.at2, self.c2 = context + (np.cumsum(self.nx) - self.nx).astype(np.int32)[self.at1][self.up2], c2.astype(np.int64)
        self.hot = hot.astype(np.int64) - 1
        self.hot1 = self.hot[self.at1]
        self.n = [len(part), len(up1), len(c2)]
        self.contexts = [1, len(n1), int(self.nx.sum())]
        if look:
            self.words = np.sort(load_words(look, common))
            self.own, self.two, self.slots = (load(c, "<u4", True).astype(np.int64) for c in look[2:5])
            self.word = self.slots[self.up1]

    def dealt(self):
        """For each part the slots and the hot entries whose words are there."""
        warm = np.flatnonzero(self.hot1 >= 0)
        warm_of, most = self.part[self.up1[warm]], int(self.part.max(initial=0))
        slots, own = ordering(self.part, most), ordering(warm_of, most)
        start, n = runs(self.part[slots])
        found = self.part[slots[start]]
        low, high = (np.searchsorted(warm_of[own], found, side=x) for x in ("left", "right"))
        for p, i, n_p, a, b in zip(*(x.tolist() for x in (found, start, n, low, high)), strict=True):
            yield p, slots[i : i + n_p], own[a:b], warm

    def answers(self, rows: list[dict]) -> list[np.ndarray]:
        """What the parts answered, for all slots and all hot entries."""
        cells = {r["part"]: r["cells"] for r in rows}
        n = len(next(iter(cells.values()))) // 2
        out = [np.zeros(self.n[0], np.int64) for _ in range(n)] + [np.zeros(int((self.hot1 >= 0).sum()), np.int64) for _ in range(n)]
        for p, mine, own, _ in self.dealt():
            for i, cell in enumerate(cells[p]):
                out[i][mine if i < n else own] = load(cell, "<u4")
        return out

    def restaurants(self, totals: Totals, c1, t1, t2) -> list[np.ndarray]:
        """Customers and tables of contexts at level 1, then at level 2."""
        out = [np.bincount(at, x, n) for at, n, both in ((self.at1, self.contexts[1], (c1, t1)), (self.at2, self.contexts[2], (self.c2, t2))) for x in both]
        warm = self.hot >= 0
        out[0][warm], out[1][warm] = totals.customers[1][self.hot[warm]], totals.tables[1][self.hot[warm]]
        return out

    def seated(self, totals: Totals, t1, t2, answer: list[np.ndarray]) -> tuple:
        """Level 1 customers and tables with the hot ones, root and level 1 probabilities, restaurants."""
        c0, t0, warm_c, warm_t = answer
        warm = self.hot1 >= 0
        c1 = np.bincount(self.up2, t2, self.n[1]).astype(np.int64)
        t1 = t1.copy()
        c1[warm], t1[warm] = warm_c, warm_t
        rest = self.restaurants(totals, c1, t1, t2)
        p0 = totals.chance(0, 0, c0, t0, totals.known())
        p1 = chance(totals.discount[1], totals.strength[1], c1, t1, rest[0][self.at1], rest[1][self.at1], p0[self.up1])
        return c1, t1, p0, p1, rest


#: Entries of at most as many customers have their tables drawn from exact numbers of seatings.
EXACT = 1024
_FALL = np.concatenate([np.geomspace(1e-9, 1, 4000), np.linspace(1.001, 700, 60_000)])


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.asarray(n, np.float64) + 8
    return x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) - sum(np.log(x - k) for k in range(8))


@functools.lru_cache(maxsize=4)
def seatings(discount: float) -> np.ndarray:
    """In row c, column t the log of the number of seatings of c customers at t tables, each weighed by its sizes."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    taken = discount * np.arange(EXACT + 1)
    for c in range(1, EXACT):
        stay = out[c, 1 : c + 1] + np.log(c - taken[1 : c + 1])
        out[c + 1, 1 : c + 1] = np.logaddexp(stay, out[c, :c])
        out[c + 1, c + 1] = 0
    return out


@functools.lru_cache(maxsize=4)
def _logs(discount: float) -> np.ndarray:
    return _ratio(_FALL, discount)


def _ratio(s: np.ndarray, d: float) -> np.ndarray:
    """Log of customers a table at the point 1 - exp(-s)."""
    return math.log(d) + np.log(-np.expm1(-s)) + (1 - d) * s - np.log(-np.expm1(-d * s))


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The entry of :func:`seatings` for t < c by the saddle point of the generating function (1 - (1 - x)**d) / d to the power of t."""
    want = np.log(c / t)
    s = np.maximum(np.interp(want, _logs(d), _FALL), 1e-9)
    slope = lambda s: (1 - d) + np.exp(-s) / -np.expm1(-s) - d * np.exp(-d * s) / -np.expm1(-d * s)
    for _ in range(3):
        s = np.maximum(s - (_ratio(s, d) - want) / slope(s), 1e-9)
    x = -np.expm1(-s)
    spread = np.log(c / t * slope(s) * x) + s
    logs = log_factorial(c) - log_factorial(t) + t * (np.log(-np.expm1(-d * s)) - math.log(d)) - c * np.log(x)
    return logs - 0.5 * (np.log(2 * np.pi * t) + spread) - 1 / (12 * (c - t))


@functools.lru_cache(maxsize=4)
def _missed(discount: float) -> np.ndarray:
    """What the saddle point lacks in the last row of :func:`seatings`, by t; it tends to a constant as customers grow."""
    t = np.arange(1, EXACT // 2)
    out = np.zeros(EXACT // 2)
    out[1:] = seatings(discount)[EXACT, 1 : EXACT // 2] - _saddle(np.full(len(t), float(EXACT)), t, discount)
    return out


def _chosen(logs: np.ndarray, rng) -> np.ndarray:
    """A column of each row, drawn by the weights whose logs are given."""
    sums = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return (sums < (rng.random(len(sums)) * sums[:, -1])[:, None]).sum(axis=1)


def _expected(c: np.ndarray, fresh: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation, about, of the numbers of tables: tables of each size are Poisson, given their customers' sum."""
    s = np.interp(np.log(c / fresh), _FALL * (1 - d) + np.log(-np.expm1(-_FALL)), _FALL)
    mean = -np.expm1(-d * s) * fresh / d
    spread = c * (1 + (1 - d) * np.expm1(s))
    return mean, np.sqrt(np.maximum(mean - c / (spread / c), 1))


def draw_tables(target: np.ndarray, fresh: np.ndarray, discount: float, rng) -> np.ndarray:
    """How many tables the customers of each entry sit at, drawn given all but the entry's own seating.

    The chance of t tables is proportional to ``fresh`` ** t times the weighed number of seatings, which is where reseating customers
    one by one would lead. Up to ``EXACT`` customers the numbers are exact, beyond by the saddle point, corrected by the last exact ones.
    """
    count = np.minimum(target, 1)
    order = np.flatnonzero(target > 1)
    order = order[np.argsort(target[order], kind="stable")]
    logs = np.log(np.maximum(fresh[order], 1e-300))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(target[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        c = int(target[order[a]])
        if c > EXACT:
            break
        row, step = seatings(discount)[c, 1 : c + 1], max(1, 500_000 // c)
        for i in range(a, b, step):
            own = order[i : min(b, i + step)]
            count[own] = 1 + _chosen(row + logs[i : min(b, i + step), None] * np.arange(1, c + 1), rng)
    first = np.searchsorted(target[order], EXACT + 1)
    large, logs = order[first:], dict(zip(order[first:].tolist(), logs[first:].tolist(), strict=True))
    for i, mean, spread in zip(large.tolist(), *_expected(target[large].astype(np.float64), np.maximum(fresh[large], 1e-300), discount), strict=True):
        c = int(target[i])
        low, high = max(1, int(mean - 9 * spread) - 30), min(c, int(mean + 9 * spread) + 30)
        t = np.arange(low, high + 1)
        row = np.zeros(len(t))  # at as many tables as customers there is one seating
        row[t < c] = _saddle(np.full((t < c).sum(), float(c)), t[t < c], discount)
        known = t < EXACT // 2
        row[known] += _missed(discount)[t[known]]
        count[i] = low + _chosen((row + logs[i] * t)[None, :], rng)[0]
    return count


class Tables:
    """How many customers and tables each of many (restaurant, word) entries has; made of tables' sizes in order of their owners."""

    def __init__(self, owner: np.ndarray, size: np.ndarray, n: int) -> None:
        self.customers, self.count = np.bincount(owner, size, n).astype(np.int64), np.bincount(owner, minlength=n)

    @classmethod
    def of(cls, customers: np.ndarray, count: np.ndarray) -> Tables:
        out = cls.__new__(cls)
        out.customers, out.count = customers, count
        return out

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def sweep(self, target: np.ndarray, fresh: np.ndarray, discount: float, rounds: int, rng) -> Tables:
        """Seats as many customers as ``target`` says, all of them anew; a draw doesn't depend on the one before, so one is as good as ``rounds``."""
        return first_tables(target, fresh, discount, rng)


def first_tables(target: np.ndarray, fresh: np.ndarray, discount: float, rng) -> Tables:
    return Tables.of(target, draw_tables(target, fresh, discount, rng))


def part_entries(rows: list[dict]):
    """Words of a part's letters; for each letter its words' places and its hot entries' numbers, (word, hot number) in order of ``keys``."""
    words = [load(r["cells"][0], "<u8", True) for r in rows]
    own = np.unique(np.concatenate(words))
    at = [np.searchsorted(own, w) for w in words]
    keys = [a[load(r["cells"][1], "<u4")] << 32 | load(r["cells"][2], "<u4").astype(np.int64) for a, r in zip(at, rows, strict=True)]
    known = np.unique(np.concatenate(keys))
    return own, at, known, [np.searchsorted(known, k) for k in keys]


def gathered(rows: list[dict], cell: int, at: list[np.ndarray], n: int) -> np.ndarray:
    return np.bincount(np.concatenate(at), np.concatenate([load(r["cells"][cell], "<u4") for r in rows]), n).astype(np.int64)


def part_counts(t: pa.Table, hot: int) -> pa.Table:
    """A part's answers to the counts, what it keeps, sums (words, kinds counted once or twice, hot words' first tables), and for the sweeps where each bucket's words and hot entries are."""
    rows = t.to_pylist()
    own, at, keys, hot_at = part_entries(rows)
    count, kinds = gathered(rows, 3, at, len(own)), gathered(rows, 4, at, len(own))
    warm, warm_kinds = gathered(rows, 5, hot_at, len(keys)), gathered(rows, 6, hot_at, len(keys))
    count += np.bincount(keys >> 32, warm, len(own)).astype(np.int64)
    kinds += np.bincount(keys >> 32, minlength=len(own))
    sums = [len(own), *(int((x == k).sum()) for x in (kinds, warm_kinds) for k in (1, 2)), *np.bincount(keys & 0xFFFFFFFF, minlength=hot).tolist()]
    out = [(ANSWER, r["bucket"], r["part"], -1, [pack(count[a], "<u4"), pack(warm[b], "<u4")], None) for r, a, b in zip(rows, at, hot_at, strict=True)]
    part = rows[0]["part"]
    out += [(LETTER, r["bucket"], part, -1, [pack(a, "<u4", True), pack(b, "<u4")], None) for r, a, b in zip(rows, at, hot_at, strict=True)]
    out.append((LETTER, -1, part, -1, [pack(np.array([len(own)]), "<u4"), pack(keys, "<u8", True)], None))
    return table([*out, (PART, -1, part, -1, [pack(own, "<u8", True), pack(count, "<u4")], sums)])


def part_sweep(t: pa.Table, totals: Totals) -> pa.Table:
    """Seats the root's customers of a part's words, and before these those of hot words before; sums are the new totals."""
    rows = t.to_pylist()
    part, sweep = rows[0]["part"], max(r["sweep"] for r in rows)
    rows.sort(key=lambda r: (r["sweep"], r["bucket"]))
    rows, (first, *named) = rows[len(rows) // 2 + 1 :], rows[: len(rows) // 2 + 1]
    rng = np.random.default_rng([part, sweep, 1])
    n_own, keys = int(load(first["cells"][0], "<u4")[0]), load(first["cells"][1], "<u8", True).astype(np.int64)
    at, hot_at = [load(r["cells"][0], "<u4", True).view(np.int32) for r in named], [load(r["cells"][1], "<u4").view(np.int32) for r in named]
    c0, c1 = gathered(rows, 0, at, n_own), gathered(rows, 1, hot_at, len(keys))
    prior, number = np.zeros(len(keys)), keys & 0xFFFFFFFF
    for r, b in zip(rows, hot_at, strict=True):
        prior[b] = load(r["cells"][2], "<f8")
    t1 = draw_tables(c1, (totals.strength[1] + totals.discount[1] * totals.tables[1][number]) * prior, totals.discount[1], rng)
    c0 += np.bincount(keys >> 32, t1, n_own).astype(np.int64)
    fresh = 1e-6 if sweep == 0 else (totals.strength[0] + totals.discount[0] * float(totals.tables[0][0])) * totals.known()
    t0 = draw_tables(c0, np.full(n_own, fresh), totals.discount[0], rng)
    n = len(totals.tables[1])
    sums = [int(c0.sum()), int(t0.sum()), *(int(x) for y in (c1, t1) for x in np.bincount(number, y, n))]
    out = [(ANSWER, r["bucket"], part, sweep, [*(pack(x[a], "<u4") for x in (c0, t0)), *(pack(x[b], "<u4") for x in (c1, t1))], None) for r, a, b in zip(rows, at, hot_at, strict=True)]
    kept = [b"", pack(c0, "<u4"), pack(t0, "<u4"), pack(keys, "<u8", True), pack(c1, "<u4"), pack(t1, "<u4")]
    return table([*out, (PART, -1, part, sweep, kept, sums)])


def bucket_sweep(t: pa.Table, totals: Totals, sweep: int, keep: bool, last: bool = False) -> pa.Table:
    """A bucket's next seating, and its letters; with ``keep`` the seating becomes a sample, and is only that in the last sweep."""
    rows = t.to_pylist()
    state = next(r for r in rows if r["kind"] == STATE)
    bucket, cells = state["bucket"], state["cells"]
    rng = np.random.default_rng([bucket, sweep])
    g = Group(cells)
    answer = g.answers([r for r in rows if r["kind"] == ANSWER])
    del rows, state
    warm = g.hot1 >= 0
    cold = ~warm
    if sweep:
        t1, t2 = (load(c, "<u4").astype(np.int64) for c in cells[8:10])
        _, _, p0, p1, rest = g.seated(totals, t1, t2, answer)
    else:
        p0 = answer[0] / max(1, totals.tokens)
        p1 = p0[g.up1]
        rest = g.restaurants(totals, np.zeros(g.n[1]), np.ones(g.n[1]), np.ones(g.n[2]))
    strength, discount = totals.strength, totals.discount
    t2, many = np.minimum(g.c2, 1), np.flatnonzero(g.c2 > 1)
    t2[many] = draw_tables(g.c2[many], (strength[2] + discount[2] * rest[3])[g.at2[many]] * p1[g.up2[many]], discount[2], rng)
    c1 = np.bincount(g.up2, t2, g.n[1]).astype(np.int64)
    t1 = np.zeros(len(c1), np.int64)
    t1[cold] = draw_tables(c1[cold], (strength[1] + discount[1] * rest[1])[g.at1[cold]] * p0[g.up1[cold]], discount[1], rng)
    now = [pack(t1, "<u4"), pack(t2, "<u4")]
    sent, warm_sent, prior = np.bincount(g.up1[cold], t1[cold], g.n[0]), c1[warm], p0[g.up1[warm]]
    letters = [(LETTER, bucket, p, sweep, [pack(sent[mine], "<u4"), pack(warm_sent[own], "<u4"), pack(prior[own], "<f8")], None) for p, mine, own, _ in g.dealt()]
    return table([(STATE, bucket, -1, sweep, [*cells[:8], *([b""] * 2 if last else now), *cells[10:], *now * keep], None), *letters])


class Bucket:
    """Words of a part with their entries at each level: (word, context of two), (word, context of one), word.

    A context of two is the word before times 2 ** BITS2 plus the one before that, as Python's numbers.
    """

    def __init__(self, row: dict) -> None:
        self.words = load(row["words"], "<u8", True)
        n1, n2 = load(row["n"], "<u4"), load(row["n1"], "<u4")
        one, two = (load(row[x], "<u8").astype(object) for x in ("ctx1", "ctx2"))
        self.up1, self.up2 = np.repeat(np.arange(len(n1)), n1), np.repeat(np.arange(len(n2)), n2)
        self.ctx1 = one
        self.ctx2 = np.array([(a << BITS2) + b for a, b in zip(one[self.up2], two, strict=True)], object)
        self.key1 = np.arange(len(one))
        self.c2 = load(row["count"], "<u4").astype(np.int64)

    def chances(self, t: Totals, c0, t0, c1, t1) -> tuple[np.ndarray, np.ndarray]:
        p0 = t.chance(0, 0, c0, t0, t.known())
        return p0, t.chance(1, self.ctx1, c1, t1, p0[self.up1]).astype(float)


WORDS = "bucket int, words binary, n binary, n1 binary, ctx1 binary, ctx2 binary, count binary, samples array<binary>"


def both_rows(t: pa.Table, common: np.ndarray) -> tuple[Group, list[bytes], int]:
    """A bucket by its seating and its lookup row; the seating's cells."""
    rows = {r["kind"]: r for r in t.to_pylist()}
    return Group(rows[STATE]["cells"], rows[LOOKUP]["cells"], common), rows[STATE]["cells"], rows[STATE]["bucket"]


def by_word(t: pa.Table, common: np.ndarray) -> pa.Table:
    """A bucket's entries as rows for each part."""
    g, cells, bucket = both_rows(t, common)
    word, part = g.words[g.word], g.part[g.up1]
    values, out = [load(c, "<u4") for c in cells[10:]], []
    for p in np.unique(part).tolist():
        one, two = part == p, (part == p)[g.up2]
        lower = np.cumsum(one) - 1
        found = [pack(word[one], "<u8"), pack(g.words[g.own[g.at1[one]]], "<u8"), pack(lower[g.up2[two]], "<u4"), pack(g.words[g.two[g.at2[two]]], "<u8"), pack(g.c2[two], "<u4")]
        out.append((STATE, bucket, p, -1, [*found, *(pack(x[(one, two)[i % 2]], "<u4") for i, x in enumerate(values))], None))
    return table(out)


def words_of_part(t: pa.Table, hot: np.ndarray, schema: pa.Schema) -> pa.Table:
    rows = t.to_pylist()
    kept = sorted((r for r in rows if r["kind"] == PART), key=lambda r: r["sweep"])
    own = load(kept[0]["cells"][0], "<u8", True)
    states = [r["cells"] for r in rows if r["kind"] == STATE]
    word, one = (np.concatenate([load(c[i], "<u8") for c in states]) for i in (0, 1))
    two, count = np.concatenate([load(c[3], "<u8") for c in states]), np.concatenate([load(c[4], "<u4") for c in states])
    base = np.cumsum([0] + [len(load(c[0], "<u8")) for c in states])
    lower = np.concatenate([load(c[2], "<u4").astype(np.int64) + b for c, b in zip(states, base, strict=False)])
    at, before = np.searchsorted(own, word), np.unique(one, return_inverse=True)[1]
    key, to = np.unique(at.astype(np.int64) << 32 | before, return_inverse=True)
    names = np.empty(len(key), np.uint64)
    names[to] = one
    order = np.argsort(to[lower], kind="stable")
    samples = []
    for k, r in enumerate(kept[1:]):
        t1, t2 = (np.concatenate([load(c[5 + 2 * k + i], "<u4") for c in states]) for i in (0, 1))
        t1 = np.bincount(to, t1, len(key))
        keys = load(r["cells"][3], "<u8", True).astype(np.int64)
        number = place(hot, names)
        warm = number >= 0
        t1[warm] = load(r["cells"][5], "<u4")[place(keys, (key >> 32 << 32 | number)[warm])]
        samples += [r["cells"][2], pack(t1, "<u4"), pack(t2[order], "<u4")]
    cells = [pack(own, "<u8", True), pack(np.bincount(key >> 32, minlength=len(own)), "<u4"), pack(np.bincount(to[lower], minlength=len(key)), "<u4"), pack(names, "<u8"), pack(two[order], "<u8"), pack(count[order], "<u4")]
    return pa.table([pa.array([x], f.type) for x, f in zip([rows[0]["part"], *cells, samples], schema, strict=True)], schema=schema)


def totals_rows(t: pa.Table, asked: list[int], level: int, sample: int, totals: Totals, schema: pa.Schema, common: np.ndarray) -> pa.Table:
    """Rows (context, customers, tables) of the contexts asked for."""
    g, cells, _ = both_rows(t, common)
    asked = set(asked)
    t1, t2 = (load(c, "<u4").astype(np.int64) for c in cells[10 + 2 * sample : 12 + 2 * sample])
    rest = g.restaurants(totals, np.bincount(g.up2, t2, g.n[1]), t1, t2)[2 * (level - 1) :]
    names = g.words[g.own].tolist()
    if level == 2:
        names = [(a << BITS2) + b for a, b in zip(np.repeat(g.words[g.own], g.nx).tolist(), g.words[g.two].tolist(), strict=True)]
    return table([(str(x), int(c), int(n)) for x, c, n in zip(names, rest[0], rest[1], strict=True) if x in asked], schema)


class Restaurants:
    """Customers or tables of contexts, found in the buckets when asked for."""

    def __init__(self, found: dict, find, which: int) -> None:
        self.found, self.find, self.which = found, find, which

    def __getitem__(self, ctx):
        asked = [int(x) for x in np.atleast_1d(ctx)]
        if missing := {x for x in asked if x not in self.found}:
            self.found.update(dict.fromkeys(missing, (0, 0)) | self.find(sorted(missing)))
        out = np.array([self.found[x][self.which] for x in asked], np.int64)
        return out if np.ndim(ctx) else out[0]


@dataclass
class Model:
    """``groups`` is a table of two rows for each bucket, ``counts`` and ``roots`` have the parts' rows of the counts and of each sample.

    ``split`` says in how many a bucket is scored. For reading, :attr:`state` has the entries by word, :attr:`totals` restaurants by context.
    """

    groups: DataFrame
    counts: DataFrame
    roots: list[DataFrame]
    found: list[Totals]
    buckets: int
    parts: int
    hot: np.ndarray
    common: np.ndarray
    split: dict[int, int]

    @property
    def state(self) -> DataFrame:
        hot, common = self.hot, self.common
        rows = self.groups.groupBy("bucket").applyInArrow(lambda t: by_word(t, common), ROWS)
        for r in (self.counts, *self.roots):
            rows = rows.union(r.filter(F.col("kind") == PART))
        import pyspark.sql.pandas.types as arrow

        schema = arrow.to_arrow_schema(self.groups.sparkSession.createDataFrame([], WORDS).schema)
        return rows.groupBy("part").applyInArrow(lambda t: words_of_part(t, hot, schema), WORDS)

    @functools.cached_property
    def totals(self) -> list[Totals]:
        def places(k: int, level: int):
            t, common, schema = self.found[k], self.common, pa.schema([("ctx", pa.string()), ("customers", pa.int64()), ("tables", pa.int64())])

            def find(asked: list[int]) -> dict:
                rows = self.groups.groupBy("bucket").applyInArrow(lambda x: totals_rows(x, asked, level, k, t, schema, common), "ctx string, customers long, tables long").distinct()
                return {int(r.ctx): (r.customers, r.tables) for r in rows.collect()}

            known: dict = {}
            return Restaurants(known, find, 0), Restaurants(known, find, 1)

        out = []
        for k, t in enumerate(self.found):
            lower = [places(k, level) for level in (1, 2)]
            out.append(Totals([t.customers[0], *(x[0] for x in lower)], [t.tables[0], *(x[1] for x in lower)], t.discount, t.strength, t.v, t.tokens, t.unknown))
        return out


def train(docs: DataFrame, *, text: str = "text", burn_in: int = 1, samples: int = 3, rounds: int = 3, strength: float = 1.0, unknown: float = 0.5, bucket_bytes: int = BUCKET) -> Model:
    """Learn from all rows of ``docs``.

    Of the corpus the driver sees sizes of buckets, sums of parts, and the hot words before with their totals.
    """
    body = docs.select(text_of(text).cast("binary").alias("body"))
    size = docs.agg(F.sum(F.octet_length(text_of(text)).cast("long") + 1)).first()[0] or 0
    buckets = max(8, math.ceil(size / bucket_bytes))
    parts = max(8, math.ceil(buckets / 4))
    hot, common = frequent_words(body, size, buckets)
    counted = body.mapInArrow(tidy(lambda it: count_blocks(it, buckets, hot, common)), "bucket int, cells array<binary>")
    merged = stored(counted.groupBy("bucket").applyInArrow(lean(lambda t: merge_counts(t, parts, hot, common)), ROWS), "counts")
    is_kind = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    sums = lambda df, kind: [r.sums for r in is_kind(df, kind).select("sums").collect()]
    counts = answers = stored(is_kind(merged, LETTER).groupBy("part").applyInArrow(lambda t: part_counts(t, len(hot)), ROWS), "words")
    sizes = is_kind(merged, STATE).select("bucket", F.col("sums")).collect()  # a few numbers a bucket
    lower = np.array([r.sums for r in sizes], np.int64).reshape(-1, 5).sum(axis=0)
    upper = np.array(sums(counts, PART), np.int64).reshape(-1, 5 + len(hot)).sum(axis=0)
    once = [upper[1:3], lower[1:3] + upper[3:5], lower[3:5]]
    discount = [float(np.clip(a / max(1, a + 2 * b), 0.05, 0.95)) for a, b in once]
    v, tokens = int(upper[0]), int(lower[0])
    usual = 2 * max(1, tokens) / buckets
    split = {r.bucket: math.ceil(r.sums[0] / usual) for r in sizes if r.sums[0] > usual}

    def totals(c0: int, t0: int, c1: np.ndarray, t1: np.ndarray) -> Totals:
        return Totals([np.array([c0]), c1], [np.array([t0]), t1], discount, [strength] * 3, v, tokens, unknown)

    def seating(now: Totals, k: int, keep: bool):
        return lean(lambda t: bucket_sweep(t, now, k, keep, keep and k == burn_in + samples))

    def rooting(now: Totals):
        return lean(lambda t: part_sweep(t, now))

    now, found, roots = totals(0, v, np.zeros(len(hot), np.int64), upper[5:]), [], []
    state = merged
    for k in range(1 + burn_in + samples):
        keep = k > burn_in
        both = is_kind(state, STATE).union(is_kind(answers, ANSWER))
        before, state = state, stored(both.groupBy("bucket").applyInArrow(seating(now, k, keep), ROWS), "seating")
        if before is merged:  # its seating isn't kept twice
            looks = stored(is_kind(merged, LOOKUP), "lookup")
            names = stored(is_kind(counts, LETTER), "names")
        discard(before)
        if answers is not counts and not any(answers is r for r in roots):
            discard(answers)
        answers = stored(is_kind(state, LETTER).union(names).groupBy("part").applyInArrow(rooting(now), ROWS), "words")
        s = np.array(sums(answers, PART), np.int64).reshape(-1, 2 + 2 * len(hot)).sum(axis=0)
        now = totals(int(s[0]), int(s[1]), s[2 : 2 + len(hot)], s[2 + len(hot) :])
        if keep:
            found.append(now)
            roots.append(answers)
    discard(names)
    return Model(is_kind(state, STATE).union(looks), counts, roots, found, buckets, parts, hot, common, split)


def frequent_words(body: DataFrame, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before that are too frequent for one bucket, in order, and the common ones, the most frequent first; by a sample."""
    share = max(SHARE, LOOK / max(1, size))
    seen = body if share >= 1 else body.sample(share, seed=7)
    n = seen.mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = n.orderBy(F.col("word") != 0, F.desc("n"), "word").limit(COMMON + 1).toArrow()  # the number of all comes first
    word, n = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    tokens, word, n = n[:1].sum(), word[1:], n[1:]
    return np.sort(word[(n * buckets > tokens * HOT) & (n >= 50)]), word  # at most buckets / HOT are hot


# scoring

#: Rows of a bucket's postings, and of what it returns: a block's documents, sums for a block, tokens for a part of the words.
POST, HEAD, SUMS, AWAY = range(5, 9)
BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("split", pa.int32()), ("part", pa.int32()), ("sweep", pa.int32()), ("block", pa.int64()), ("cells", pa.list_(pa.binary()))])
BLOCKS = "kind int, bucket int, split int, part int, sweep int, block long, cells array<binary>"


def post(batches, buckets: int, split: dict[int, int], hot: np.ndarray, common: np.ndarray, turn: int, turns: int):
    """Rows of a task's blocks: one with the block's ids, and one of postings for each bucket."""
    words = Words()
    first = (TaskContext.get().partitionId() * turns + turn if TaskContext.get() else turn) << 24
    held: list[tuple] = []
    ids: list[pa.RecordBatch] = []
    seq = waiting = 0

    def row(kind: int, bucket: int, number: int, block: int, cells: list[bytes]) -> tuple:
        return kind, bucket, number, -1, -1, block, cells

    def flush(block: int):
        docs = pa.Table.from_batches(ids).combine_chunks()
        ids.clear()
        token, doc = joined(held)
        n = np.bincount(doc, minlength=len(docs))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        yield row(HEAD, -1, block % 1000003, block, [pack(np.frombuffer(sink.getvalue(), "u1"), "u1"), pack(n, "<u4")])
        dealt = deal(token, doc, buckets, hot, common)
        del token, doc, docs, sink
        for bucket, *entries, to in dealt:
            yield row(POST, bucket, block % split.get(bucket, 1), block, [*entry_cells(*entries), pack(to, "<u4"), pack(place(hot, entries[0]) + 1, "<u4")])

    for rows, texts in _grouped(batches, 2, PIECE):
        held.append((len(rows), *words(texts)))
        ids.append(pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c).slice(i, 1) for b, i in rows]) for c in (0, 1)], ["id", "held"]))
        waiting += len(held[-1][1])
        if waiting >= TOKENS:
            yield from in_batches(flush(first | seq), BLOCK)
            waiting, seq = 0, seq + 1
    if held:
        yield from in_batches(flush(first | seq), BLOCK)


#: Entries, and tokens for the parts, that a bucket looks up at once.
ENTRIES, TOLD = 250_000, 400_000


def sums_rows(blocks: list[int], block: np.ndarray, doc: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> list[tuple]:
    """A row for each block that has tokens; ``block`` is a token's place among the blocks."""
    if not len(doc):
        return []
    bits = int(doc.max()).bit_length()
    key = block.astype(np.int64) << bits | doc
    order = ordering(key, len(blocks) << bits)
    key = key[order]
    head, _ = runs(key)
    key, sums = key[head], [np.add.reduceat(x[order].astype(np.float64), head) for x in (known, base, score)]
    docs, at = key & (1 << bits) - 1, key >> bits
    out = []
    for i, n in zip(*(x.tolist() for x in runs(at)), strict=True):
        e = slice(i, i + n)
        out.append((SUMS, -1, -1, -1, -1, blocks[at[i]], [pack(docs[e], "<u4", True), pack(sums[0][e], "<u4"), pack(sums[1][e], "<f8"), pack(sums[2][e], "<f4")]))
    return out


def away_rows(blocks: list[int], told: list[tuple], parts: int) -> list[tuple]:
    """A row for each part that has to do with the tokens (hash, hot number, place among the blocks, document, samples' factors)."""
    if not told:
        return []
    word, here, block, doc = (np.concatenate([x[i] for x in told]) for i in range(4))
    p = np.concatenate([x[4] for x in told], axis=1)
    part = (mix(word) % np.uint64(parts)).astype(np.int64)
    by = ordering(part, parts)
    out = []
    for i, n in zip(*(x.tolist() for x in runs(part[by])), strict=True):
        e = by[i : i + n]
        own, local = coded(word[e])
        used, number = np.unique(block[e], return_inverse=True)
        cells = [pack(own, "<u8", True), pack(local, "<u4"), pack(here[e] + 1, "<u4"), pack(doc[e], "<u4"), pack(p[:, e].ravel(), "<f4")]
        out.append((AWAY, -1, -1, int(part[e[0]]), -1, -1, [*cells, pack(np.array(blocks, np.int64)[used], "<u8"), pack(number, "<u4")]))
    return out


def score_bucket(t: pa.Table, found: list[Totals], parts: int, common: np.ndarray) -> pa.Table:
    """Sums for each block that has postings in the bucket, and postings whose words are not in it, with what their probability is multiplied by."""
    kinds = t["kind"].to_pylist()
    rows = [t.slice(i, 1).to_pylist()[0] for i, kind in enumerate(kinds) if kind != POST]
    if kinds[0] == HEAD:
        return table([tuple(r[f.name] for f in BLOCK) for r in rows], BLOCK)
    state, look = (next((r["cells"] for r in rows if r["kind"] == kind), None) for kind in (STATE, LOOKUP))
    samples, first = [], found[0]
    if state:
        g = Group(state, look, common)
        answers = {}
        for r in rows:
            if r["kind"] == ANSWER:
                answers.setdefault(r["sweep"], []).append(r)
        count = g.answers(answers[min(answers)])[0]
        base_of = np.log10((count + 1) / (first.tokens + first.v + 1))
        seen = np.zeros(g.n[2])
        for k, sweep in enumerate(sorted(answers)[1:]):
            t1, t2 = (load(c, "<u4").astype(np.int64) for c in state[10 + 2 * k : 12 + 2 * k])
            _, _, p0, p1, rest = g.seated(found[k], t1, t2, g.answers(answers[sweep]))
            for i in range(0, len(seen), 1 << 17):  # some at a time, for memory
                e = slice(i, i + (1 << 17))
                at = g.at2[e]
                seen[e] += chance(found[k].discount[2], found[k].strength[2], g.c2[e], t2[e], rest[2][at], rest[3][at], p1[g.up2[e]])
            del at
            rest = [x.astype(np.int64 if x.max(initial=0) >= 1 << 31 else np.int32) for x in rest]
            samples.append((p0, p1, [*rest[:2], samples[0][2][2] if samples else rest[2], rest[3]]))  # customers below are the same
        v, book = len(g.words), g.words
        key1 = g.own[g.at1] * v + g.word
        pair = np.repeat(g.own, g.nx) * v + g.two
        key2 = g.at2 * np.int64(v) + g.word[g.up2]
        by = ordering(key2, len(pair) * v)
        key2, seen = key2[by], np.log10(seen[by] / len(found))  # of the entries; other tokens take more steps
        number, context = np.full(v, -1), np.full(v, -1)
        number[g.slots], context[g.own] = np.arange(len(g.slots)), np.arange(len(g.own))
        named = load(look[0], "<u4", True)
        booked = np.full(len(common), -1, np.int32)
        booked[named] = place(book, common[named])
        del g, answers, t1, t2, p0, p1, rest, by, named
    del rows
    out: list[tuple] = []
    told: list[tuple] = []
    blocks: list[int] = []

    def look_up(held: list[tuple], start: int) -> None:
        """Postings (entries, documents, hot numbers) of the blocks from ``start`` on."""
        base = np.cumsum([0] + [len(x[0]) + len(x[1]) for x in held]).astype(np.int32)
        one, two, word = (np.concatenate([x[i] + b for x, b in zip(held, base, strict=False)]) for i in (2, 3, 4))
        times, doc = np.concatenate([x[5] for x in held]), np.concatenate([x[6] for x in held])
        block = np.repeat(np.arange(start, start + len(held), dtype=np.int32), [len(x[6]) for x in held])
        here = np.concatenate([x[7] for x in held])[one].astype(np.int64) - 1
        n = len(one)
        if state:
            others = place(book, np.concatenate([x[1] for x in held]))
            cuts = np.cumsum([len(x[1]) for x in held])[:-1]
            mine = np.concatenate([y for x, o in zip(held, np.split(others, cuts), strict=True) for y in (booked[x[0]], o)]).astype(np.int64)
            change = np.concatenate([np.ones(1, bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            head = np.flatnonzero(change)
            a, b = mine[one[head]], mine[two[head]]
            at2 = np.where((a >= 0) & (b >= 0), place(pair, a * v + b), -1)[np.cumsum(change) - 1]
            w = mine[word]
            slot = np.where(w >= 0, number[w], -1)
            entry = np.where((at2 >= 0) & (w >= 0), place(key2, at2 * v + w), -1)
            left = np.flatnonzero(entry < 0)
            a, w, at2 = mine[one[left]], w[left], at2[left]
            at0 = np.where(a >= 0, context[a], -1)
            at1 = np.where((a >= 0) & (w >= 0), place(key1, a * v + w), -1)
        else:
            slot = entry = np.full(n, -1)
            left = np.arange(n)
            at1 = entry
        here_left = here[left]
        done_left = np.where(here_left >= 0, at1 >= 0, slot[left] >= 0)  # the parts know about the others
        p = np.zeros((len(found), len(left)))
        for k, t_k in enumerate(found):
            c2 = t2 = c1 = t1 = np.zeros(len(left))
            if state:
                p0, p1, rest = samples[k]
                c2, t2 = (np.where(at2 >= 0, x[at2], 0) for x in rest[2:])
                c1, t1 = (np.where(at0 >= 0, x[at0], 0) for x in rest[:2])
            up2, up1 = (chance(t_k.discount[i], t_k.strength[i], 0, 0, c, t, 1.0) for i, c, t in ((2, c2, t2), (1, c1, t1)))
            p[k] = up2 * np.where(here_left >= 0, 1, up1)
            if state:
                p[k] = np.where(done_left, up2 * np.where(at1 >= 0, p1[at1], up1 * p0[slot[left]]), p[k])
        each = np.repeat(np.arange(n, dtype=np.int32), times)
        away = np.zeros(n, bool)
        away[left[~done_left]] = True
        away_token = away[each]
        if state:
            score = seen[entry]
            score[left] = np.log10(p.mean(axis=0))
            e = np.flatnonzero(~away_token) if away.any() else slice(None)
            at = each[e]
            out.extend(sums_rows(blocks, block[e], doc[e], np.ones(len(at)), base_of[slot][at], score[at]))
        if away.any():
            where = np.empty(n, np.int64)
            where[left] = np.arange(len(left))
            words = np.concatenate([y for x in held for y in (common[x[0]], x[1])])
            e = np.flatnonzero(away_token)
            at = each[e]
            told.append((words[word[at]], here[at], block[e], doc[e], p[:, where[at]].astype(np.float32)))

    def tell(least: int) -> None:
        if sum(len(x[0]) for x in told) >= least:
            out.extend(away_rows(blocks, told, parts))
            told.clear()

    held: list[tuple] = []
    waiting = 0
    i = 0
    for b in t.to_batches():
        for j in range(b.num_rows):
            if kinds[i + j] != POST:
                continue
            cells = b["cells"][j].as_py()
            held.append((*load_entries(cells), load(cells[ENTRY], "<u4"), load(cells[ENTRY + 1], "<u4")))
            blocks.append(b["block"][j].as_py())
            waiting += len(held[-1][2]) + len(held[-1][6]) // 4
            if waiting >= ENTRIES:
                look_up(held, len(blocks) - len(held))
                tell(TOLD)
                held, waiting = [], 0
        i += b.num_rows
    if held:
        look_up(held, len(blocks) - len(held))
    tell(1)
    return table(out, BLOCK)


def score_part(t: pa.Table, found: list[Totals]) -> pa.Table:
    """Sums for blocks of the tokens whose words a bucket has not seen."""
    rows = t.to_pylist()
    kept = sorted((r for r in rows if r["kind"] == PART), key=lambda r: r["sweep"])
    own = load(kept[0]["cells"][0], "<u8", True) if kept else np.zeros(0, np.uint64)
    cells = [[load(c, "<u4").astype(np.int64) for c in (r["cells"][1], r["cells"][2], r["cells"][4], r["cells"][5])] for r in kept[1:]]
    keys = load(kept[1]["cells"][3], "<u8", True).astype(np.int64) if kept else np.zeros(0, np.int64)
    count = load(kept[0]["cells"][1], "<u4").astype(np.int64) if kept else None
    out: list[tuple] = []
    held: list[tuple] = []

    def flush(least: int) -> None:
        """A row for each block of the tokens held."""
        if sum(len(x[0]) for x in held) >= least:
            block, *columns = (np.concatenate([x[i] for x in held]) for i in range(5))
            blocks, at = np.unique(block, return_inverse=True)
            out.extend(sums_rows(blocks.tolist(), at, *columns))
            held.clear()

    for r in rows:
        if r["kind"] != AWAY:
            continue
        at = place(own, load(r["cells"][0], "<u8", True))[load(r["cells"][1], "<u4")]
        warm, doc = load(r["cells"][2], "<u4").astype(np.int64) - 1, load(r["cells"][3], "<u4").astype(np.int64)
        p = load(r["cells"][4], "<f4").astype(np.float64).reshape(len(found), -1)
        block = load(r["cells"][5], "<u8").astype(np.int64)[load(r["cells"][6], "<u4")]
        is_warm = warm >= 0
        key = np.where((at >= 0) & is_warm, place(keys, at << 32 | np.maximum(warm, 0)), -1)
        for k, t_k in enumerate(found):
            parent = np.full(len(at), float(t_k.chance(0, 0, 0, 0, t_k.unknown)))
            c1 = t1 = np.zeros(len(at))
            if kept:
                c0, t0, warm_c, warm_t = cells[k]
                parent = np.where(at >= 0, t_k.chance(0, 0, c0[at], t0[at], t_k.known()), parent)
                if len(keys):
                    c1, t1 = (np.where(key >= 0, x[key], 0) for x in (warm_c, warm_t))
            if is_warm.any():
                parent[is_warm] = t_k.chance(1, warm[is_warm], c1[is_warm], t1[is_warm], parent[is_warm])
            p[k] *= parent
        c = np.where(at >= 0, count[at], 0) if kept else np.zeros(len(at))
        held.append((block, doc, at >= 0, np.log10((c + 1) / (found[0].tokens + found[0].v + 1)), np.log10(p.mean(axis=0))))
        flush(2 * TOLD)
    flush(1)
    return table(out, BLOCK)


def sum_block(t: pa.Table, schema: pa.Schema, tokens: int) -> pa.Table:
    rows = t.to_pylist()
    head = next(r["cells"] for r in rows if r["kind"] == HEAD)
    docs = pa.ipc.open_stream(load(head[0], "u1").tobytes()).read_all()
    n = load(head[1], "<u4")
    known, base, score = (np.zeros(len(n)) for _ in range(3))
    for r in rows:
        if r["kind"] == SUMS:
            at = load(r["cells"][0], "<u4", True)
            for to, x, kind in ((known, r["cells"][1], "<u4"), (base, r["cells"][2], "<f8"), (score, r["cells"][3], "<f4")):
                to[at] += load(x, kind)
    arrays = [docs["id"].combine_chunks(), docs["held"].combine_chunks(), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score)]
    return pa.table(arrays, schema=schema)


def score(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", held_out: Column | None = None, turns: int | None = None) -> DataFrame:
    """``id``, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (of a token) for every row.

    Large tables are scored in two turns, or three, by a hash of the text, so that a part of the postings is on the disks at once.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), (F.lit(False) if held_out is None else held_out).alias("held"), text_of(text).cast("binary").alias("body"))
    kind = rows.schema["id"].dataType
    buckets, split, found, parts, hot, common = model.buckets, model.split, model.found, model.parts, model.hot, model.common
    copies = F.explode(F.sequence(F.lit(0), F.lit(0)))
    if split:
        counts = F.create_map(*[F.lit(x) for b, n in split.items() for x in (b, n)])
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(counts, F.col("bucket")), F.lit(1)) - 1))
    columns = ["kind", "bucket", "split", "part", "sweep", F.lit(-1).cast("long").alias("block"), "cells"]
    turns = turns or (1 if buckets <= 8 else 2 if buckets <= 128 else 3)  # postings grow with the buckets, as fewer tokens share a cell

    def freed() -> None:  # shuffles of the last sweep, of the turn before
        gc.collect()
        settle(docs.sparkSession)

    def turned(turn: int) -> DataFrame:
        freed()
        some = rows if turns == 1 else rows.filter(F.pmod(F.xxhash64("body"), F.lit(turns)) == turn)
        sent = some.mapInArrow(tidy(lambda it: post(it, buckets, split, hot, common, turn, turns)), BLOCKS)
        for x in (model.groups, *(r.filter(F.col("kind") == ANSWER) for r in (model.counts, *model.roots))):
            sent = sent.union(x.select("*", copies.alias("split")).select(*columns))
        return stored(sent.groupBy("bucket", "split").applyInArrow(lean(lambda t: score_bucket(t, found, parts, common)), BLOCKS), "replies")

    replies = functools.reduce(DataFrame.union, [turned(k) for k in range(turns)])
    freed()
    away = replies.filter(F.col("kind") == AWAY)
    for r in (model.counts, *model.roots):
        away = away.union(r.filter(F.col("kind") == PART).select("kind", "bucket", F.lit(-1).alias("split"), "part", "sweep", F.lit(-1).cast("long").alias("block"), "cells"))
    replies = replies.filter(F.col("kind") != AWAY).union(away.groupBy("part").applyInArrow(lean(lambda t: score_part(t, found)), BLOCKS))
    import pyspark.sql.pandas.types as arrow

    out = pa.schema([("id", arrow.to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    tokens = found[0].tokens
    summed = replies.groupBy("block").applyInArrow(lambda t: sum_block(t, out, tokens), f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return summed.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id)
