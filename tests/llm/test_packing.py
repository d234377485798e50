import random
import zlib

import numpy as np
import pytest

from docframe.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    None, "", " ", "a", "a b  c", " lead", "trail \n", "x\n\ny", "don't we'll there", "tab\tand\nline é ß 漢字 \U0001f600", "<|endoftext|> x", "many    spaces\n\n\n and", "nul\0 x", "word " * 3000, "́combining 12345 ½²",
]


def test_ids_and_places(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "the ", " of", "\n", "  ", "ing", "É", "12", "!?", "\t", "'s"]) for _ in range(rng.randint(1, 900))) for _ in range(200)]
    rows = [(i % 150, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = P.pack(df, PATH, capacity=256).collect()
    want = sorted(sum(([(d, k, s, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), n) for k, (s, n) in enumerate(cuts(len(ids), 256))] for d, ids in ((d, x + [2]) for (d, _, _), x in zip(rows, ids_of([t or "" for t in texts]), strict=True))), []))
    assert sorted((r.doc_id, r.piece, r.start, r.ids_crc32, r.length) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) == sequential([r.length for r in got], 256)


def cuts(n, capacity):
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def sequential(lengths, capacity):
    """Best-fit decreasing, one document after the other."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_sweep_equals_sequential_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([3, 7, 7, 7, rng.randint(1, 63)]) for _ in range(rng.randint(1, 700))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    places, used = P.best_fit(counts, 64)
    assert used == sequential(lengths, 64)
    fill, ranks = {}, {}
    for length, r0, r1, first, per, offset in places:
        for r in range(r0, r1):
            ranks.setdefault(length, []).append(r)
            fill.setdefault(first + (r - r0) // per, []).append((offset + (r - r0) % per * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

@pytest.mark.parametrize("limit", [0, 500_000])
def test_ranks_by_task_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "COUNTS", limit)
    monkeypatch.setattr(P, "PLACES", limit)
    df = spark.createDataFrame([(i, "a " * (i % 9)) for i in range(400)], "doc_id long, text string").repartition(7)
    got = P.pack(df, PATH, capacity=64, keep_ids=False).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == 400 and len(by) == sequential([r.length for r in got], 64)
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
