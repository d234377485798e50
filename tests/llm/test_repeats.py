import hashlib
import random

import numpy as np
import pytest
import zstandard

from docframe.llm import repeats as R


def brute(rows, width):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - width + 1):
                s = b[i : i + width]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if d is not None and first[b[i : i + width]] < d:
                gone[i : i + width] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma ", "delta", "\n", "x", "漢字", " ", "of the", "\x00"]
    passages = ["".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = [(5, None), (6, ""), (7, "a" * 300), (8, "b" + "a" * 400), (9, "ab" * 200), (9, "ab" * 200), (2, "short"), (None, "a" * 300), (3, "漢" * 17), (4, "漢" * 17)]
    for _ in range(60):
        own = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(0, 90), "".join(own)))
    copy = rows[-1][1]
    return rows + [(100 + i, copy) for i in range(12)]


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    found = R.deduplicate(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute(rows, 50)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_removed == sum(x["end"] - x["start"] for x in r.removed) for r in found)


def test_hot_minimizers_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(R, "OFTEN", 1)
    rows = made(5)
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(3)
    for hot in (1, 12):  # all minimizers, and those of copies
        found = R.deduplicate(df, hot_segments=hot).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute(rows, 50)


def test_pieces_of_long_texts_overlap(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 97)
    monkeypatch.setattr(R, "FLUSH", 2000)
    monkeypatch.setattr(R, "BLOCK", 300)
    rows = [(d, t) for d, t in made(7) if d is not None]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([(t or "").encode() for _, t in rows], pa.binary())], ["doc", "key", "body"])
    sent = pa.Table.from_batches(list(R.cut(iter([batch]), 50, 5, np.zeros(0, np.uint64))))
    spans = {}
    for b in set(sent["bucket"].to_pylist()):
        for r in R.found_in(sent.filter(pa.compute.equal(sent["bucket"], b)), 50, 3).to_pylist():
            _, keys, n = np.frombuffer(zstandard.decompress(r["docs"]), "<i8").reshape(3, -1)
            for key, span in zip(np.repeat(keys, n), np.frombuffer(zstandard.decompress(r["spans"]), "<i8").reshape(2, -1).T, strict=True):
                spans.setdefault(int(key), []).append(span)
    want = brute(rows, 50)
    got = []
    for i, (d, t) in enumerate(rows):
        body = (t or "").encode()
        runs = list(zip(*(x.tolist() for x in R.cover(*np.array(spans[i]).T)), strict=True)) if i in spans else []
        kept, end = b"", 0
        for a, e in runs:
            kept, end = kept + body[end:a], e
        got.append((d, len(body), sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept + body[end:]).hexdigest()))
    assert sorted(got, key=repr) == want


def test_all_byte_values_and_range_min():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (40, 88)).astype(np.uint8)
    rows[20:] = rows[:20]
    lens = np.full(40, 88)
    got = R.least_docs(rows, lens, np.arange(40)[::-1].copy(), 50)
    assert (got[:20] == got[20:]).all() and (got[20:, 0] == np.arange(20)[::-1]).all()
    x = rng.integers(0, 200, 3000).astype(np.uint8)
    a = rng.integers(0, 3000, 500)
    b = np.minimum(a + rng.integers(0, 2500, 500), 2999)
    assert (R.RangeMin(x)(a, b) == [x[i : j + 1].min() for i, j in zip(a, b, strict=True)]).all()


def test_empty_table(spark):
    assert R.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
