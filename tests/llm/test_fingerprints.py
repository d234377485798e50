import hashlib
import random
import re

from pyspark.sql import functions as F

from docframe.llm import fingerprints as P


def cut(pattern, text):
    return [m for m in re.findall(pattern, text) if m]


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def brute(text):
    roots, sections = "", []
    for s in cut(P.SECTION, text or ""):
        paragraphs, shown = "", ""
        for p in cut(P.PARAGRAPH, s):
            leaves = [(md5(x), len(x)) for x in cut(P.LEAF, p)]
            own = md5("".join(f"{d}:{n}" for d, n in leaves))
            paragraphs += own
            shown += f"{own[:16]}[{' '.join(f'{d[:16]}:{n}' for d, n in leaves)}]"
        roots += md5(paragraphs)
        sections.append(f"{md5(paragraphs)[:16]}({shown})")
    return hashlib.sha256(roots.encode()).hexdigest()[:32] + "|" + "|".join(sections)


def alike(a, b):
    x, y = (dict(t.split(":") for t in re.findall(P.LEAF_TOKEN, f)) for f in (a, b))
    total = sum(map(int, x.values())) + sum(map(int, y.values()))
    return 2 * sum(int(n) for t, n in x.items() if t in y) / total if total else 1.0


def made():
    rng = random.Random(2)
    words = ["one", "deux.", "trés!", "漢字", "\n", "\n\n", "a b", " ", "?!", "x" * 50, "\r\n", "😀"]
    return [None, "", "\n", ".", "no end", "a" * 2000, "A.\n\n\nB. C"] + ["".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]


def test_matches_brute_force_and_leaves_cover_the_text(spark):
    texts = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, root string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in P.fingerprinted(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        assert sum(int(x.split(":")[1]) for x in re.findall(P.LEAF_TOKEN, got[i])) == len(t or "")


def test_likeness_and_differing_branches(spark):
    a = "\n".join(f"Line {i} has a sentence. And another one." for i in range(40))
    b = a.replace("Line 20", "Line XX")
    df = spark.createDataFrame([(a, b), (a, a), ("", None), (a, "")], "a string, b string").select(P.fingerprint(F.col("a")).alias("a"), P.fingerprint(F.col("b")).alias("b"))
    rows = df.select("a", "b", P.likeness(F.col("a"), F.col("b")).alias("x"), P.differing(F.col("a"), F.col("b")).alias("d")).collect()
    assert [round(r.x, 9) for r in rows] == [round(alike(r.a, r.b), 9) for r in rows] and rows[1].x == 1.0 and rows[2].x == 1.0 and rows[3].x == 0.0 and rows[0].x > 0.95
    assert [(d.section, d.paragraph) for d in rows[0].d] == [(1, 4)] and rows[1].d == [] and len(rows[3].d) == 40


def test_next_rows_follow_in_descending_order_across_ranges(spark):
    for ids in ([5], [3, 9], list(range(0, 900, 7)), [1, 1, 2, None, 7, 7, None], []):
        rows = [(i, f"t{k}", 0) for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string, __n int").repartition(4)
        got = P.following(df, id="doc_id", carry=["text"], per_bucket=20).collect()
        assert sorted(r.text for r in got) == sorted(t for _, t, _ in rows) and sorted(r.next_text for r in got) == sorted(t for _, t, _ in rows)
        at = {t: i for i, t, _ in rows}
        order = sorted({i for i in ids if i is not None}, reverse=True) + [None] * (None in ids)
        for r in got:  # the next id is the same one, or the one after it
            own, nxt = order.index(r.doc_id), order.index(at[r.next_text])
            assert nxt == own or nxt == (own + 1) % len(order)


def test_edited_text(spark):
    df = spark.createDataFrame([("abcdefg", "XYZ"), ("abcdef", "Ü"), ("ab", "Z"), ("", "Z"), ("漢字漢字漢字", "😀😁")], "a string, b string")
    assert [r[0] for r in df.select(P.edited(F.col("a"), F.col("b"))).collect()] == ["abcdeXY", "abcdÜ", "ab", "", "漢字漢字😀😁"]


def test_texts_that_agree_in_32_bits_of_a_leaf_have_other_roots(spark):
    a, b = "sentence number 000017546 here.", "sentence number 000024984 here."
    assert md5(a)[:8] == md5(b)[:8]
    x, y = (r[0] for r in spark.createDataFrame([(a,), (b,)], "text string").select(P.fingerprint(F.col("text"))).collect())
    assert x[:32] != y[:32] and x != y


def test_very_long_text(spark):
    text = "A sentence of some words. " * 40_000
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert {r.fingerprint for r in P.fingerprinted(df).collect()} == {brute(text)}
