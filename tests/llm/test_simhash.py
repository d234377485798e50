import random

import numpy as np
import pytest
import xxhash

from docframe.llm import simhash as S
from docframe.llm.components import components


def brute_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def similar_signature(text):
    h = S.hashes(text or "", 5)
    return [S.fingerprint(S.mixed(h, k)) & (2**64 - 1) for k in range(3)]


def is_similar(a, b):
    """Every part of the first word as near as the trie needs it, without one."""
    bits = a[0] ^ b[0]
    return bits.bit_count() <= 11 and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= 31


def brute_components(pairs, near=lambda a, b: (a ^ b).bit_count() <= 2):
    """The least id of what each fingerprint reaches."""
    n = len(pairs)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(pairs[i][1], pairs[j][1]):
                up[find(i)] = find(j)
    return [min(pairs[j][0] for j in range(n) if find(j) == find(i)) for i in range(n)]


def made():
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha beta gamma delta Épsilon zeta\tH 漢字 x".split(" ")) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(500, None), (3, ""), (501, " \n"), (7, "one"), (8, "one two"), (9, "ONE two"), (10, "non breaking   space")]
    for t in base:
        rows += [(rng.randint(20, 400), t) for _ in range(rng.choice([1, 1, 3]))]
        words = t.split(" ")
        words[rng.randrange(len(words))] = "edit"
        rows.append((rng.randint(20, 400), " ".join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = made()
    want_fp = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([(d, f) for (d, _), f in zip(rows, want_fp, strict=True)])
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(df).collect())
    assert got == sorted((d, f, c) for (d, _), f, c in zip(rows, want_fp, want, strict=True))
    kept = S.deduplicate(df)
    # components by row: an id may be in several, and each keeps a document
    roots = brute_components([(i, f) for i, f in enumerate(want_fp)])
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for _, d in least.values())


@pytest.mark.parametrize(("budget", "leaves"), [(2, 16), (2, 100_000), (1, 16), (0, 16), (3, 16)])
def test_the_trie_loses_no_link(spark, budget, leaves):
    rng = np.random.default_rng(budget)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(seeds.tolist()) | {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds[:40] for a, b in rng.integers(0, 64, (4, 2))}
    fps |= {int(seeds[0]) ^ (1 << a) for a in range(40)}  # a subtree with very many leaves
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = S.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), budget=budget, leaves=leaves).collect()
    up = {f: f for f in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2**6
        up[find(a)] = find(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= budget:
                assert find(a) == find(b)
    groups = {}
    for f in signed:
        groups.setdefault(find(f), set()).add(f)
    for own in groups.values():  # and makes none
        reached, left = {next(iter(own))}, set(own)
        while more := {f for f in left - reached if any(((f ^ g) & (2**64 - 1)).bit_count() <= budget for g in reached)}:
            reached |= more
        assert reached == own


@pytest.mark.parametrize("leaves", [8, 100_000])
def test_similar_texts_match_brute_force_and_similarity(spark, leaves):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    texts, group = [], []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 500]))]
        for _ in range(rng.choice([1, 6])):
            own = list(base)
            for _ in range(len(base) // 150):  # a similarity of about 0.9
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
            group.append(g)
    sigs = [similar_signature(t) for t in texts]
    want = brute_components(list(zip(range(len(texts)), sigs, strict=True)), is_similar)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    if leaves > 1000:
        got = {r.doc_id: r.component_id for r in S.near_duplicates(df, budget=S.SIMILAR, width=5).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert len(set(want)) <= 15 and all(group[i] == group[c] for i, c in enumerate(want))
    signed = [[x - (1 << 64) if x >> 63 else x for x in s] for s in sigs]
    fps = spark.createDataFrame([(i, s[0], s[1:]) for i, s in enumerate(signed)], "node long, fp long, more array<bigint>")
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in S.links(fps, budget=S.SIMILAR, leaves=leaves).collect():
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert [min(j for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5), (2000, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[2000 + i] == 1000 for i in range(50)) and got[1000] == 1000


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "zz"), (None, "zz")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(df).filter("component_id is not null").collect()) == [(-1, 4), (4, 4), (4, 4)]
    assert S.deduplicate(df).count() == 2
    assert S.deduplicate(df.limit(0)).count() == 0


def edited_pairs(rng, changes):
    """Isolated pairs of 200 words, the second with so many words replaced."""
    for k in changes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        own = list(base)
        for at in rng.sample(range(2, 39), k):
            own[at * 5] = f"w{rng.randrange(10**6)}"
        yield " ".join(base), " ".join(own)


def test_links_are_those_of_the_exact_similarity(spark):
    rng = random.Random(21)
    texts = [t for pair in edited_pairs(rng, [2, 3, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 6, 8]) for t in pair]
    # sets of few shingles, repeats of one line, chains, no words
    base = [f"v{i}" for i in range(60)]
    texts += ["a b c", "a b c", "a b d", "", None, " ".join(["same line of five words"] * 40), " ".join(["same line of five words"] * 9)]
    texts += [" ".join(base[i : i + 50]) for i in range(0, 10, 2)]
    sets = [set(S.hashes(t or "", 5)) for t in texts]
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = brute_components(list(enumerate(sets)), similar)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # the fingerprints alone miss some of these
    sigs = [similar_signature(t) for t in texts]
    assert any(want[i] == want[i - 1] and not is_similar(sigs[i], sigs[i - 1]) for i in range(1, 30, 2))


def test_shingle_sets_have_each_text_s_words():
    """As many distinct shingles as a text has; letter case and spaces don't matter, and neither do the texts beside it."""
    texts = [b"", b"a b", b"A\tb ", b"a b c d e f", b" \n", b"x a b c d e f", b"a b c d e a b c d e a b c d e"]
    sets = S.shingle_sets(texts, 5)
    assert [len(x) for x in sets] == [0, 1, 1, 2, 0, 3, 5]
    assert (sets[1] == sets[2]).all() and set(sets[3].tolist()) < set(sets[5].tolist())
    assert all((S.shingle_sets([t], 5)[0] == x).all() for t, x in zip(texts, sets, strict=True))


@pytest.mark.parametrize("share", [None, S.SHARE])
def test_rows_without_an_id_stay_by_component(spark, share):
    rows = [(None, "a b c"), (4, "a b c"), (None, "zz"), (None, "zz"), (None, "yy xx"), (2, "copied text"), (6, "copied text"), (6, "own words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = S.deduplicate(df, share=share).collect()
    # 6 is a copy with one of its texts and stays with the other
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "yy xx"), (0, "zz"), (2, "copied text"), (4, "a b c"), (6, "own words")]


def test_an_id_of_two_unlike_texts_keeps_both(spark):
    a, b = "one text about rivers and lakes of the north", "quite another text on stones of the old walls"
    for rows, want in (([(3, b), (5, a), (5, b)], [(3, b), (5, a)]), ([(5, a), (5, b)], [(5, a), (5, b)])):
        for share in (None, S.SHARE):
            kept = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), share=share).collect()
            assert sorted((r.doc_id, r.text) for r in kept) == sorted(want)


@pytest.mark.parametrize("share", [None, S.SHARE])
def test_columns_of_any_name_and_type(spark, share):
    rows = [(1, "a text of six words here", 1, 2, {"k": 1}, 3, 4, 5), (2, "a text of six words here", 1, 2, None, 3, 4, 5), (3, None, 1, 2, {}, 3, 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int, i int, m map<string,int>, `with space` int, `a.b` int, node int")
    kept = S.deduplicate(df, share=share)
    assert kept.schema.names == df.schema.names and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.filter("doc_id = 1").first().asDict()["m"] == {"k": 1}
    assert S.deduplicate(df.limit(0), share=share).count() == 0


def test_isolated_pairs_at_the_limit_are_found(spark):
    """Pairs without a third text: 4 changes of 200 words are a similarity of 0.815."""
    rng = random.Random(5)
    pairs = list(edited_pairs(rng, [4] * 150 + [5] * 50))
    df = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]
    assert sum(linked[:150]) >= 148 and not any(linked[150:])


def test_large_components_are_compared_in_blocks(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):  # near copies, some of which are similar to few others
        own = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            own[at] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [set(S.hashes(t, 5)) for t in texts]
    want = brute_components(list(enumerate(sets)), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert 1 < len(set(want)) < 50
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "text", "xxhash64(text) as digest").repartition(3)
    for block in (600, 2000, 10**6):
        rows, placed = S._similar(keyed, ["id", "digest"], S.SHARE, 5, block=block)
        root = {r.id: r.root for r in rows.join(placed, "node").collect()}
        least = {}
        for i in sorted(root):
            least.setdefault(root[i], i)
        assert [least[root[i]] for i in range(len(texts))] == want


def test_sets_and_their_overlaps():
    rng = random.Random(2)
    texts = ["", " ", "a", "A b", "b a", "a b c d e", "a b c d e f", "a\tb\x0bc d e f g", "x " * 30] + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(40)]
    found = S.shingle_sets([t.encode() for t in texts], 5)
    brute = [set(S.hashes(t, 5)) for t in texts]
    assert [len(x) for x in found] == [len(x) for x in brute]
    for i, a in enumerate(brute):
        for j, b in enumerate(brute):
            assert len(np.intersect1d(found[i], found[j])) == len(a & b)
    filled = [x for x in found if len(x)]
    assert (S.common(filled, filled) == [[len(set(x.tolist()) & set(y.tolist())) for y in filled] for x in filled]).all()
