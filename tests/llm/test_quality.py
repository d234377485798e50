import random
import re
from collections import Counter

from docframe.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "\n\n", "a b c", "same line\nsame line\n same line", "x " * 5000] + ["".join(rng.choice(["a ", "b ", "c", "\n", "#", "é ", " ", "\x1c", "\t", "word "]) for _ in range(rng.randint(1, 300))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept int").repartition(3)
    for r in Q.assess(df).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_lines_of_many_documents_of_a_host(spark):
    def body(i):
        return " ".join(f"w{i}x{k}" for k in range(20))

    rows = [(i, f"Read MORE  news {i % 10} here today\n{body(i)}", "a") for i in range(30)]  # one line once digits are alike
    rows += [(100 + i, "read more news 0 here today\n" + " ".join(f"t{i}y{k}" for k in range(5)), "a") for i in range(5)]  # little else
    rows += [(200 + i, f"read more news 1 here today\n{body(200 + i)}", "b") for i in range(3)]  # rare there
    rows += [(300 + i, "copied line\n" + body(300), None) for i in range(40)]  # copies count once
    got = {r.doc_id: r for r in Q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_removed_words == 6 and got[i].kept for i in range(30))
    assert not any(got[100 + i].kept for i in range(5)) and all(got[200 + i].n_removed_words == 0 and got[200 + i].kept for i in range(3))
    assert all(got[300 + i].n_removed_words == 0 and got[300 + i].kept for i in range(40))


def test_empty_table(spark):
    assert Q.assess(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
