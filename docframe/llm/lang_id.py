"""Language identification: script ranges narrow the candidates, Viterbi over words labels spans.

A bounded sample of labelled documents trains a smoothed model of letter trigrams per language. Each word's script,
found by ranges of code points, admits only languages in which that script was seen; a word's score in a
language is the log-likelihood of its trigrams. Viterbi with a switching penalty then labels every word of the
whole text, and the language with the most letters is the document's.

A word speaks for no language if no language has its script, or if its trigrams are in none more likely than they would be if all that
were seen in it were equally frequent. Its letters count for the whole text but for no language, so texts in no learned language score low.

Null, empty and letterless texts, and those wholly in scripts of no language, are ``und`` with score 0 and no spans. Ties go to the language with more training
documents, then to the lesser name. Repeated rows are labelled alike, extra columns are ignored, an empty table gives
an empty result, and if nothing was learned every text is ``und``.
"""

from __future__ import annotations

import bisect
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import col, sliced, text_of, tidy

#: First and last code point of the ranges that decide a letter's script; other letters are ``other``.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xFF21, 0xFF5A, "latin"), (0x20000, 0x2FFFF, "han"),
]
_STARTS = [s for s, _, _ in SCRIPTS]


def script(letter: str) -> str:
    code = ord(letter)
    i = bisect.bisect_right(_STARTS, code) - 1
    return SCRIPTS[i][2] if i >= 0 and code <= SCRIPTS[i][1] else "other"


def letters(word: str) -> str:
    if word.isascii() and word.isalpha():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFC", word).lower() if c.isalpha())


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@dataclass
class Model:
    langs: list[str]
    prior: list[int]
    scripts: dict[str, list[int]]
    grams: dict[str, int]
    logp: np.ndarray  # row per trigram, the last for unseen ones
    penalty: float


def sample(docs: DataFrame, id: str, lang: str, per_lang: int, parts: int = 64) -> DataFrame:
    """Ids of at most ``per_lang`` documents of each language, spread by hash, without one task per language."""
    key = F.xxhash64(F.lit("lang"), F.col(id))
    w = Window.partitionBy(lang, "__p").orderBy("__k", id)
    rows = docs.select(id, lang).withColumn("__k", key).withColumn("__p", F.pmod(F.xxhash64("__k"), F.lit(parts)))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max(1, per_lang // parts)).select(id).distinct()


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None, per_lang: int = 3200, penalty: float = 18.0) -> Model:
    """Learn from rows with a language and a text that satisfy ``where``.

    ``per_lang`` bounds the sample of labelled documents and with it, and the number of languages, what reaches the driver: all their
    trigrams, none are dropped.
    """
    rows = docs.select(col(id).alias("id"), col(text).alias("text"), col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        rows = rows.filter(where)
    ids = sample(rows, "id", "lang", per_lang)
    chosen = rows.join(F.broadcast(ids), "id", "left_semi")  # at most per_lang ids of each language

    @tidy
    def count(batches):
        from collections import Counter

        seen: dict[str, Counter] = {}
        for b in batches:
            for t, lg in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lg, Counter())
                own[""] += 1
                for w, n in Counter(map(letters, t.split())).items():
                    if w:
                        own[f" {script(w[0])}"] += n
                        for g in trigrams(w):
                            own[g] += n
        flat = [(lg, g, n) for lg, own in seen.items() for g, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sorted(counted.collect(), key=lambda r: (r.lang, r.gram))
    size = {r.lang: r.n for r in found if r.gram == ""}
    langs = sorted(size, key=lambda x: (-size[x], x))
    at = {x: i for i, x in enumerate(langs)}
    scripts: dict[str, dict[int, int]] = {}
    grams: dict[str, int] = {}
    for r in found:
        if r.gram.startswith(" "):
            scripts.setdefault(r.gram[1:], {})[at[r.lang]] = r.n
        elif r.gram:
            grams.setdefault(r.gram, len(grams))
    counts = np.zeros((len(grams) + 1, max(1, len(langs))))
    for r in found:
        if r.gram in grams:
            counts[grams[r.gram], at[r.lang]] = r.n
    logp = np.log((counts + 0.2) / (counts.sum(0) + 0.2 * (len(grams) + 1))).astype(np.float32)
    words = {i: max(1, sum(own.get(i, 0) for own in scripts.values())) for i in range(len(langs))}
    allowed = {s: [i for i, n in own.items() if n >= 0.002 * words[i]] for s, own in scripts.items()}
    return Model(langs, [size[x] for x in langs], {s: v for s, v in allowed.items() if v}, grams, logp, penalty)


class _Words(dict):
    """Numbers for words; their scores and letters are computed once per batch of new words.

    Between batches it is emptied if it has over ``LIMIT`` words, or scores for that many in ``SCORES`` numbers.
    """

    LIMIT, SCORES = 200_000, 4_000_000

    def __init__(self, model: Model) -> None:
        self.m, self.new = model, []
        self.limit = max(1000, min(self.LIMIT, self.SCORES // max(1, len(model.langs))))
        self.scores, self.letters = np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int32)
        self.written, self.spoken = np.zeros(0, np.int32), np.zeros(0, np.int32)  # letters in a known script, and those that speak for a language
        self.even = np.log(np.maximum(1, (model.logp > model.logp[-1:]).sum(axis=0)))

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def settle(self) -> None:
        new, self.new = self.new, []
        for at in range(0, len(new), 10_000):
            self._score(new[at : at + 10_000])

    def _score(self, new: list[str]) -> None:
        m, n = self.m, len(self.m.langs)
        rows, ends, masks, lens = [], [], [], []
        unseen = len(m.grams)
        for w in new:
            own = letters(w)
            lens.append(len(own))
            if own:
                rows += [m.grams.get(g, unseen) for g in trigrams(own)]
                masks.append(script(own[0]))
            else:
                masks.append(None)
            ends.append(len(rows))
        kinds = np.diff(ends, prepend=0)
        got = np.zeros((len(new), n), np.float64)
        at, word = np.array(rows, np.int64), np.repeat(np.arange(len(new)), kinds)
        for k in range(n):  # a language at a time, whatever their number
            got[:, k] = np.bincount(word, m.logp[at, k], len(new))
        got = got.astype(np.float32)
        likely = got + kinds[:, None] * self.even[None, :] > 0
        lens, written, spoken = np.array(lens, np.int32), np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
        by_script: dict[str | None, list[int]] = {}
        for i, s in enumerate(masks):
            by_script.setdefault(s if s in m.scripts else None, []).append(i)
        for s, own in by_script.items():
            if s is None:  # no letter, or a script that no language has: it speaks for none
                got[own] = 0
                continue
            mask = m.scripts[s]
            written[own] = lens[own]
            spoken[own] = np.where(likely[np.ix_(own, mask)].any(axis=1), lens[own], 0)
            if len(mask) < n:
                low = np.repeat(got[np.ix_(own, mask)].min(axis=1, keepdims=True) - 50, n, axis=1)
                low[:, mask] = got[np.ix_(own, mask)]
                got[own] = low
        for name, x in (("scores", got), ("letters", lens), ("spoken", spoken), ("written", written)):
            setattr(self, name, np.concatenate([getattr(self, name), x]))


def viterbi(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray, penalty: float) -> np.ndarray:
    """Labels for ``ids``, the words of many texts one after the other; all texts advance together, word by word."""
    n_lang = scores.shape[1]
    labels = np.zeros(len(ids), np.int16)
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    active = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")
    stay = np.zeros((len(ids), n_lang), bool)  # at a text's word t: the best way to each label keeps it from t - 1
    best = np.zeros(len(ids), np.int16)  # the best label at each word
    v = np.zeros((len(lens), n_lang), np.float32)
    for t, k in enumerate(active):
        at, own = starts[:k] + t, v[:k]
        if t:
            top = own.max(axis=1, keepdims=True)
            switch = top - penalty
            stay[at] = own >= switch
            np.maximum(own, switch, out=own)
            own -= top
        own += scores[ids[at]]
        best[at] = own.argmax(axis=1)
    now = np.zeros(len(lens), np.int16)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        last = lens[:k] == t + 1
        nxt = at[~last] + 1
        keep = stay[nxt, now[:k][~last]]
        now[:k][last] = best[at[last]]
        rest = now[:k][~last]
        now[np.flatnonzero(~last)] = np.where(keep, rest, best[at[~last]])
        labels[at] = now[:k]
    return labels


def label_batch(texts: list[str | None], words: _Words, spans: bool) -> tuple[list[str], list[float], list[list[dict]]]:
    m = words.m
    if not m.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if len(words) > words.limit:
        words.__init__(m)
        words.clear()
    own = [np.fromiter(map(words.__getitem__, t.split() if t else []), np.int32) for t in texts]  # the words of one text at a time
    lens = np.array([len(x) for x in own], np.int64)
    ids = np.concatenate(own) if own else np.zeros(0, np.int32)
    del own
    words.settle()
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else np.zeros(0, np.int64)
    labels = viterbi(words.scores, ids, starts, lens, m.penalty)
    doc = np.repeat(np.arange(len(texts)), lens)
    share = np.zeros((len(texts), len(m.langs)))
    np.add.at(share, (doc, labels), words.written[ids])
    spoken = np.zeros_like(share)
    np.add.at(spoken, (doc, labels), words.spoken[ids])
    total = np.where(share.any(axis=1), np.bincount(doc, words.letters[ids], len(texts)), 0)
    top = share.argmax(axis=1)
    pred = [m.langs[i] if n else "und" for i, n in zip(top, total, strict=True)]
    score = [float(spoken[i, j] / n) if n else 0.0 for i, (j, n) in enumerate(zip(top, total, strict=True))]
    out: list[list[dict]] = []
    if spans:
        for i, (s, n) in enumerate(zip(starts, lens, strict=True)):
            own = labels[s : s + n] if total[i] else labels[:0]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(1, int)
            out.append([{"lang": m.langs[own[a]], "first": int(a), "end": int(b)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return pred, score, out


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``keep`` (all columns by default) and ``lang_pred``, ``lang_score`` and, if asked, ``lang_spans``, which replace columns of these names.

    A span is (lang, first, end): words from ``first`` to before ``end``, counted from 0.
    The score is the share of all letters in words labelled with the predicted language that speak for one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score", "lang_spans")]
    rows = docs.select(text_of(text).alias("text"), *[col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("lang_spans", T._parse_datatype_string("array<struct<lang:string,first:int,end:int>>")))

    @tidy
    def label(batches):
        words = _Words(model)
        for b in sliced(batches, rows=2000):
            pred, score, own = label_batch(b.column(0).to_pylist(), words, spans)
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64())] + [pa.array(own, span)] * spans
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], [*b.schema.names[1:], "lang_pred", "lang_score", *["lang_spans"] * spans])

    made = rows.mapInArrow(label, T.StructType([*rows.schema.fields[1:], *fields]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in fields])
