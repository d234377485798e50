"""Secret scan: three base rules, and character Markov models of random strings and of ordinary identifiers.

The models are tables of transitions between ASCII symbols, one for each kind of random strings (such as base 64) and of ordinary
ones (such as dates), trained from labelled strings. A run of token characters that no base rule covers is a secret if its
log-likelihood ratio, the likeliest random kind against the likeliest ordinary one, exceeds a threshold in total bits and one for
each symbol. A UUID counts as ordinary by its form: it names things more often than it guards them. All of it is DataFrame functions: split() and
regexp_extract_all() give the gaps and the matches of a pattern, and their running lengths give positions in code points.

A null text counts as empty and has no span; whole texts are scanned. Each row is scanned on its own, so repeated rows get
equal results; extra columns of any name pass through ``scan`` (one called ``secrets`` is replaced) and an empty table gives an empty one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, text_of

#: kind: pattern, least length, and the group whose length counts; in the order in which spans of one start are listed.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (r"[0-9a-f]{16,}+", 16, 0),  # a run of less never holds a match, so the bound can be in the pattern
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates of the method: whole runs of token characters that are no UUID.
UUID = r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
WORDS = (
    "get set user name by id list find all count create update delete remove item value key index page size number total date time start end type "
    "status code message error request response client server handler manager service factory builder config option default parse format string "
    "integer float boolean array object class method function return import export module package version update check validate token access public "
    "private static final session account customer order product price amount payment address email phone country city street zip state session "
    "is has can should with from into for and not empty null true false max min sum average first last next previous current new old source target"
).split()


KINDS = "array<struct<kind:string,start:int,end:int>>"


def labelled(spark: SparkSession, docs: DataFrame | None = None, *, text: str = "text", generated: int = 8000, rows: int = 2000) -> DataFrame:
    """(token, random, kind): labelled samples to train from.

    Random ones are digests written in hexadecimal, in capitals, letters and digits, and base 64 of two alphabets. Ordinary ones are identifiers joined from
    common words, with and without numbers, in paths and in parts of several styles, dates and times, and one symbol repeated; and, if ``docs`` are
    given, token runs of about ``rows`` of their texts where no rule matches: those whose hash is below the bound that leaves so
    many. Runs of 16 or more symbols with a digit may be what is looked for, so they are no samples.
    """
    n = spark.range(generated).withColumn("i", (F.col("id") / 8).cast("int")).withColumn("h", F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256))
    cut = (F.col("i") % 41 + 16).cast("int")
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat("h", F.sha2(F.col("h"), 256)))), "=+$", "")
    words = F.split(F.lit(" ".join(WORDS)), " ")
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    pick = lambda k: F.element_at(words, (draw(k, len(WORDS)) + 1).cast("int"))
    padded = lambda c, w: F.lpad(c.cast("string"), w, "0")
    name = F.when(draw(4, 2) == 0, F.concat_ws("_", pick(1), pick(2), pick(3))).otherwise(F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3))))
    sign = F.element_at(F.array(*[F.lit(x) for x in ("-", "_", "/", "", "T")]), (draw(5, 5) + 1).cast("int"))
    date = F.concat_ws("-", (draw(6, 60) + 1970).cast("string"), padded(draw(7, 12) + 1, 2), padded(draw(8, 28) + 1, 2))
    clock = F.concat_ws("-", padded(draw(9, 24), 2), padded(draw(10, 60), 2), padded(draw(11, 60), 2))
    time = F.concat(date, sign, clock)
    mark = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("-", "_", "/", "")]), (draw(k, 4) + 1).cast("int"))
    symbol = F.substring(F.lit(ALPHABET), (F.col("i") % len(ALPHABET) + 1).cast("int"), F.lit(1))
    made = {
        ("hex", True): F.when(F.col("i") % 2 == 0, F.substring("h", F.lit(1), cut)).otherwise(F.upper(F.substring("h", F.lit(1), cut))),
        ("capitals", True): F.upper(F.translate(base64, "+/", "7Q")).substr(F.lit(1), cut),
        ("alphanumeric", True): F.translate(base64, "+/", "b9").substr(F.lit(1), cut),
        ("base64", True): F.when(F.col("i") % 2 == 0, base64).otherwise(F.translate(base64, "+/", "-_")).substr(F.lit(1), cut),
        ("name", False): F.when(F.col("i") % 2 == 0, name).otherwise(F.regexp_replace(F.concat(name, F.lit("_"), draw(12, 10000).cast("string")), "_(?=[0-9]$)", "")),
        ("constant", False): F.upper(F.concat_ws("_", pick(1), pick(2), pick(3))),
        ("path", False): F.concat_ws("/", pick(1), F.concat_ws("-", pick(2), pick(3)), F.when(draw(13, 2) == 0, pick(14)).otherwise(date), pick(15)),
        ("parts", False): F.concat(F.upper(F.substring(pick(1), 1, 2)), mark(16), F.initcap(pick(2)), mark(17), pick(3), draw(18, 10).cast("string"), mark(19), F.initcap(pick(14)), F.initcap(pick(15))),
        ("number", False): F.when(F.col("i") % 3 == 0, time).when(F.col("i") % 3 == 1, F.regexp_replace(time, "-", "")).otherwise(F.concat_ws("_", F.upper(F.substring(pick(1), 1, 3)), F.regexp_replace(date, "-", ""), F.regexp_replace(clock, "-", ""), padded(draw(12, 10000), 4))),
        ("symbol", False): F.repeat(symbol, 40),
    }
    each = F.array(*[F.struct(token.alias("token"), F.lit(random).alias("random"), F.lit(kind).alias("kind")) for (kind, random), token in made.items()])
    found = n.filter("id % 8 = 0").select(F.explode(each).alias("x")).select("x.*")
    if docs is not None:
        texts = docs.select(text_of(text).alias("t"), F.xxhash64(text_of(text)).alias("h"))
        share = min(1.0, rows / max(1, docs.count()))
        # copies of a text are one before they are sent anywhere
        texts = texts.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("h").agg(F.first("t").alias("t")).select("t")
        for pattern, _, _ in RULES.values():
            texts = texts.withColumn("t", F.regexp_replace("t", pattern, " "))
        runs = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), 0)).alias("token"))
        runs = runs.filter(~F.col("token").rlike("[0-9]") | (F.length("token") < 16))
        found = found.unionByName(runs.select("token", F.lit(False).alias("random"), F.lit("corpus").alias("kind")))
    return found


@dataclass(frozen=True)
class Model:
    """Of each kind of strings: whether it is random, and the log-probabilities, in bits, by (previous symbol + 1) * 67 + symbol."""

    random: tuple[bool, ...]
    tables: tuple[tuple[float, ...], ...]


def train(samples: DataFrame, smoothing: float = 0.1) -> Model:
    """A Markov model of each kind of strings; previous symbol -1 is the start.

    ``samples`` has token, random (boolean) and, if there are several kinds, kind; other characters are left out, and null tokens or labels
    ignored. Only counts of pairs reach the driver, at most 68 * 67 of each kind.
    """
    kind = F.col("kind") if "kind" in samples.columns else F.lit("")
    pairs = samples.filter("token is not null and random is not null").select("random", F.coalesce(kind, F.lit("")).alias("kind"), F.concat(F.lit("^"), F.regexp_replace("token", r"[^A-Za-z0-9+/_=-]", "")).alias("t"))
    pairs = pairs.select("random", "kind", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring("t", i, F.lit(2)))).alias("pair")).filter(F.length("pair") == 2)
    counts: dict[tuple, dict[str, int]] = {(True, ""): {}, (False, ""): {}}
    for r in pairs.groupBy("random", "kind", "pair").count().collect():
        counts.setdefault((r.random, r.kind), {})[r.pair] = r["count"]
    counts = {k: own for k, own in sorted(counts.items()) if own or sum(k[0] == x[0] for x in counts) == 1}
    tables = []
    for own in counts.values():
        table = []
        for a in "^" + ALPHABET:
            total = sum(own.get(a + c, 0) for c in ALPHABET) + smoothing * len(ALPHABET)
            table += [round(math.log2((own.get(a + c, 0) + smoothing) / total), 6) for c in ALPHABET]
        tables.append(tuple(table))
    return Model(tuple(k[0] for k in counts), tuple(tables))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(x: Column) -> Column:
    """The array, which must be a name, cut into about as many arrays as each has elements."""
    step = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda k: F.slice(x, k * step + 1, step))).otherwise(F.array())


def _running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number, those before it taken together by ``op``, from 0 on.

    Within chunks, and over chunks: an array that grows by one element is copied each time, so that n elements take n to the power of 1.5.
    """
    zero, none = F.lit(0), F.array().cast("array<int>")

    def walk(own: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("out"))
        return F.aggregate(own, start, lambda acc, v: F.struct(op(acc["at"], v).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def joined(chunks: Column) -> Column:
        before = walk(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, v: op(a, v).cast("int"))))
        return F.flatten(F.zip_with(chunks, before, lambda c, at: F.transform(walk(c), lambda v: op(v, at).cast("int"))))

    return _let(x, lambda own: _let(_chunks(own), joined))


def _matches(text: Column, pattern: str, least: int, group: int, kind: str, *, token: bool = False) -> Column:
    """array<struct<kind, start, end>> of a pattern's matches whose group is long enough, with ``token`` also the match itself."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    of = F.transform(F.regexp_extract_all(text, F.lit(pattern), group), F.length) if group else F.array().cast("array<int>")
    both = F.arrays_zip(gaps.alias("gap"), whole.alias("x"), of.alias("of"))
    # a match starts after the gaps up to it and the matches before it; after the last gap comes none
    row = lambda v: F.struct((v["gap"] + F.coalesce(F.length(v["x"]), F.lit(0))).alias("step"), F.length(v["x"]).alias("n"), (v["of"] if group else F.length(v["x"])).alias("of"), v["x"].alias("x"))

    def spans(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda v: v["step"]), lambda a, v: a + v)
        return F.zip_with(rows, ends, lambda v, at: F.struct(F.lit(kind).alias("kind"), (at + v["step"] - v["n"]).cast("int").alias("start"), (at + v["step"]).cast("int").alias("end"), v["of"].alias("of"), v["x"].alias("x")))

    found = F.filter(_let(F.transform(both, row), spans), lambda v: F.coalesce(v["of"] >= least, F.lit(False)))
    found = F.transform(found, lambda v: F.struct(v["kind"].alias("kind"), v["start"].alias("start"), v["end"].alias("end"), *[v["x"].alias("x")] * token))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,x:string>>" if token else KINDS))


def _bits(token: Column, model: Model) -> Column:
    """The log-probability of a token in the likeliest random kind less that in the likeliest ordinary one."""
    table = F.from_json(F.lit(json.dumps([[t[i] for t in model.tables] for i in range(len(model.tables[0]))])), "array<array<double>>")  # one constant
    symbols = F.filter(F.split(token, ""), lambda c: c != "")
    place = F.transform(symbols, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.array(*[F.lit(0.0)] * len(model.random)).alias("sums"))
    sums = F.aggregate(place, start, lambda acc, c: F.struct(c.cast("int").alias("last"), F.zip_with(acc["sums"], F.get(table, (acc["last"] + 1) * len(ALPHABET) + c), lambda x, y: x + y).alias("sums")), lambda acc: acc["sums"])
    best = lambda own, random: F.array_max(F.array(*[F.get(own, F.lit(i)) for i, r in enumerate(model.random) if r == random]))
    return _let(sums, lambda own: best(own, True) - best(own, False))


def scan(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 20.0, per_symbol: float = 0.5) -> DataFrame:
    """Adds ``secrets``, in place of a column of that name: array<struct<kind, start, end>> ordered by start and, at one start, by kind as listed, ``markov`` last.

    Positions are code points, ends exclusive. ``threshold`` is the least ratio, in bits, of a span of the method, and ``per_symbol`` the least for each
    of its symbols.
    """
    rows = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], text_of(text).alias("t"))
    for kind, (pattern, least, group) in RULES.items():
        rows = rows.withColumn(kind, _matches(F.col("t"), pattern, least, group, kind))
    rows = rows.withColumn("runs", _matches(F.col("t"), CANDIDATE, 16, 0, "markov", token=True))
    # of one kind spans are in order and apart, so a chunk of them is a range
    ranges = [F.transform(_chunks(F.col(k)), lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"), c.alias("own"))) for k in RULES]
    rows = rows.withColumn("ranges", F.when(F.size("runs") > 0, F.concat(*ranges)))
    meets = lambda r, b: (b["start"] < r["end"]) & (b["end"] > r["start"])
    free = F.filter("runs", lambda r: ~F.exists("ranges", lambda c: meets(r, c) & F.exists(c["own"], lambda b: meets(r, b))))
    rows = rows.withColumn("free", F.when(F.size("runs") > 0, free).otherwise(F.col("runs")))
    chosen = F.filter("free", lambda r: ~r["x"].rlike(UUID) & (_bits(r["x"], model) > F.greatest(F.lit(threshold), per_symbol * F.length(r["x"]))))
    own = F.when(F.size("free") > 0, chosen).otherwise(F.col("free"))
    rows = rows.withColumn("own", F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate([*RULES, "markov"]) for x in (k, i)])
    keyed = F.array_sort(F.transform(F.concat(*RULES, "own"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "secrets"], found.alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(scanned: DataFrame, *, text: str = "text", mark: str = "[secret]", secrets: str = "secrets") -> DataFrame:
    """The text with every span, overlapping ones together, replaced by ``mark``; a text without one is untouched."""
    t, spans = col(text), col(secrets)
    before = _running(F.transform(spans, lambda s: s["end"]), F.greatest)  # the end of what comes earlier
    pieces = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(t, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit("")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    whole = F.concat(F.array_join(pieces, ""), F.substring(t, last + 1, F.length(t) - last))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(t))
