"""Personal data by candidate boosting, in DataFrame expressions only.

High-recall generators (regular expressions) propose spans that may overlap.  Format
and context features of each candidate go through boosted trees, compiled to one
expression; thresholds calibrated to a stated precision on held-out candidates select.
Candidates of the base patterns that pass their checks always stay; the others are
kept when they pass the threshold and overlap neither a base span nor a better one.

The trees are fitted on ``TRAIN_ROWS`` sentences made from templates with known labels,
run through the very generators and features used on documents.

Scale: everything is computed inside a row with array functions; there is no shuffle,
no key and so no skew.  Generators are written so that they read a text in linear time
(look-behind at the start of a run, possessive repeats), and places are
summed in blocks, so a text with many spans costs little more than one with few.

Defined results: a null text has no spans and stays null under redact(); rows, repeated
or with null ids, are handled one by one; an empty table gives an empty result; other
columns pass through untouched.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import boost
from quarry.llm.common import read_table

KINDS = ["email", "ip", "card", "phone"]
LEFT, RIGHT = 24, 12
TRAIN_ROWS = 3000
PRECISION = 0.99
#: No two spans of one generator overlap and none is shorter than five, so of the spans of up to SHORT code points that
#: overlap one of them each of the eight generators has fewer than 2 * SHORT / 5.
SHORT, NEIGHBOURS = 64, 210

_EMAIL, _IP, _CARD, _PHONE = range(4)
_RUN = "A-Za-z0-9._%+-"

#: The base patterns, one match after the other from the left.  (?<!...) and ++ only keep long runs from being read again and again.
BASE = [
    rf"(?:(?<![{_RUN}])|\G)[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: Wider forms: names written with (at) and (dot), bracketed dots, cards with other separators, national telephone numbers.
WIDER = [
    (_EMAIL, rf"(?i)(?<![{_RUN}])[{_RUN}]{{1,64}}+ ?[\[({{] ?at ?[\])}}] ?[a-z0-9-]{{1,63}}+(?:(?: ?[\[({{] ?dot ?[\])}}] ?|\.)[a-z0-9-]{{1,63}}+)++"),
    (_IP, r"(?<![0-9.])[0-9]{1,3}(?:[\[({]\.[\])}][0-9]{1,3}){3}(?![0-9])"),
    (_CARD, r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{2,7}(?![0-9])"),
    (_PHONE, r"(?<![0-9A-Za-z.+#/-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z/-])"),
]
_CUES = [r"mail|contact|write", r"(?:^|[^a-z])ip|host|server|address", r"card|visa|credit|pay", r"tel|phone|call|fax|mobil|contact|ring"]
_COUNTER_CUES = r"order|isbn|version|serial|invoice|item|ref|page|part|code|model|batch"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(
        F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _octets_ok(text: Column) -> Column:
    """Every number at most 255, however many zeros lead it."""
    return ~text.rlike(r"(?:^|[^0-9])0*+(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?![0-9])")


def _passes(kind: int, text: Column) -> Column:
    n = F.length(_digits(text))
    return [
        F.lit(True),
        _octets_ok(text),
        F.when(n.between(14, 19), _luhn(_digits(text))).otherwise(False),
        n.between(10, 15),
    ][kind]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """At each place of an array what add makes of zero and all values before it.  Blocks of the root of its size, so that time grows as size ** 1.5."""

    def blocked(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda b: F.slice(v, b * step + 1, step))

    def within(block: Column, start: Column) -> Column:
        return F.transform(block, lambda x, k: F.aggregate(F.slice(block, 1, k), start, add))

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, zero, add))
        return let(sums, lambda t: F.flatten(F.transform(blocks, lambda x, i: let(F.aggregate(F.slice(t, 1, i), zero, add), lambda start: within(x, start)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocked(v), summed)).otherwise(v))


def _matches(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """Array of the pattern's matches with place and context, from the matches and the parts between them."""
    rows = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(a: Column) -> Column:
        """A match starts after the parts and matches before it."""
        first = F.length(F.get(a["p"], F.lit(0)))
        steps = F.transform(a["m"], lambda m, i: F.length(m) + F.length(F.get(a["p"], i + 1)))
        return let(before(steps, F.lit(0), lambda x, y: x + y), lambda at: F.transform(a["m"], lambda m, i: one(a, m, i, first + F.get(at, i))))

    def one(a: Column, m: Column, i: Column, s: Column) -> Column:
        return F.struct(
            s.alias("s"), F.lit(kind).alias("k"), (s + F.length(m)).alias("e"), m.alias("t"), F.right(F.get(a["p"], i), F.lit(LEFT)).alias("l"),
            F.left(F.get(a["p"], i + 1), F.lit(RIGHT)).alias("r"), F.lit(base).alias("base"), _passes(kind, m).alias("ok"),
        )

    return let(rows, placed)


_NONE = "array<struct<s:int,k:int,e:int,t:string,l:string,r:string,base:boolean,ok:boolean>>"
_NEEDS = ["@", ".", None, "+"]


def candidates(text: Column) -> Column:
    """All proposed spans of a text; base ones only where they pass their checks."""
    none = F.array().cast(_NONE)
    every = [
        F.when(F.contains(text, F.lit(need)) if need else F.lit(True), F.filter(_matches(text, pattern, kind, True), lambda c: c["ok"])).otherwise(none)
        for kind, (pattern, need) in enumerate(zip(BASE, _NEEDS))
    ]
    every += [_matches(text, pattern, kind, False) for kind, pattern in WIDER]
    return F.when(text.rlike(r"[0-9@]|(?i:[\[({] ?at ?[\])}])"), F.concat(*every)).otherwise(none)


def features(c: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    left, digits = F.lower(c["l"]), _digits(c["t"])
    cue = F.lit(False)
    for kind, words in enumerate(_CUES):
        cue = cue | ((c["k"] == kind) & left.rlike(words))
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return [
        number(c["k"]),
        number(F.length(digits)),
        number(F.length(c["t"])),
        number(F.length(F.regexp_replace(c["t"], "[A-Za-z0-9]", ""))),
        number(F.contains(c["t"], F.lit("("))),
        number(c["ok"]),
        number(cue),
        number(left.rlike(_COUNTER_CUES)),
        number(left.rlike(r"[0-9][ .,/-]?$")),
        number(c["r"].rlike(r"^[ .,/-]?[0-9]")),
        number(c["base"]),
    ]


def training_texts(rows: int, seed: int = 11) -> list[tuple[str, int]]:
    """Sentences with one wider form each, and whether it is personal data."""
    rng, out = random.Random(seed), []
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def card(n: int) -> str:
        body = [int(x) for x in d(n - 1)]
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(body)))
        return "".join(map(str, body)) + str(-total % 10)

    def grouped(s: str, sep: str) -> str:
        return sep.join([s[0:4], s[4:8], s[8:12], s[12:]])

    good_lead = {_EMAIL: ["email", "mail me at", "contact", ""], _IP: ["server", "host", "ip", ""], _CARD: ["card", "visa", "pay with", ""], _PHONE: ["tel", "call", "phone", "fax", "mobile", ""]}
    bad_lead = ["order", "isbn", "version", "serial", "invoice", "item", "ref", "page", "part", "code", "model", "batch"]
    for _ in range(rows):
        kind, good, sep = rng.randrange(4), rng.random() < 0.5, rng.choice("._/")
        if kind == _EMAIL:
            t = f"{word()}.{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'net'])}" if good else f"{word()} (at) {d(2)}.{d(2)}"
        elif kind == _IP:
            t = "[.]".join(str(rng.randint(0, 255) if good else rng.randint(256, 999)) for _ in range(4))
        elif kind == _CARD:
            n = rng.choice([15, 16, 19])
            t = grouped(card(n) if good else d(n), sep)
        else:
            t = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]) if good else rng.choice([f"{d(2)}-{d(3)}-{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
        lead = rng.choice(good_lead[kind]) if good else rng.choice(bad_lead)
        out.append((f"{word()} {word()} {lead} {t} {word()} {word()}.", int(good)))
    return out


_MODEL: dict[str, tuple] = {}


def model(spark: SparkSession) -> tuple[list, list[float]]:
    """The trees, and a threshold per kind."""
    if "model" not in _MODEL:
        made = spark.createDataFrame(training_texts(TRAIN_ROWS), "text string, y int")
        rows = (
            made.select("y", F.explode(candidates(F.col("text"))).alias("c"))
            .filter(~F.col("c.base"))
            .select("y", F.array(*features(F.col("c"))).alias("x"))
            .collect()
        )
        x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
        half = np.arange(len(y)) % 2 == 0
        trees = boost.fit(x[half], y[half], trees=16, depth=3)
        s = boost.log_odds(trees, x[~half])
        limits = [boost.threshold(s[x[~half][:, 0] == k], y[~half][x[~half][:, 0] == k], PRECISION) for k in range(4)]
        _MODEL["model"] = trees, limits
    return _MODEL["model"]


def with_spans(docs: DataFrame, text: str = "text", out: str = "_q_spans") -> DataFrame:
    """Adds an array of the selected spans (s, k, e, base), sorted by start, kind and end."""
    trees, limits = model(docs.sparkSession)
    proposed = F.transform(
        candidates(F.col(text)),
        lambda c: F.struct(
            c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base"),
            F.when(c["base"], 1e9).otherwise(boost.to_column(trees, features(c))).alias("score"),
        ),
    )
    limit = F.array(*(F.lit(x) for x in limits))
    chosen = F.array_sort(F.filter(proposed, lambda c: c["base"] | (c["score"] >= F.get(limit, c["k"]))))
    overlaps = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["k"] < b["k"]))))
    long = lambda c: c["e"] - c["s"] > SHORT

    def alone(every: Column) -> Column:
        """The base spans, and the others that overlap no better one.  Two short spans that overlap stand near each other in the order of their starts."""

        def rivals(c: Column, i: Column, longs: Column) -> Column:
            return F.when(long(c), every).otherwise(F.concat(F.slice(every, F.greatest(F.lit(1), i + 1 - NEIGHBOURS), F.lit(2 * NEIGHBOURS + 1)), longs))

        kept = let(F.filter(every, long), lambda longs: F.filter(every, lambda c, i: c["base"] | ~F.exists(rivals(c, i, longs), lambda o: overlaps(o, c) & better(o, c))))
        return F.when(F.forall(every, lambda c: c["base"]), every).otherwise(kept)

    plain = F.transform(let(chosen, alone), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base")))
    none = F.array().cast("array<struct<s:int,k:int,e:int,base:boolean>>")
    return docs.withColumn(out, F.coalesce(plain, none))


def written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each selected span of the text replaced by its kind in brackets; overlapping spans become one mark."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    t = F.col(text)


    def replaced(spans: Column) -> Column:
        """What stands before each span that starts a mark, and the mark; then the rest."""
        ends = F.transform(spans, lambda c: c["e"])
        latest = lambda x, y: F.greatest(x, y)

        def piece(at: Column, c: Column, i: Column) -> Column:
            start = F.get(at, i)
            return F.when(c["s"] >= start, F.concat(F.substr(t, start + 1, c["s"] - start), F.get(names, c["k"]))).otherwise("")

        pieces = let(before(ends, F.lit(0), latest), lambda at: F.array_join(F.transform(spans, lambda c, i: piece(at, c, i)), ""))
        return F.concat(pieces, F.substr(t, F.array_max(ends) + 1))

    return with_spans(docs, text).withColumn(text, F.when(F.size("_q_spans") > 0, let(F.col("_q_spans"), replaced)).otherwise(t)).drop("_q_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_q_spans", lambda c: c["base"])
    count = lambda k: F.size(F.filter("_q_spans", lambda c: c["base"] & (c["k"] == k))).cast("bigint")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col("_q_spans")).alias("spans"),
        F.size("_q_spans").cast("bigint").alias("n_spans"),
    )
