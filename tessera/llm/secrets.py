"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

Base kinds are assign, access and hex, each leftmost and non-overlapping. The method looks
at every run of 20 or more characters of `[A-Za-z0-9+/_=-]` and infers its encoding (hex,
base32, letters of one case or two, letters and digits, base64; digits alone are a number,
whose randomness says nothing). A token is a secret if it passes two stages:

1. Its symbols agree with a uniform source over the encoding's alphabet: chi-squared over
   the alphabet (concentration), runs about the middle of the alphabet and lag-one serial
   correlation, combined as three times the smallest p-value, which must reach ``level``.
2. It is no prose. Against the letter frequencies of all texts, case folded, its letters
   must be too unlikely (a normal test of their mean log frequency; for hex, the chance that
   all letters are a to f), and if its encoding mixes classes, upper case, lower case, digits
   and marks must change more often than in words put together (a binomial test at
   ``CHANGES`` changes a place). The p-values combine by Fisher's rule.

The second p-value is of the null that a false secret obeys, so what is emitted is what
Benjamini-Hochberg rejects at rate ``rate``, and the rate bounds the expected share of prose
among the added spans. It runs over all tokens of a length class that no base span holds, in
which tokens that fail the first stage count with p of one; short tokens, whose tests are weak
and many, so don't share a threshold with long ones. No length decides: a short token of
lower-case letters is found if its letters are unlikely enough.

Letter counts and the histogram (length class by p class) are of fixed size. All main-path
work is DataFrame functions. Null and empty texts have no spans; rows are scanned one by
one, so repeated ids and rows are fine; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, materialize
from tessera.llm.spans import match_spans

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are maximal, so asking for 24 at once finds the same places as dropping shorter ones.
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
MARKS = "+/-_="
#: Encoding: what a token of it looks like, its alphabet in order, and how prose is told from it:
#: by its letters, by letters and changes of class, by staying within a to f and changes; none for numbers.
ENCODINGS = [
    ("decimal", r"^[0-9]+$", DIGITS, "none"),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef", "within"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF", "within"),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+$", LETTERS.upper() + "234567", "mixed"),
    ("lower", r"^[a-z]+$", LETTERS, "letters"),
    ("upper", r"^[A-Z]+$", LETTERS.upper(), "letters"),
    ("letters", r"^[A-Za-z]+$", LETTERS.upper() + LETTERS, "mixed"),
    ("lower_digits", r"^[a-z0-9]+$", LETTERS + DIGITS, "mixed"),
    ("upper_digits", r"^[A-Z0-9]+$", LETTERS.upper() + DIGITS, "mixed"),
    ("alphanumeric", r"^[A-Za-z0-9]+$", LETTERS.upper() + LETTERS + DIGITS, "mixed"),
    ("base64", r"^.*$", LETTERS.upper() + LETTERS + DIGITS + MARKS, "mixed"),
]
LENGTH_CLASSES = [24, 32, 48, 64, 128, 256]
P_CLASSES, P_STEP = 320, 20
#: Changes of class a place in words put together by case, marks or numbers; more than that is unlike prose.
CHANGES = 0.25


def _tail(z: Column) -> Column:
    """Normal tail above z by the logistic approximation."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _two_sided(z: Column) -> Column:
    return 2 * _tail(F.abs(z))


def randomness_p(token: Column, alphabet: Column) -> Column:
    """The battery's combined p-value for a token of 20 or more characters."""
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    chars = F.split(token, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    concentrated = F.when(chi > 0, _two_sided(chi)).otherwise(F.lit(1.0))
    x = F.transform(chars, lambda c: F.call_function("instr", alphabet, c).cast("double") - 1)
    zero = F.struct(*[F.lit(v).alias(f) for f, v in (("s", 0.0), ("q", 0.0), ("c", 0.0), ("last", -1.0), ("first", -1.0), ("up", 0.0), ("runs", 0.0))])

    def step(a: Column, v: Column) -> Column:
        high, was = v >= k / 2, a["last"] >= k / 2
        new = (a["last"] < 0) | (high != was)
        return F.struct(
            (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), (a["c"] + F.when(a["last"] < 0, 0.0).otherwise(a["last"] * v)).alias("c"), v.alias("last"),
            F.when(a["first"] < 0, v).otherwise(a["first"]).alias("first"), (a["up"] + F.when(high, 1.0).otherwise(0.0)).alias("up"), (a["runs"] + F.when(new, 1.0).otherwise(0.0)).alias("runs"),
        )

    def finish(a: Column) -> Column:
        m = a["s"] / n
        spread = a["q"] - n * m * m
        # sum of (x_i - m)(x_i+1 - m) over neighbours
        cross = a["c"] - m * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * m * m
        serial = F.when(spread > 0, _two_sided((cross / spread + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
        mean = 2 * a["up"] * (n - a["up"]) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(var > 0, _two_sided((a["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), 3 * F.least(concentrated, serial, runs))

    return F.aggregate(x, zero, step, finish)


def letter_counts(docs: DataFrame, text_col: str) -> dict[str, int]:
    """How often each letter a to z stands in all texts, case folded."""
    letters = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return {r["c"]: r["n"] for r in letters.where(F.col("c").isin(list(LETTERS))).collect()}  # 26 at most


def prose_p(token: Column, kind: Column, counts: dict[str, int]) -> Column:
    """The p-value of a token under the null that it is prose with these letter counts; kind is the last field of its encoding."""
    total = sum(counts.values()) + 0.5 * len(LETTERS)
    share = {c: (counts.get(c, 0) + 0.5) / total for c in LETTERS}
    mean = sum(f * math.log(f) for f in share.values())
    var = max(sum(f * math.log(f) ** 2 for f in share.values()) - mean * mean, 1e-6)
    logs = F.create_map(*[x for c, f in share.items() for x in (F.lit(c), F.lit(math.log(f)))])
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    n_letters = F.length(letters).cast("double")
    said = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(logs, c), F.lit(0.0)))
    unlikely = F.when(n_letters > 0, _tail((n_letters * mean - said) / F.sqrt(n_letters * var))).otherwise(F.lit(1.0))
    within = F.pow(F.lit(sum(share[c] for c in "abcdef")), n_letters)
    pairs = F.length(token).cast("double") - 1
    changes = F.regexp_count(token, F.lit(r"(?<=[a-z])(?![a-z])(?!$)|(?<=[A-Z])(?![A-Z])(?!$)|(?<=[0-9])(?![0-9])(?!$)|(?<=[-+/_=])(?![-+/_=])(?!$)")).cast("double")
    restless = _tail((changes - 0.5 - pairs * CHANGES) / F.sqrt(pairs * CHANGES * (1 - CHANGES)))
    both = lambda p: let(F.greatest(p * restless, F.lit(1e-300)), lambda q: F.least(F.lit(1.0), q * (1 - F.log(q))))
    return F.when(kind == "letters", unlikely).when(kind == "within", both(within)).when(kind == "mixed", both(unlikely)).otherwise(F.lit(1.0))


def _encoding(token: Column, what: int) -> Column:
    out = F.lit(ENCODINGS[-1][what])
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(e[1]), F.lit(e[what])).otherwise(out)
    return out


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan_table(docs: DataFrame, id_col: str, text_col: str, counts: dict[str, int], level: float) -> DataFrame:
    """doc_id, base (kind, start, end) and tokens outside them (start, end, p, class) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,value:string>>)")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(
        "doc_id",
        F.when(text.rlike(ASSIGN), F.filter(match_spans(text, ASSIGN, group=3), lambda s: F.length(s["value"]) >= 6)).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), F.filter(match_spans(text, ACCESS), lambda s: F.length(s["hit"]) >= 20)).otherwise(none).alias("access"),
        F.when(text.rlike("[0-9a-f]{24}"), match_spans(text, HEX)).otherwise(none).alias("hex"),
        F.when(text.rlike(TOKEN), match_spans(text, TOKEN)).otherwise(none).alias("long"),
    )
    kinds = F.flatten(F.array(*[_of_kind(F.col(kind), i) for i, kind in enumerate(KINDS[:3])]))
    length = lambda s: F.length(s["hit"])
    klass = lambda s: sum((F.when(length(s) >= c, 1).otherwise(0) for c in LENGTH_CLASSES[1:]), F.when(length(s) >= LENGTH_CLASSES[0], 1).otherwise(0))
    p = lambda s: F.when(randomness_p(s["hit"], _encoding(s["hit"], 2)) >= level, prose_p(s["hit"], _encoding(s["hit"], 3), counts)).otherwise(F.lit(1.0))
    rows = rows.select("doc_id", kinds.alias("base"), "long")
    inside = lambda t: F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"]))
    tokens = F.transform(F.filter("long", lambda t: ~inside(t)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), p(s).alias("p"), klass(s).alias("class")))
    return rows.select("doc_id", "base", tokens.alias("tokens"))


def false_discovery_thresholds(histogram: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg over (length class, p class, tokens): the lowest p class that is a discovery, by length class.

    p class c holds p from 10**-((c + 1) / P_STEP) to 10**-(c / P_STEP); its upper end stands for it.
    """
    out: dict[int, int] = {}
    for cls in {h[0] for h in histogram}:
        own = sorted(((c, n) for k, c, n in histogram if k == cls), reverse=True)
        total, seen, lowest = sum(n for _, n in own), 0, P_CLASSES + 1
        for c, n in own:
            seen += n
            if 10 ** -(c / P_STEP) <= rate * seen / total:
                lowest = c
        out[cls] = lowest
    return out


def p_class(p: Column) -> Column:
    return F.least(F.lit(P_CLASSES), F.floor(-F.log10(F.greatest(p, F.lit(1e-16))) * P_STEP)).cast("int")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, level: float = 0.001) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind index, end, sorted) of every row."""
    table = materialize(scan_table(docs, id_col, text_col, letter_counts(docs, text_col), level), "secret-scan")
    token = table.select(F.explode("tokens").alias("t"))
    counted = token.groupBy(F.col("t.class").alias("class"), p_class(F.col("t.p")).alias("p")).count()
    limits = false_discovery_thresholds([tuple(r) for r in counted.collect()], rate)

    def random(t: Column) -> Column:
        bound = F.lit(P_CLASSES + 1)
        for cls, c in limits.items():
            bound = F.when(t["class"] == cls, F.lit(c)).otherwise(bound)
        return p_class(t["p"]) >= bound

    added = _of_kind(F.filter("tokens", random), len(KINDS) - 1)
    return table.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
