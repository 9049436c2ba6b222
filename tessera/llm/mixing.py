"""Mixing to target weights with soft domain membership.

A naive Bayes classifier is fitted on labelled documents (a sample of about ``fit_rows``,
chosen by hash): Gaussian terms for shape measures, word terms for the ``lexicon`` words that
separate the domains most, and for each domain whether the text has any of its telling ones,
as their absence tells too. It gives every document a posterior over domains.
Nonnegative document rates are then fitted by projected-gradient least squares so that
expected tokens by domain (rate x posterior x tokens, summed) meet the targets. Each step
is one aggregation over the cluster; the gradient is scaled by the inverse of the small
domain-by-domain Gram matrix, of the documents whose rate can still move where that halves the
distance and of all documents otherwise, and rates are projected to 0..max_rate. A rate depends on the
steps only through the few numbers of each step's gradient, so none is sent to the driver.
Steps go on until the targets are met or stand still; what stays unmet is reported.

A document is emitted floor(rate) times, and once more with the fraction as probability,
drawn from a hash of its id and text, so repeated rows get equal draws.

All main-path work is DataFrame functions. Null and empty texts have no words and no tokens:
their rate is that of their posterior, and they don't count towards targets. Labelled rows with
a null id or domain teach nothing. Domains without a labelled document are left out and the remaining targets scaled up; without any, every
rate is 1. Empty tables give no rows. Other columns are carried along untouched, in a struct
of their own, so no name clashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, lower_ascii, materialize, own_columns, plain_words

SHAPES = ["symbols", "capitals", "digits", "variety", "word_length", "log_words"]


@dataclass
class DomainModel:
    """log prior and Gaussian terms by domain, and for each lexicon word the log of its share of the domain's words over its share of all words.

    markers: for each domain its telling words, and log odds of a text of each domain having
    one of them and having none.
    """

    domains: list[str]
    bias: list[float]
    mean: list[list[float]]
    var: list[list[float]]
    lexicon: dict[str, list[float]]
    markers: list[tuple[list[str], list[float], list[float]]] = field(default_factory=list)


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __words (distinct lower-cased words), __tokens and the shape measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({
        "__all": plain_words(lower_ascii(text)),
        "__chars": F.greatest(F.char_length(text), F.lit(1)).cast("double"),
        "__symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>!]")),
        "__capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "__digits": F.regexp_count(text, F.lit("[0-9]")),
    })
    rows = rows.withColumns({"__words": F.array_distinct("__all"), "__tokens": F.size("__all").cast("long")})
    n = F.greatest(F.col("__tokens"), F.lit(1)).cast("double")
    return rows.withColumns({
        "__symbols": F.col("__symbols") / F.col("__chars"), "__capitals": F.col("__capitals") / F.col("__chars"), "__digits": F.col("__digits") / F.col("__chars"),
        "__variety": F.size("__words") / n, "__word_length": F.col("__chars") / n, "__log_words": F.log(n),
    }).drop("__all", "__chars")


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, lexicon: int = 200) -> DomainModel | None:
    """Fit on about ``fit_rows`` labelled documents; ``domain`` is an expression over the labels table."""
    known = labels.select(F.col(id_col).alias("__id"), domain.alias("__domain")).where(F.col("__id").isNotNull() & F.col("__domain").isNotNull()).dropDuplicates(["__id"])
    total = known.count()
    if not total:
        return None
    share = min(1.0, fit_rows / total)
    known = known.where(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(known, "__id")
    rows = materialize(_measured(rows, "__text").drop("__text"), "labelled")
    stats = [F.count(F.lit(1)).alias("n"), F.greatest(F.sum(F.size("__words")), F.lit(1)).alias("words")] + [f(f"__{s}").alias(f"{s}_{k}") for s in SHAPES for k, f in (("mean", F.avg), ("var", F.var_pop))]
    found = rows.groupBy("__domain").agg(*stats).orderBy("__domain").collect()
    if not found:
        return None
    domains, n, size = [r["__domain"] for r in found], [r["n"] for r in found], [r["words"] for r in found]
    in_domain = [F.count_if(F.col("__domain") == d).alias(f"c{i}") for i, d in enumerate(domains)]
    words = rows.select("__domain", F.explode("__words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"), *in_domain).where("c >= 5")
    gain = sum((F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") * F.log(F.col(f"c{i}") / F.col("c") * (sum(size) / size[i]))).otherwise(0.0) for i in range(len(domains))), F.lit(0.0))
    best = words.orderBy(gain.desc(), "word").limit(lexicon).collect()
    # Shares of a domain's words, not of its documents: long documents then don't look like the domain of long ones.
    odds = np.array([[math.log((r[f"c{i}"] + 0.5) / (size[i] + 1.0) / (r["c"] / sum(size))) for i in range(len(domains))] for r in best]).reshape(len(best), len(domains))
    telling = [[r["word"] for k, r in enumerate(best) if odds[k][i] > math.log(2)] for i in range(len(domains))]
    has = rows.groupBy("__domain").agg(*[F.count_if(F.exists("__words", _among(own)) if own else F.lit(False)).alias(f"a{i}") for i, own in enumerate(telling)]).orderBy("__domain").collect()
    chance = np.array([[(r[f"a{i}"] + 0.5) / (n[d] + 1.0) for d, r in enumerate(has)] for i in range(len(domains))])
    markers = [(own, np.log(chance[i]).tolist(), np.log1p(-chance[i]).tolist()) for i, own in enumerate(telling) if own]
    bias = np.log(np.array(n) / sum(n))
    discard(rows)
    return DomainModel(
        domains, bias.tolist(), [[float(r[f"{s}_mean"]) for s in SHAPES] for r in found], [[max(float(r[f"{s}_var"]), 1e-4 if s not in ("word_length", "log_words") else 0.05) for s in SHAPES] for r in found],
        {r["word"]: odds[k].tolist() for k, r in enumerate(best)}, markers,
    )


def _among(words: list[str]):
    return lambda w: w.isin(words)


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """docs with __p (posterior by domain) and __tokens."""
    rows = _measured(docs, text_col)
    hits = F.filter("__words", lambda w: w.isin(list(model.lexicon))) if model.lexicon else F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("__hits", hits)
    rows = rows.withColumn("__has", F.array(*[F.exists("__hits", _among(own)) for own, _, _ in model.markers], F.lit(False)))
    weights = F.create_map(*[x for w, odds in model.lexicon.items() for x in (F.lit(w), F.array(*map(F.lit, odds)))]) if model.lexicon else None
    scores = []
    for i in range(len(model.domains)):
        score = F.lit(model.bias[i] - sum(0.5 * math.log(v) for v in model.var[i]))
        for s, m, v in zip(SHAPES, model.mean[i], model.var[i]):
            score = score - F.pow(F.col(f"__{s}") - m, F.lit(2.0)) / (2 * v)
        for k, (_, log_has, log_none) in enumerate(model.markers):
            score = score + F.when(F.get("__has", F.lit(k)), F.lit(log_has[i])).otherwise(F.lit(log_none[i]))
        if weights is not None:
            score = score + _sum_of(F.transform("__hits", lambda w: F.element_at(weights, w)), i)
        scores.append(score)
    rows = rows.withColumn("__scores", F.array(*scores))
    rows = rows.withColumn("__e", F.transform("__scores", lambda s: F.exp(s - F.array_max("__scores"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("__p", F.transform("__e", lambda x: x / total))
    return rows.drop("__words", "__hits", "__has", "__scores", "__e", *[f"__{s}" for s in SHAPES])


def _sum_of(vectors: Column, i: int) -> Column:
    return F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, F.lit(i)))


@dataclass
class Rates:
    """The fitted steps: a document's rate is 1 moved by posterior . step for each in turn, each time projected.

    expected and targets are tokens by domain; unmet is their largest distance as a share of
    all tokens, above the tolerance where no rates from 0 to max_rate can meet the targets.
    """

    steps: list[list[float]]
    max_rate: float
    expected: list[float]
    targets: list[float]
    unmet: float = 0.0


def _moved(rate: Column, p: Column, steps: list[list[float]], max_rate: float) -> Column:
    if not steps:
        return rate
    moves = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(moves, rate, lambda r, g: F.least(F.lit(max_rate), F.greatest(F.lit(0.0), r + dot(g))))


def rate_of(p: Column, rates: Rates) -> Column:
    return _moved(F.lit(1.0), p, rates.steps, rates.max_rate)


def fit_rates(posteriors: DataFrame, model: DomainModel, targets: dict[str, float], max_rate: float = 8.0, tolerance: float = 1e-6, patience: int = 8, least_gain: float = 0.01) -> Rates:
    """Projected gradient on half the squared distance of expected domain tokens from their targets.

    posteriors: __p and __tokens of each document. Targets are shares of all tokens. It ends
    when the targets are met to ``tolerance``, or when ``patience`` steps have brought them
    nearer by less than ``least_gain`` of the distance: then bounds on the rates keep them unmet.
    Rates are written every ``patience`` steps, so a step replays only those since.
    """
    k = len(model.domains)
    p = [F.get("__p", F.lit(i)) for i in range(k)]
    tokens = F.col("__tokens").cast("double")
    free = (F.col("r") > 0) & (F.col("r") < max_rate)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(F.col("r") * tokens * p[i]).alias(f"m{i}") for i in range(k)] + [F.sum(F.when(free, tokens * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i, j in pairs]
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    total = posteriors.agg(F.coalesce(F.sum(tokens), F.lit(0.0))).first()[0]
    if not total or not share.sum():
        return Rates([], max_rate, [], [])
    want = share / share.sum() * total
    rates = Rates([], max_rate, [], want.tolist())
    state, pending = posteriors.select("__p", "__tokens", F.lit(1.0).alias("__r")), []

    def measure() -> tuple[np.ndarray, np.ndarray]:
        """How far the expected tokens are from the targets, and the Gram matrix of the rates that can move."""
        r = _moved(F.col("__r"), F.col("__p"), pending, max_rate)
        now = state.select(r.alias("r"), "__p", "__tokens").agg(*sums).first()
        return want - np.array([float(now[f"m{i}"]) for i in range(k)]), np.array([[now[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])

    short, gram = measure()
    scale = np.linalg.pinv(gram, rcond=1e-9)  # every rate is 1 at the start, so all can move
    distance = lambda e: float(e @ scale @ e)
    path, bold = [], 1
    while True:
        rates.expected, rates.unmet = (want - short).tolist(), float(np.abs(short).max() / total)
        path.append(distance(short))
        if rates.unmet <= tolerance or (len(path) > patience and path[-1] > (1 - least_gain) * path[-1 - patience]):
            discard(state)
            return rates
        # A step scaled by all documents always leads nearer; one scaled by those that can move
        # leads there in few steps once the others stay at their bounds, but must prove it.
        done = False
        if len(path) > bold and gram.any():
            pending.append((np.linalg.pinv(gram, rcond=1e-9) @ short).tolist())
            tried, tried_gram = measure()
            done = distance(tried) < 0.5 * path[-1]
            if done:
                short, gram = tried, tried_gram
            else:
                pending.pop()
                bold = len(path) + patience // 2  # not again at once
        if not done:
            pending.append((scale @ short).tolist())
            short, gram = measure()
        rates.steps.append(pending[-1])
        if len(pending) == patience:
            before, state = state, materialize(state.select("__p", "__tokens", _moved(F.col("__r"), F.col("__p"), pending, max_rate).alias("__r")), "rates")
            discard(before)
            pending = []


def fit(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", max_rate: float = 8.0, fit_rows: int = 20_000, carry: bool = False):
    """(model, rates, table): table has doc_id, p, tokens, rate and copies of every row of docs, and the row itself if ``carry``."""
    row = [F.struct(*own_columns(docs)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *row)
    keep = ["row"] * carry
    model = fit_domains(docs, labels, domain, id_col, text_col, fit_rows)
    if model is None:
        tokens = F.size(plain_words(lower_ascii(F.col("__text")))).cast("long")
        return None, Rates([], max_rate, [], []), rows.select(F.col("__id").alias("doc_id"), F.expr("cast(array() as array<double>)").alias("p"), tokens.alias("tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), *keep)
    table = with_posteriors(rows, model, "__text").select("__id", F.xxhash64("__id", "__text").alias("__draw"), "__p", "__tokens", *keep)
    table = materialize(table, "posteriors")  # texts are scored once; whole rows are written along where they are carried
    rates = fit_rates(table, model, targets, max_rate)
    part = F.pmod("__draw", F.lit(1 << 30)) / float(1 << 30)
    table = table.withColumn("rate", rate_of(F.col("__p"), rates))
    copies = (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return model, rates, table.select(F.col("__id").alias("doc_id"), F.col("__p").alias("p"), F.col("__tokens").alias("tokens"), "rate", copies.alias("copies"), *keep)


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", max_rate: float = 8.0, fit_rows: int = 20_000) -> DataFrame:
    """docs, with their own columns, each row as often as its rate says."""
    model, rates, table = fit(docs, labels, domain, targets, id_col, text_col, max_rate, fit_rows, carry=True)
    if model is None or not rates.steps:
        return docs
    # Rows without a copy go after the explode: a condition on the copies themselves would be
    # pushed below the steps above, with all of them written out in it.
    rows = table.select("row", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))).alias("copy"))
    return rows.where(F.col("copy").isNotNull()).select("row.*")


#: Shares of tokens that the registered query and the pipeline aim at, by domain of the labels table.
TARGETS = {"good": 0.90, "plain": 0.08, "toxic": 0.02}


def label_domain() -> Column:
    """toxic, good or plain from the quality and toxic labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
