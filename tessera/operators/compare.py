"""Comparison of two inventories of datasets: scores, tiers, assignment, confidence, priority, clusters.

An inventory is a DataFrame of asset_id, name, fields (array of name, type), tables (array of
connector, database, name) and calcs (array of names). Names are folded once for each asset
(Unicode needs Python there); pairs are then scored with array functions, with the
character-level ratio as the one vectorised Python step, for pairs whose folded names differ.
Inventories list datasets, not their rows, so the smaller one is broadcast; its size is
checked, and a larger one is joined without the hint. ``compare`` scores every pair, as its
result names every asset's best one however low; clusters only pair assets that can be similar.
"""

from __future__ import annotations

import atexit
import difflib
import re
import tempfile
import unicodedata
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights, tiers, thresholds and word lists of the scoring rules.
WEIGHTS = {"name": 0.20, "column": 0.35, "type": 0.15, "source": 0.30}
CLUSTER_WEIGHTS = {"name": 0.0, "column": 0.5, "type": 0.2, "source": 0.3}
CLUSTER_THRESHOLD = 0.80
TIERS = [("Exact", 0.85), ("Strong", 0.65), ("Partial", 0.40), ("Weak", 0.15), ("None", 0.0)]
FUZZY_FLOOR, FUZZY_CAP = 0.6, 0.9
GENERIC_WEIGHT, LEAST_ASSETS_FOR_IDF, LEAST_IDF = 0.25, 8, 0.15
NEAR_TIE, BORDERLINE = 0.10, 0.07
NAME_STOPWORDS = "the a an of and datasource data source ds model semantic dataset extract live copy final v1 v2 prod dev test".split()
GENERIC_COLUMNS = (
    "id key pk fk uuid guid rowid index seq name fullname firstname lastname title label description desc code type category status state flag active enabled "
    "date datetime timestamp createddate modifieddate updateddate createdat updatedat year month day week quarter hour value amount qty quantity count total sum price cost "
    "region country city zip zipcode postalcode address currency comment comments notes source version number num"
).split()
GENERIC_TABLES = "data table table1 sheet sheet1 export extract query customsql dataset output results result temp tmp staging stage raw import source main default".split()
HELPER_TABLES = "date dates calendar measures measure parameters parameter keymeasures".split()
COMPATIBLE_TYPES = {
    "INTEGER": ["int64", "decimal", "double"], "REAL": ["double", "decimal", "int64"], "FLOAT": ["double", "decimal", "int64"], "NUMBER": ["double", "decimal", "int64"],
    "STRING": ["string"], "BOOLEAN": ["boolean"], "BOOL": ["boolean"], "DATE": ["datetime", "date"], "DATETIME": ["datetime", "date"], "SPATIAL": ["string", "binary"],
}
CONNECTORS = {
    "sqlserver": "sqlserver", "mssql": "sqlserver", "azuresql": "sqlserver", "azuresqldb": "sqlserver", "snowflake": "snowflake", "postgres": "postgres", "postgresql": "postgres", "redshift": "redshift",
    "bigquery": "bigquery", "googlebigquery": "bigquery", "oracle": "oracle", "mysql": "mysql", "databricks": "databricks", "spark": "databricks", "exceldirect": "excel", "textscan": "file", "hyper": "extract",
}
CONNECTOR_PARTS = [("snowflake", "snowflake"), ("postgres", "postgres"), ("sql server", "sqlserver"), ("sqlserver", "sqlserver"), ("mssql", "sqlserver"), ("sqldb", "sqlserver"), ("redshift", "redshift"), ("bigquery", "bigquery"), ("oracle", "oracle"), ("mysql", "mysql"), ("databricks", "databricks")]
REACH_WEIGHT, VIEWS_WEIGHT, ENDORSED_WEIGHT, REACH_HALF, VIEWS_HALF = 0.45, 0.40, 0.15, 8.0, 500.0
IMPORTANCE = [("Critical", 0.62), ("High", 0.38), ("Moderate", 0.17), ("Low", 0.0)]
PRIORITY = {"High": "P1 - migrate first", "Medium": "P2 - migrate", "Low": "P3 - deprioritize", "Unused": "P4 - retire candidate", "Unknown": "Unprioritized"}

_BREAK = re.compile(r"[\W_]+")


def fold(name: str | None) -> str:
    """Name without case and marks, in composed form."""
    parts = unicodedata.normalize("NFKD", name or "")
    return unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c))).casefold()


def token(name: str | None) -> str:
    """Folded letters and digits of a name, in any script."""
    return "".join(c for c in fold(name) if c.isalnum())


def name_tokens(name: str | None) -> list[str]:
    """Distinct folded words of a name less noise words, unless there are no others."""
    words = sorted({w for w in _BREAK.split(fold(name)) if w})
    return [w for w in words if w not in NAME_STOPWORDS] or words


def connector(kind: str | None) -> str:
    """One name for the spellings of a connector."""
    key = re.sub(r"[^a-z0-9]+", "", (kind or "").lower())
    if key in CONNECTORS:
        return CONNECTORS[key]
    return next((name for part, name in CONNECTOR_PARTS if part in (kind or "").lower()), key or "other")


_FOLDED = T.StructType([
    T.StructField("norm", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("columns", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("strict", T.ArrayType(T.StringType())), T.StructField("loose", T.ArrayType(T.StringType())), T.StructField("calcs", T.ArrayType(T.StringType())),
])


def _tell_workers(df: DataFrame) -> None:
    """Python workers are told where this package lies, in case only the driver's path has it."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{known}:{root}".strip(":")


def folded(inventory: DataFrame) -> DataFrame:
    """asset_id and name with their folded forms, one Python pass over the assets."""
    _tell_workers(inventory)

    @F.pandas_udf(_FOLDED)  # type: ignore[call-overload]
    def run(name: pd.Series, fields: pd.Series, tables: pd.Series, calcs: pd.Series) -> pd.DataFrame:
        rows = []
        for n, fs, ts, cs in zip(name, fields, tables, calcs):
            places = [(connector(t["connector"]), token(t["database"]), token(t["name"])) for t in (ts if ts is not None else []) if token(t["name"])]
            plain = sorted({p[2] for p in places if p[2] not in HELPER_TABLES and "swap" not in p[2]})
            columns = {token(f["name"]): f["type"] or "" for f in (fs if fs is not None else []) if token(f["name"])}
            rows.append((token(n), name_tokens(n), columns, plain, sorted({"|".join(p) for p in places}), sorted({f"{p[0]}|{p[2]}" for p in places}), sorted({token(c) for c in (cs if cs is not None else []) if token(c)})))
        return pd.DataFrame(rows, columns=[f.name for f in _FOLDED.fields])

    return inventory.withColumn("f", run("name", "fields", "tables", "calcs")).select("asset_id", "name", "f.*")


@F.pandas_udf(T.DoubleType())  # type: ignore[call-overload]
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def column_weights(*inventories: DataFrame) -> DataFrame:
    """(token, weight): generic names count a quarter; from eight assets on, frequent names count less too."""
    keys = None
    for inv in inventories:
        part = inv.select("asset_id", F.explode(F.map_keys("columns")).alias("token"))
        keys = part if keys is None else keys.unionByName(part)
    assets = sum(inv.count() for inv in inventories)
    base = F.when(F.col("token").isin(GENERIC_COLUMNS), GENERIC_WEIGHT).otherwise(1.0)
    freq = keys.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # type: ignore[union-attr]
    if assets < LEAST_ASSETS_FOR_IDF:
        return freq.select("token", base.alias("weight"))
    idf = F.log((assets + 1) / (F.col("df") + 0.5)) / F.log(F.lit(float(assets + 1)))
    return freq.select("token", (base * F.greatest(F.lit(LEAST_IDF), F.least(F.lit(1.0), idf))).alias("weight"))


def weighted(inventory: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds w: the weight of each column token of an asset."""
    own = inventory.select("asset_id", F.explode(F.map_keys("columns")).alias("token")).join(weights, "token")
    own = own.groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("w"))
    return inventory.join(own, "asset_id", "left").withColumn("w", F.coalesce("w", F.expr("cast(map() as map<string,double>)")))


def type_compatible(left: Column, right: Column) -> Column:
    """Whether a source type fits a model type; a missing or unknown one always does."""
    fits = F.lit(True)
    for name, allowed in COMPATIBLE_TYPES.items():
        fits = F.when(F.upper(F.trim(left)) == name, F.lower(F.trim(right)).isin(allowed)).otherwise(fits)
    return F.coalesce((left == "") | (right == "") | fits, F.lit(True))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def score_pairs(pairs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Signals and score of pairs of folded, weighted assets with columns l_* and r_*.

    The source signal is left out, and its weight shared by the others, where either side
    shows no table.
    """
    same = (F.col("l_norm") != "") & (F.col("l_norm") == F.col("r_norm"))
    rows = pairs.withColumn("ratio", F.when(~same & (F.col("l_norm") != "") & (F.col("r_norm") != ""), _ratio("l_norm", "r_norm")).otherwise(0.0))
    words = jaccard(F.col("l_words"), F.col("r_words"))
    name = F.when(same, 1.0).otherwise(F.greatest(words, F.when(F.col("ratio") >= FUZZY_FLOOR, F.col("ratio") * FUZZY_CAP).otherwise(0.0)))
    rows = rows.withColumn("shared_columns", F.array_sort(F.array_intersect(F.map_keys("l_columns"), F.map_keys("r_columns"))))
    both = _sum(F.transform("shared_columns", lambda c: F.element_at("l_w", c)))
    column = F.coalesce(F.try_divide(both, _sum(F.map_values("l_w")) + _sum(F.map_values("r_w")) - both), F.lit(0.0))
    fits = F.size(F.filter("shared_columns", lambda c: type_compatible(F.element_at("l_columns", c), F.element_at("r_columns", c))))
    typed = F.coalesce(F.try_divide(fits, F.size("shared_columns")), F.lit(0.0))
    compared = (F.size("l_tables") > 0) & (F.size("r_tables") > 0)
    shared = F.array_intersect("l_tables", "r_tables")
    covered = F.try_divide(F.size(shared), F.size("l_tables"))
    distinctive = F.exists(shared, lambda t: ~t.isin(GENERIC_TABLES))
    source = F.when(compared, F.greatest(jaccard(F.col("l_strict"), F.col("r_strict")), 0.85 * jaccard(F.col("l_loose"), F.col("r_loose")), 0.7 * F.when(distinctive, covered).otherwise(jaccard(F.col("l_tables"), F.col("r_tables")))))
    rows = rows.withColumns({"name_score": F.round(name, 4), "column_score": F.round(column, 4), "type_score": F.round(typed, 4), "source_score": F.round(source, 4), "source_compared": compared, "shared_tables": F.array_sort(shared)})
    total = F.lit(weights["name"] + weights["column"] + weights["type"]) + F.when(compared, weights["source"]).otherwise(0.0)
    score = (weights["name"] * F.col("name_score") + weights["column"] * F.col("column_score") + weights["type"] * F.col("type_score") + weights["source"] * F.coalesce("source_score", F.lit(0.0))) / total
    return rows.withColumn("score", F.round(score, 4))


def tier(score: Column) -> Column:
    out = F.lit("None")
    for label, least in reversed(TIERS):
        out = F.when(score >= least, label).otherwise(out)
    return out


def bucket(t: Column) -> Column:
    return F.when(t.isin("Exact", "Strong"), "already_exists").when(t == "Partial", "partial").otherwise("rebuild")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])


def compare(left: DataFrame, right: DataFrame, weights: dict[str, float] = WEIGHTS, broadcast_rows: int = 100_000) -> DataFrame:
    """Every pair of two inventories, scored, with tier and the rank of the model for its source."""
    a, b = folded(left), folded(right)
    return _ranked(a, b, column_weights(a, b), weights, broadcast_rows)


def _ranked(a: DataFrame, b: DataFrame, by: DataFrame, weights: dict[str, float], broadcast_rows: int) -> DataFrame:
    small = b.count() <= broadcast_rows
    a, b = weighted(a, by), weighted(b, by)
    b = F.broadcast(_side(b, "r")) if small else _side(b, "r")
    rows = score_pairs(_side(a, "l").crossJoin(b), weights)
    w = W.partitionBy("l_asset_id").orderBy(F.desc("score"), "r_asset_id")
    rows = rows.withColumns({"rank": F.row_number().over(w), "tier": tier(F.col("score"))})
    return rows.withColumn("bucket", bucket(F.col("tier")))


def compare_lists(embedded: DataFrame, models: DataFrame, published: DataFrame, weights: dict[str, float] = WEIGHTS, broadcast_rows: int = 100_000) -> DataFrame:
    """The pairs of compare for each of two target lists (``target``: model or published), ranked in each; one table of column weights for all."""
    a, lists = folded(embedded), {"model": folded(models), "published": folded(published)}
    by = column_weights(a, *lists.values())
    found = [_ranked(a, b, by, weights, broadcast_rows).withColumn("target", F.lit(target)) for target, b in lists.items()]
    return found[0].unionByName(found[1])


def cluster_scores(clusters: DataFrame, embedded: DataFrame, scored: DataFrame) -> DataFrame:
    """(cluster_id, size, representative, and id, score, tier and bucket of its best model and published asset).

    The representative is the first member with the name of the one with most fields. An
    id is null where the best score is 0; all four are where the list is empty.
    """
    members = clusters.join(embedded.select("asset_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.size("fields"), F.lit(0)).alias("n")), "asset_id")
    fullest = F.first("name").over(W.partitionBy("cluster_id").orderBy(F.desc("n"), "asset_id"))
    out = members.withColumn("fullest", fullest).where("name = fullest").groupBy("cluster_id", "size").agg(F.min("asset_id").alias("representative"))
    for target in ("model", "published"):
        best = scored.where((F.col("target") == target) & (F.col("rank") == 1))
        best = best.select(F.col("l_asset_id").alias("representative"), F.when(F.col("score") > 0, F.col("r_asset_id")).alias(f"{target}_id"), *[F.col(c).alias(f"{target}_{c}") for c in ("score", "tier", "bucket")])
        out = out.join(best, "representative", "left")
    return out


_NAMED = T.MapType(T.StringType(), T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))


def named_fields(inventory: DataFrame) -> DataFrame:
    """asset_id and named: the name and type of the first field of each token."""

    @F.pandas_udf(_NAMED)  # type: ignore[call-overload]
    def run(fields: pd.Series) -> pd.Series:
        out = []
        for fs in fields:
            own: dict[str, dict[str, str]] = {}
            for f in fs if fs is not None else []:
                if t := token(f["name"]):
                    own.setdefault(t, {"name": f["name"], "type": f["type"] or ""})
            out.append(own)
        return pd.Series(out)

    return inventory.select("asset_id", run("fields").alias("named"))


def field_diff(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Of each pair of compare: names of shared, one-sided and mistyped fields, and the shared and one-sided tables."""
    rows = pairs.select("l_asset_id", "r_asset_id", "l_tables", "r_tables", "source_compared")
    for df, side in ((left, "l"), (right, "r")):
        rows = rows.join(_side(named_fields(df), side), f"{side}_asset_id")
    names = lambda side, keys: F.array_sort(F.transform(keys, lambda k: F.element_at(f"{side}_named", k)["name"]))
    l_keys, r_keys = F.map_keys("l_named"), F.map_keys("r_named")
    shared = F.array_intersect(l_keys, r_keys)
    both = F.transform(shared, lambda k: F.struct(F.element_at("l_named", k)["name"].alias("column"), F.element_at("l_named", k)["type"].alias("l_type"), F.element_at("r_named", k)["type"].alias("r_type")))
    return rows.select(
        "l_asset_id", "r_asset_id", names("l", shared).alias("shared"), names("l", F.array_except(l_keys, r_keys)).alias("left_only"), names("r", F.array_except(r_keys, l_keys)).alias("right_only"),
        F.array_sort(F.filter(both, lambda x: ~type_compatible(x["l_type"], x["r_type"]))).alias("type_mismatches"), "source_compared",
        *[F.array_sort(x).alias(n) for x, n in ((F.array_intersect("l_tables", "r_tables"), "shared_tables"), (F.array_except("l_tables", "r_tables"), "left_only_tables"), (F.array_except("r_tables", "l_tables"), "right_only_tables"))],
    )


def best_matches(pairs: DataFrame) -> DataFrame:
    """The best model of each source, with margin, reciprocity, contest, logic parity and confidence."""
    w = W.partitionBy("l_asset_id")
    rows = pairs.withColumns({"runner_up": F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w)}).where("rank = 1")
    suitor = W.partitionBy("r_asset_id")
    rows = rows.withColumns({
        "margin": F.round(F.greatest(F.lit(0.0), F.col("score") - F.coalesce("runner_up", F.lit(0.0))), 3),
        "suitors": F.count(F.when(F.col("bucket") != "rebuild", 1)).over(suitor),
        "reciprocal": F.row_number().over(suitor.orderBy(F.desc("score"), "l_asset_id")) == 1,
    })
    matched = F.size(F.array_intersect("l_calcs", "r_calcs"))
    parity = F.when(F.size("l_calcs") == 0, "none").when(matched == 0, "unverified").when(matched == F.size("l_calcs"), "likely").otherwise("partial")
    rows = rows.withColumns({"contested": F.col("suitors") > 1, "logic_parity": parity})
    return rows.withColumn("confidence", confidence())


def confidence(name_strong: float = 0.85, column_strong: float = 0.6, source_strong: float = 0.5) -> Column:
    """Trust in the verdict, from how many independent signals support it."""
    near = (F.col("bucket") != "rebuild") & F.col("runner_up").isNotNull() & (F.col("score") - F.col("runner_up") < NEAR_TIE)
    one = lambda c: F.when(c, 1).otherwise(0)
    strong = one(F.col("name_score") >= name_strong) + one(F.col("column_score") >= column_strong) + one(F.col("source_compared") & (F.col("source_score") >= source_strong)) + one(F.col("reciprocal") & (F.col("suitors") > 1))
    exists = F.when((strong >= 2) & ~near & ~F.col("contested"), "High").when(strong >= 1, "Medium").otherwise("Low")
    partial = F.when((strong >= 1) & ~near, "Medium").otherwise("Low")
    rebuild = F.when(F.col("score") <= 0.15, "High").when(F.col("score") >= 0.40 - BORDERLINE, "Low").otherwise("Medium")
    return F.when(F.col("bucket") == "already_exists", exists).when(F.col("bucket") == "partial", partial).otherwise(rebuild)


def uncertainty(strong_cut: float = 0.65, partial_cut: float = 0.40, band: float = 0.08) -> Column:
    """Why a best match is on the fence: codes in a fixed order, none if it isn't."""
    codes = [
        (F.col("bucket") == "partial", "partial_tier"),
        (F.abs(F.col("score") - strong_cut) <= band, "near_reuse_boundary"),
        (F.abs(F.col("score") - partial_cut) <= band, "near_rebuild_boundary"),
        ((F.col("confidence") == "Low") & (F.col("bucket") != "partial"), "low_confidence"),
        ((F.col("bucket") != "rebuild") & F.col("logic_parity").isin("unverified", "partial"), "logic_unverified"),
    ]
    return F.array_compact(F.array(*[F.when(c, code) for c, code in codes]))


def review_category() -> Column:
    """The first reason for a person to look at a best match."""
    name, column = F.col("name_score"), F.col("column_score")
    renamed = (F.col("tier") != "None") & (((name >= 0.5) & (column <= 0.2)) | ((column >= 0.5) & (name <= 0.2)))
    return (
        F.when(F.col("runner_up").isNotNull() & (F.col("score") >= 0.40) & (F.col("score") - F.col("runner_up") < 0.07), "near_tie")
        .when(renamed, "renamed_columns_suspected").when(F.col("tier").isin("Strong", "Partial", "Weak") & ~F.col("source_compared"), "obscured_source")
        .when(F.col("tier").isin("Partial", "Weak") & (F.col("score") > 0), "borderline_band").when(F.col("tier").isin("Weak", "None"), "likely_rebuild")
    )


def rollup(matches: DataFrame) -> DataFrame:
    """(tier, bucket, n) of the best matches."""
    return matches.groupBy("tier", "bucket").agg(F.count(F.lit(1)).alias("n"))


def unmatched(right: DataFrame, matches: DataFrame) -> DataFrame:
    """Models that no source is mapped to."""
    used = matches.where("bucket != 'rebuild'").select(F.col("r_asset_id").alias("asset_id"))
    return right.join(used, "asset_id", "left_anti")


def assign(pairs: DataFrame) -> DataFrame:
    """(l_asset_id, r_asset_id, score): greedy one-to-one assignment, highest score first, ties by ids.

    What taking the highest pair again and again gives, a pair that is the best of both its
    sides is given at once; so each round takes all of those and drops their sides' other
    pairs, until none is left. Every candidate counts, and nothing is collected.
    """
    left = _cut(pairs.where("score > 0").select("l_asset_id", "r_asset_id", "score"))
    order = [F.desc("score"), "l_asset_id", "r_asset_id"]
    taken = None
    while not left.isEmpty():
        place = {f"__{s}": F.row_number().over(W.partitionBy(f"{s}_asset_id").orderBy(*order)) for s in "lr"}
        both = _cut(left.withColumns(place).where("__l = 1 AND __r = 1").select("l_asset_id", "r_asset_id", "score"))
        taken = both if taken is None else taken.unionByName(both)
        for side in "lr":
            left = left.join(both.select(f"{side}_asset_id"), f"{side}_asset_id", "left_anti")
        left = _cut(left.select("l_asset_id", "r_asset_id", "score"))
    return taken if taken is not None else left


def importance(workbooks: Column, dashboards: Column, views: Column, certified: Column) -> tuple[Column, Column]:
    """(score, level) of use: saturating reach and views and an endorsement, over the signals that are known."""
    known_reach = workbooks.isNotNull() | dashboards.isNotNull()
    reach = F.coalesce(workbooks, F.lit(0)) + 2 * F.coalesce(dashboards, F.lit(0))
    saturated = lambda x, half: x / (x + half)
    parts = [(REACH_WEIGHT, known_reach, saturated(reach, REACH_HALF)), (VIEWS_WEIGHT, views.isNotNull(), saturated(F.coalesce(views, F.lit(0)), VIEWS_HALF)), (ENDORSED_WEIGHT, certified.isNotNull(), F.when(certified, 1.0).otherwise(0.0))]
    top = sum((F.when(k, w * v).otherwise(0.0) for w, k, v in parts), F.lit(0.0))
    weight = sum((F.when(k, w).otherwise(0.0) for w, k, _ in parts), F.lit(0.0))
    score = F.coalesce(F.round(F.try_divide(top, weight), 4), F.lit(0.0))
    level = F.lit("Low")
    for label, least in reversed(IMPORTANCE):
        level = F.when(score >= least, label).otherwise(level)
    return score, F.when(weight == 0, "Unknown").otherwise(level)


def usage_priority(workbooks: Column, high: int = 5, medium: int = 2) -> Column:
    return F.when(workbooks.isNull(), "Unknown").when(workbooks >= high, "High").when(workbooks >= medium, "Medium").when(workbooks == 1, "Low").otherwise("Unused")


def migration_priority(where: Column, usage: Column) -> Column:
    out = F.lit(PRIORITY["Unknown"])
    for label, said in PRIORITY.items():
        out = F.when(usage == label, said).otherwise(out)
    return F.when(where == "already_exists", "Reuse (already there)").otherwise(out)


def fingerprint(inventory: DataFrame) -> Column:
    """Twelve hex digits of a folded asset's sorted columns and tables."""
    blob = F.concat(F.lit("F:"), F.array_join(F.array_sort(F.map_keys("columns")), ","), F.lit("|T:"), F.array_join(F.array_sort("tables"), ","))
    return F.substring(F.sha1(blob), 1, 12)


_written: dict[str, SparkSession] = {}


def _cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, as a table in the folder that all executors share: each round of a loop would add to the plan otherwise.

    The folder is spark.checkpoint.dir; only in local mode may it be unset. Tables go when Python ends.
    """
    spark = df.sparkSession
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may have ended first; the cluster's own clean-up then applies
            return


def _candidates(assets: DataFrame, least: float) -> DataFrame:
    """(l_asset_id, r_asset_id) of pairs whose weighted column overlap can reach ``least``, which must be above 0.

    Columns are taken in one order, rare ones first. The first column that such a pair shares
    lies in both assets' heads: those columns from which on the rest still weighs ``least`` of
    the whole. So only heads meet, and no other pair is made.
    """
    if least <= 0:
        raise ValueError("a threshold that pairs without a shared column can reach needs all pairs")
    own = assets.select("asset_id", F.explode("w").alias("token", "weight"))
    own = own.join(own.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    asset = W.partitionBy("asset_id")
    rest = F.sum("weight").over(asset.orderBy("df", "token").rowsBetween(W.currentRow, W.unboundedFollowing))
    head = _cut(own.withColumns({"rest": rest, "whole": F.sum("weight").over(asset)}).where(F.col("rest") >= least * F.col("whole") - 1e-9).select("asset_id", "token"))
    right = head.select(F.col("asset_id").alias("r_asset_id"), "token")
    return head.withColumnRenamed("asset_id", "l_asset_id").join(right, "token").where("l_asset_id < r_asset_id").select("l_asset_id", "r_asset_id").distinct()


def cluster(inventory: DataFrame, threshold: float = CLUSTER_THRESHOLD) -> DataFrame:
    """(asset_id, fingerprint, cluster_id, size): near-identical assets, through chains of similar ones of any length.

    Equal fingerprints collapse first; representatives that can be similar are then paired and joined through
    minimum labels, which also go to the label's own asset and jump to the label's label, until
    none moves. The cluster's id is its smallest asset id.
    """
    base = folded(inventory)
    base = _cut(base.withColumn("fingerprint", fingerprint(base)))  # names are folded once
    reps = base.groupBy("fingerprint").agg(F.min("asset_id").alias("asset_id"))
    chosen = base.join(reps, ["asset_id", "fingerprint"], "left_semi")
    chosen = weighted(chosen, column_weights(chosen))
    pairs = _candidates(chosen, 1 - (1 - threshold) / CLUSTER_WEIGHTS["column"])
    pairs = pairs.join(_side(chosen, "l"), "l_asset_id").join(_side(chosen, "r"), "r_asset_id")
    links = score_pairs(pairs, CLUSTER_WEIGHTS).where(F.col("score") >= threshold).select(F.col("l_asset_id").alias("a"), F.col("r_asset_id").alias("b"))
    links = _cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _cut(reps.select("asset_id", F.col("asset_id").alias("label")))
    moved = 1
    while moved:
        near = links.join(labels.withColumnsRenamed({"asset_id": "b", "label": "near"}), "b").join(labels.withColumnsRenamed({"asset_id": "a", "label": "own"}), "a")
        near = near.select(F.explode(F.array("a", "own")).alias("asset_id"), "near").groupBy("asset_id").agg(F.min("near").alias("near"))
        low = _cut(labels.join(near, "asset_id", "left").select("asset_id", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        labels = low.join(low.select(F.col("asset_id").alias("label"), F.col("label").alias("next")), "label")
        labels = _cut(labels.select("asset_id", F.col("next").alias("label"), (F.col("next") < F.col("was")).alias("moved")))
        moved = labels.where("moved").count()
        labels = labels.select("asset_id", "label")
    found = base.join(reps.withColumnRenamed("asset_id", "rep"), "fingerprint").join(labels.withColumnsRenamed({"asset_id": "rep", "label": "cluster_id"}), "rep")
    return found.select("asset_id", "fingerprint", "cluster_id", F.count(F.lit(1)).over(W.partitionBy("cluster_id")).alias("size"))


def rebind_action(fits_model: Column, fits_published: Column, size: Column) -> Column:
    """What becomes of a cluster."""
    return F.when(fits_model, "existing_model").when(fits_published, "published").when(size > 1, "consolidate").otherwise("convert")


def resolve_dependency(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, state): resolved, ambiguous or not_found in an index of names."""
    hits = index.groupBy(F.lower("name").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(hits, F.lower("name") == F.col("k"), "left")
    return rows.select("name", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("state"))
