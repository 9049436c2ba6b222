"""Smaller operators of the model and the estate: colour rules, measure values, folds, lineage, reviews."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.ast import Binary, Call, Cond, Field, Lit, Lod, Node, Param, Unary, walk
from tessera.plans.binder import AGGREGATES, TABLE_CALCS
from tessera.plans.errors import Unsupported
from tessera.plans.model import Relationship, SemanticModel
from tessera.plans.parser import parse

SCOPES = ("constant", "parameter", "row", "aggregate", "lod", "view")


def scope(tree: Node) -> str:
    """The widest thing an expression depends on."""
    found = 0
    for n in walk(tree):
        if isinstance(n, Param):
            found = max(found, 1)
        elif isinstance(n, Field):
            found = max(found, 2)
        elif isinstance(n, Lod):
            found = max(found, 4)
        elif isinstance(n, Call) and (n.name in TABLE_CALCS or n.name.startswith("SCRIPT_")):
            found = max(found, 5)
        elif isinstance(n, Call) and n.name in AGGREGATES:
            found = max(found, 3)
    return SCOPES[found]


def dnf(tree: Node, most: int = 256) -> list[list[Node]]:
    """A predicate as alternatives of conjunctions, NOT pushed to the comparisons."""
    opposite = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}

    def go(n: Node, negated: bool) -> list[list[Node]]:
        if isinstance(n, Unary) and n.op == "NOT":
            return go(n.arg, not negated)
        if isinstance(n, Binary) and n.op in ("AND", "OR"):
            a, b = go(n.left, negated), go(n.right, negated)
            if (n.op == "OR") != negated:
                return a + b
            out = [[*x, *y] for x in a for y in b]
            if len(out) > most:
                raise Unsupported("unsupported_other", "too many alternatives")
            return out
        if negated and isinstance(n, Binary) and n.op in opposite:
            return [[Binary(opposite[n.op], n.left, n.right)]]
        return [[Unary("NOT", n) if negated else n]]

    return go(tree, False)


def colour_rule(formula: str) -> dict:
    """Ordered (alternatives, member) arms of a colour calculation, its members and its scope."""
    tree = parse(formula)
    if isinstance(tree, Cond) and all(isinstance(v, Lit) for _, v in tree.arms):
        arms = [(dnf(t), v.value) for t, v in tree.arms]  # type: ignore[attr-defined]
        other = tree.other.value if isinstance(tree.other, Lit) else None
        return {"arms": arms, "members": [m for _, m in arms] + ([other] if tree.other else []), "scope": scope(tree)}
    return {"arms": [(dnf(tree), True)], "members": [True, False], "scope": scope(tree)}


def colour_of(label: Column, palette: dict[object, str], missing: str | None = None) -> Column:
    """The hex colour of a label or boolean."""
    out = F.lit(missing)
    for member, hexcode in palette.items():
        out = F.when(label == F.lit(member), hexcode).otherwise(out)
    return out


def measure_values(df: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """Long form of several measures: one row a mark and measure, NULL values kept."""
    return df.unpivot(dims, measures, "measure", "value")


def running_fold(df: DataFrame, partition: list[str], order: list[str], start: float, step, value: str) -> DataFrame:
    """PREVIOUS_VALUE: each row's value from the row before it and its own, beginning with ``start``.

    The marks of a partition are folded in order; marks are the rows of a view, so a
    partition is as large as what is shown. step: (previous, current) to value.
    """
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("fold", F.aggregate(F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).over(w), F.lit(float(start)), step))


def combine(models: list[tuple[str, SemanticModel]]) -> SemanticModel:
    """Several datasources in one model: relations that share a name get their source's, sources stay islands."""
    names = [r for _, m in models for r in m.relations]
    out = SemanticModel(models[0][1].spark, anchor=models[0][1].anchor)
    for caption, m in models:
        new = {r: f"{caption} {r}" if names.count(r) > 1 else r for r in m.relations}
        for r in m.relations.values():
            out.add(new[r.name], r.df, {c: cap for cap, c in r.captions.items()}, island=caption)
        out.relationships += [Relationship(new[e.many], e.many_key, new[e.one], e.one_key, e.active, e.cardinality) for e in m.relationships]
        for c in m.calcs.values():
            same = out.calcs.get(c.name)
            if same is None or same.formula != c.formula:
                out.calc(c.name if same is None else f"{c.name} ({caption})", c.formula)
        out.parameters.update(m.parameters)
        out.bins.update(m.bins)
        out.groups.update(m.groups)
    return out


def infer_relationships(columns: dict[str, list[str]], unique) -> list[Relationship]:
    """Relationships from hidden ``Key (Table)`` captions: the plain Key of that Table is the one side if it is unique."""
    out = []
    for table, cols in columns.items():
        for col in cols:
            m = re.fullmatch(r"(.+) \((.+)\)", col)
            if m and m[2] in columns and m[2] != table and m[1] in columns[m[2]]:
                kind = "many_to_one" if unique(m[2], m[1]) else "many_to_many"
                out.append(Relationship(table, col, m[2], m[1], True, kind))
    return out


def date_table(relationships: DataFrame, marked: DataFrame) -> DataFrame:
    """(to_table, to_column, n): the marked date table, else the most referenced date key."""
    counted = relationships.where(F.lower("to_type").isin("date", "datetime", "timestamp")).groupBy("to_table", "to_column").agg(F.count(F.lit(1)).alias("n"))
    flagged = counted.join(marked.select("to_table", F.lit(True).alias("marked")), "to_table", "left")
    return flagged.orderBy(F.desc_nulls_last("marked"), F.desc("n"), "to_table", "to_column").limit(1).select("to_table", "to_column", "n")


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(relation, n) of each relation's rows."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise Unsupported("unresolved_reference", "no relations")
    return out


def downgrade_rebinds(plan: DataFrame, dropped: DataFrame, local_objects: DataFrame) -> DataFrame:
    """A rebind to an existing model becomes a conversion where a dropped reference is a local object of its datasource."""
    hit = dropped.join(local_objects, ["datasource", "object"], "left_semi").select("datasource").distinct().withColumn("__hit", F.lit(True))
    rows = plan.join(hit, "datasource", "left")
    return rows.withColumn("action", F.when(F.col("__hit") & F.col("action").isin("existing_model", "published"), "convert").otherwise(F.col("action"))).drop("__hit")


def review_counts(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """(verdict, decision, n): review decisions beside the verdicts they leave unchanged."""
    rows = matches.join(decisions, "asset_id", "left")
    return rows.groupBy("verdict", F.coalesce("decision", F.lit("unreviewed")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def rank_candidates(results: DataFrame) -> DataFrame:
    """Candidates by reconcile tier: all groupings pass, then most groupings that do, then by name; failures last."""
    rows = results.groupBy("candidate").agg(F.count_if(F.col("state") == "pass").alias("passed"), F.count_if(F.col("state") == "fail").alias("failed"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("failed") > 0, 3).when(F.col("passed") == F.col("n"), 1).otherwise(2)
    return rows.select("candidate", "passed", "failed", F.row_number().over(W.orderBy(level, F.desc("passed"), "candidate")).alias("rank"))


def contested(matches: DataFrame) -> DataFrame:
    """(model, claimed_by): models that several sources have as their best match, most claimed first."""
    rows = matches.where("bucket != 'rebuild'").groupBy(F.col("r_asset_id").alias("model")).agg(F.array_sort(F.collect_list("l_asset_id")).alias("sources"))
    return rows.where(F.size("sources") > 1).select("model", F.array_join("sources", ",").alias("claimed_by")).orderBy(F.desc(F.length("claimed_by")), "model")


def name_sets(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """(name, side): shared, left only or right only."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right only").when(F.col("__r").isNull(), "left only").otherwise("shared")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def metric(df: DataFrame, measure: Column, date: str, grain: str, running: bool = False, goal: float | None = None) -> DataFrame:
    """A metric over time: value by period, optionally running within the year, beside its goal."""
    rows = df.groupBy(F.date_trunc(grain, F.col(date)).alias("period")).agg(measure.alias("value"))
    if running:
        rows = rows.withColumn("value", F.sum("value").over(W.partitionBy(F.year("period")).orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.withColumns({"goal": F.lit(goal).cast("double"), "met": F.col("value") >= F.lit(goal).cast("double")})
