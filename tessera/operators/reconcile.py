"""Reconciliation of two formulas over rows, and of measured against expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.errors import Unsupported
from tessera.plans.model import SemanticModel
from tessera.plans.query import run_request


def close(a: Column, b: Column, absolute: float = 1e-9, relative: float = 1e-9) -> Column:
    """Equality with tolerance: both NULL agree, one NULL doesn't."""
    near = F.abs(a - b) <= absolute + relative * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))


def auto_grain(df: DataFrame, used: set[str], least: int = 2, most: int = 50, columns: int = 8) -> list[str]:
    """Columns of few values that the formulas don't use, measured in one pass, fewest values first."""
    candidates = [c for c in df.columns if c not in used]
    if not candidates:
        return []
    counts = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in candidates]).first()
    return sorted((c for c in candidates if least <= counts[c] <= most), key=lambda c: (counts[c], c))[:columns]


def reconcile(model: SemanticModel, left: str, right: str, grain: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(grouping, groups, mismatches, state) for the grand total and each column of the grain.

    Both formulas are aggregates of the same grouping, so each grouping is one aggregation.
    state: pass, fail, or inconclusive where a formula has no plan or there are no rows.
    """
    spark = model.spark
    schema = "grouping string, groups long, mismatches long, state string"
    try:
        out = None
        for by in [[], *[[g] for g in (grain or [])]]:
            fields = [{"fieldCaption": g} for g in by] + [{"calculation": left, "fieldAlias": "__left"}, {"calculation": right, "fieldAlias": "__right"}]
            rows = run_request(model, {"fields": fields})
            bad = F.count_if(~close(F.col("__left").cast("double"), F.col("__right").cast("double"), tolerance, tolerance))
            one = rows.agg(F.count(F.lit(1)).alias("groups"), bad.alias("mismatches"), F.count_if(F.col("__left").isNotNull() | F.col("__right").isNotNull()).alias("known"))
            state = F.when(F.col("known") == 0, "inconclusive").when(F.col("mismatches") > 0, "fail").otherwise("pass")
            one = one.select(F.lit(by[0] if by else "(all)").alias("grouping"), "groups", "mismatches", state.alias("state"))
            out = one if out is None else out.unionByName(one)
        return out  # type: ignore[return-value]
    except Unsupported as e:
        return spark.createDataFrame([(f"(none): {e.category}", 0, 0, "inconclusive")], schema)


def summarize(results: DataFrame) -> DataFrame:
    """Number of results in each state."""
    return results.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """One row: results, those of each state, and the share of conclusive ones that pass (null if none is)."""
    n = lambda s: F.count_if(F.col("state") == s)
    return results.agg(F.count(F.lit(1)).alias("n"), *[n(s).alias(s) for s in ("pass", "fail", "inconclusive")], F.round(F.try_divide(n("pass"), n("pass") + n("fail")), 4).alias("pass_rate"))


def against_expected(measured: DataFrame, expected: DataFrame, on: str = "measure", tolerance: float = 1e-6) -> DataFrame:
    """(measure, value, expected, state) of named values; a side without the name makes it inconclusive."""
    a, b = measured.select(on, F.col("value")), expected.select(on, F.col("value").alias("expected"))
    both = a.join(b, on, "full_outer")
    state = F.when(F.col("value").isNull() | F.col("expected").isNull(), "inconclusive").when(close(F.col("value"), F.col("expected"), 1e-9, tolerance), "pass").otherwise("fail")
    return both.select(on, "value", "expected", state.alias("state"))


def coverage(model: SemanticModel) -> DataFrame:
    """(status, n) over the model's calculations: translated, or the category of the refusal."""
    rows = []
    for name in model.calcs:
        try:
            _ = run_request(model, {"fields": [{"fieldCaption": name, "fieldAlias": "__x"}]}).schema
            rows.append((name, "translated"))
        except Unsupported as e:
            rows.append((name, e.category))
    return model.spark.createDataFrame(rows, "calc string, status string").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def keep_better(before: dict[str, float], after: dict[str, float], epsilon: float = 1e-9) -> bool:
    """Whether a candidate is kept: no component regresses, and one improves."""
    return all(after.get(k, 0.0) >= v - epsilon for k, v in before.items()) and any(after.get(k, 0.0) > v + epsilon for k, v in before.items())
