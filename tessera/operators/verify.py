"""Verification that two tables overlap: ranges first, then probes inside the common window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relationship(a_low: Column, a_high: Column, b_low: Column, b_high: Column, rtol: float | None = None) -> Column:
    """equal, subset (the first lies in the second), superset, partial, disjoint or unknown. rtol: for numbers."""
    a0, a1 = F.least(a_low, a_high), F.greatest(a_low, a_high)
    b0, b1 = F.least(b_low, b_high), F.greatest(b_low, b_high)
    same = (lambda x, y: F.abs(x - y) <= rtol * F.greatest(F.abs(x), F.abs(y)) + 1e-9) if rtol is not None else (lambda x, y: x == y)
    unknown = a_low.isNull() | a_high.isNull() | b_low.isNull() | b_high.isNull()
    return (
        F.when(unknown, "unknown").when(F.greatest(a0, b0) > F.least(a1, b1), "disjoint").when(same(a0, b0) & same(a1, b1), "equal")
        .when((a0 >= b0) & (a1 <= b1), "subset").when((b0 >= a0) & (b1 <= a1), "superset").otherwise("partial")
    )


def overlap(left: DataFrame, right: DataFrame, column: str, rtol: float | None = None) -> DataFrame:
    """One row: both ranges of a column, their relationship and the common window."""
    a = left.agg(F.min(column).alias("a_low"), F.max(column).alias("a_high"))
    b = right.agg(F.min(column).alias("b_low"), F.max(column).alias("b_high"))
    rows = a.crossJoin(F.broadcast(b))  # one row each
    c = [F.col(x) for x in ("a_low", "a_high", "b_low", "b_high")]
    rows = rows.withColumn("relationship", relationship(*c, rtol=rtol))
    open_ = ~F.col("relationship").isin("disjoint", "unknown")
    return rows.withColumns({"low": F.when(open_, F.greatest(c[0], c[2])), "high": F.when(open_, F.least(c[1], c[3]))})


def outcome(a: Column, b: Column, rtol: float = 0.01, atol: float = 1e-6) -> Column:
    """agree, disagree, or inconclusive where one side has no value."""
    near = F.abs(a - b) <= atol + rtol * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() & b.isNull(), "agree").when(a.isNull() | b.isNull(), "inconclusive").when(near, "agree").otherwise("disagree")


def probe(left: DataFrame, right: DataFrame, window: str, sums: list[str], distinct: list[str], rtol: float = 0.01) -> DataFrame:
    """(probe, left_value, right_value, outcome) of sums and distinct counts inside the common window.

    Each side is one aggregation with the window as its filter; the window comes from a
    one-row frame, so nothing is collected.
    """
    w = overlap(left, right, window).select("low", "high")
    names = [f"SUM({c})" for c in sums] + [f"COUNTD({c})" for c in distinct]

    def side(df: DataFrame, tag: str) -> DataFrame:
        inside = df.crossJoin(F.broadcast(w)).where(F.col(window).between(F.col("low"), F.col("high")))
        return inside.agg(*[F.sum(c).cast("double").alias(f"{tag}{i}") for i, c in enumerate(sums)], *[F.count_distinct(c).cast("double").alias(f"{tag}{len(sums) + i}") for i, c in enumerate(distinct)])

    both = side(left, "a").crossJoin(F.broadcast(side(right, "b")))
    rows = F.array(*[F.struct(F.lit(n).alias("probe"), F.col(f"a{i}").alias("left_value"), F.col(f"b{i}").alias("right_value"), outcome(F.col(f"a{i}"), F.col(f"b{i}"), rtol).alias("outcome")) for i, n in enumerate(names)])
    return both.select(F.inline(rows))


def containment_verdict(outcomes: list[tuple[str, str | None]]) -> tuple[str, str]:
    """(verdict, relationship) from (outcome, direction) of probes without a window; size alone never means a mismatch."""
    usable = [o for o in outcomes if o[0] in ("agree", "directional")]
    if not usable:
        return "inconclusive", "unknown"
    if all(o == "agree" for o, _ in usable):
        return "verified", "equal"
    ways = {d for _, d in usable if d}
    if len(ways) == 1:
        return "compatible", "subset" if ways == {"right_ge"} else "superset"
    return "inconclusive", "partial"


def plan_probes(shared: list[tuple[str, str]], generic: set[str], most: int = 4) -> list[tuple[str, str]]:
    """Shared (column, type) pairs to probe: distinctive names first, dates before others, then by name."""
    return sorted(shared, key=lambda c: (c[0] in generic, c[1] not in ("date", "datetime"), c[0]))[:most]
