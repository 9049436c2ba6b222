"""Keys and join paths: uniqueness, cardinality, confidence, semi-join counting, union of sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.errors import Unsupported


def is_unique(df: DataFrame, key: str | tuple[str, ...]) -> bool:
    """Whether no value of key (or of several columns) without a null occurs twice; the aggregation is combined before the shuffle and stops at one group."""
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def looks_like_identity(table: str, column: str) -> bool:
    """A column named id, key or pk, or the table's name (singular or plural) with such an ending."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    t, c = plain(table), plain(column)
    stems = {t, t.removesuffix("s"), t.removesuffix("es"), t[:1]}
    return c in ("id", "key", "pk", "rowid") or any(c == s + end for s in stems for end in ("id", "key", "code", "no", "number"))


def cardinality(df: DataFrame | None, table: str, column: str) -> tuple[str, str]:
    """(cardinality, basis) of a relationship to table.column: measured, else by naming, else many to many."""
    if df is not None:
        return ("many_to_one" if is_unique(df, column) else "many_to_many"), "measured"
    if looks_like_identity(table, column):
        return "many_to_one", "naming"
    return "many_to_many", "unknown"


def confidence(basis: str, declared: bool) -> str:
    """Grade of a relationship."""
    return {("measured", True): "high", ("measured", False): "medium", ("naming", True): "medium"}.get((basis, declared), "low")


def forest_edges(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges, in order, that keep the graph a forest; a filter crosses those in both directions only."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    kept = []
    for a, b in edges:
        if top(a) != top(b):
            up[top(a)] = top(b)
            kept.append((a, b))
    return kept


def unique_path(edges: list[tuple[str, str]], start: str, end: str, longest: int = 4, budget: int = 20_000, hubs: frozenset[str] = frozenset()) -> list[str]:
    """The one simple path between two tables of an undirected graph; a second one of any length, or none, is refused.

    ``hubs`` (a shared calendar) may begin or end a path but not lie inside it. ``longest`` is
    the most edges that the answer may have, and limits no search for a second path.
    """
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    found: set[tuple[str, ...]] = set()
    stack, steps = [(start,)], 0
    while stack:
        path = stack.pop()
        if path[-1] == end:
            found.add(path)
            if len(found) > 1:
                break
            continue
        if len(path) > 1 and path[-1] in hubs:
            continue
        for x in near.get(path[-1], []):
            steps += 1
            if steps > budget:
                raise Unsupported("unresolved_reference", "too many relationships to search")
            if x not in path:
                stack.append((*path, x))
    if len(found) != 1:
        raise Unsupported("unresolved_reference", f"{'no path leads' if not found else 'several paths lead'} from {start} to {end}")
    path = list(found.pop())
    pairs = [frozenset(e) for e in edges]
    if any(pairs.count(frozenset(p)) > 1 for p in zip(path, path[1:])):
        raise Unsupported("unresolved_reference", "two relationships join the same tables on the path")
    if len(path) - 1 > longest:
        raise Unsupported("unresolved_reference", f"the path from {start} to {end} has more than {longest} relationships")
    return path


def connection_mix(kinds: dict[str, str]) -> str:
    """How the sources of joined tables lie together: single, several_live, several_files or file_and_live; kinds: table to file or the live source's name."""
    live, files = {k for k in kinds.values() if k != "file"}, [t for t, k in kinds.items() if k == "file"]
    if files and live:
        return "file_and_live"
    if len(files) > 1:
        return "several_files"
    return "several_live" if len(live) > 1 else "single"


def asof_join(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], on: tuple[str, str], tolerance: str | None = None) -> DataFrame:
    """Each left row with the right row of equal keys that is last at or before it; NULLs where there is none, or none within ``tolerance``.

    Both sides are put together and sorted by key and place once; the last right row so far is
    carried forward. No pairs are made, so a key's rows cost their sort. Of right rows at one
    place the greatest by all columns counts.
    """
    names = right.columns
    keys = [f"__k{i}" for i in range(len(by))]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    one = right.where(F.col(on[1]).isNotNull()).select(*[F.col(b).alias(k) for (_, b), k in zip(by, keys)], F.col(on[1]).alias("__at"), F.lit(0).alias("__side"), row.alias("__right"), F.lit(None).alias("__left"))
    mine = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    two = left.select(*[F.col(a).alias(k) for (a, _), k in zip(by, keys)], F.col(on[0]).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__right"), mine.alias("__left"))
    w = W.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first(), "__side", F.col("__right").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = one.unionByName(two).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    known = F.col("__at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    if tolerance is not None:
        known = known & (F.col("__at") - F.expr(f"INTERVAL {tolerance}") <= F.col(f"__last.`{on[1]}`"))
    return rows.select("__left.*", *[F.when(known, F.col(f"__last.`{c}`")).alias(c) for c in names])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points within low to high (both included) of rows of ranges, met in buckets of ``width`` instead of by all pairs.

    A range is dealt to every bucket it touches, so width should be about a usual range's length.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = ranges.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("__bucket", bucket(point)).join(cut, "__bucket").where(F.col(point).between(F.col(low), F.col(high))).drop("__bucket")


def count_distinct_where_related(fact: DataFrame, field: str, chain: list[tuple[DataFrame, str, str]], condition: Column) -> DataFrame:
    """Distinct values of field among fact rows that reach, along a chain of keys, a row that meets the condition.

    chain: (table, key in the table before, key in this table). Each step is a semi-join, so
    nothing is fanned out whatever the cardinalities.
    """
    tables = [fact, *(t for t, _, _ in chain)]
    keep = tables[-1].where(condition)
    for i in range(len(chain) - 1, -1, -1):
        _, before, here = chain[i]
        keys = keep.select(F.col(here).alias("__key"))
        keep = tables[i].join(keys, F.col(before) == F.col("__key"), "left_semi")
    return keep.agg(F.count_distinct(field).alias("n"))


def blend(primary: DataFrame, secondary: DataFrame, links: list[tuple[str, str]], measures: dict[str, Column]) -> DataFrame:
    """A data blend: the secondary source is aggregated to the links, then joined to the primary's rows."""
    keys = [F.col(s).alias(f"__link{i}") for i, (_, s) in enumerate(links)]
    side = secondary.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    on = [F.col(p).eqNullSafe(F.col(f"__link{i}")) for i, (p, _) in enumerate(links)]
    return primary.join(side, on, "left").drop(*[f"__link{i}" for i in range(len(links))])


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; a column that a part lacks is NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
