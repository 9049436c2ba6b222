"""Request filters as row predicates. NULL passes a filter only where its rule says so."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.errors import Unsupported

_PERIODS = {"MINUTES": "MINUTE", "HOURS": "HOUR", "DAYS": "DAY", "WEEKS": "WEEK", "MONTHS": "MONTH", "QUARTERS": "QUARTER", "YEARS": "YEAR"}


def member(col: Column, values: list, exclude: bool = False) -> Column:
    """A SET filter. None among the values stands for NULL; excluding values keeps NULL unless it is named."""
    known = [v for v in values if v is not None]
    hit = col.isin(known) if known else F.lit(False)
    hit = F.coalesce(hit, F.lit(False))
    if None in values:
        hit = hit | col.isNull()
    return ~hit if exclude else hit


def match(col: Column, contains: str | None = None, starts: str | None = None, ends: str | None = None, exclude: bool = False) -> Column:
    """A MATCH filter, case-sensitive; all given parts must match."""
    hit = F.lit(True)
    for build, part in ((F.contains, contains), (F.startswith, starts), (F.endswith, ends)):
        if part is not None:
            hit = hit & build(col, F.lit(part))
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if exclude else hit


def bounded(col: Column, kind: str, low=None, high=None, with_nulls: bool = False) -> Column:
    """A quantitative filter: RANGE, MIN, MAX, ONLY_NULL or ONLY_NON_NULL, bounds included."""
    if kind == "ONLY_NULL":
        return col.isNull()
    if kind == "ONLY_NON_NULL":
        return col.isNotNull()
    hit = F.lit(True)
    if kind in ("RANGE", "MIN"):
        hit = hit & (col >= F.lit(low))
    if kind in ("RANGE", "MAX"):
        hit = hit & (col <= F.lit(high))
    return hit | col.isNull() if with_nulls else hit


def date_bounded(col: Column, kind: str, low: str | None = None, high: str | None = None, with_nulls: bool = False) -> Column:
    """The same on days: the last day counts whole. Compared as timestamps, so that scans can prune on the column itself."""
    if kind in ("ONLY_NULL", "ONLY_NON_NULL"):
        return bounded(col, kind)
    hit = F.lit(True)
    if kind in ("RANGE", "MIN"):
        hit = hit & (col >= F.lit(dt.datetime.fromisoformat(str(low))))
    if kind in ("RANGE", "MAX"):
        hit = hit & (col < F.lit(dt.datetime.fromisoformat(str(high)[:10]) + dt.timedelta(days=1)))
    return hit | col.isNull() if with_nulls else hit


def relative_date(col: Column, period: str, kind: str, anchor: Column, n: int = 1) -> Column:
    """CURRENT, LAST, NEXT, LASTN, NEXTN and TODATE periods about an anchor that the caller gives. Weeks begin on Sunday."""
    if period not in _PERIODS:
        raise Unsupported("type_or_shape_mismatch", f"period {period}")
    unit = _PERIODS[period]
    at = anchor.cast("timestamp")
    if unit == "WEEK":
        start = F.date_trunc("DAY", F.timestamp_add("DAY", 1 - F.dayofweek(at), at))
    else:
        start = F.date_trunc(unit, at)
    moved = lambda k: F.timestamp_add(unit, F.lit(k), start)
    edges = {"CURRENT": (start, moved(1)), "LAST": (moved(-1), start), "NEXT": (moved(1), moved(2)), "LASTN": (moved(1 - n), moved(1)), "NEXTN": (start, moved(n))}
    if kind == "TODATE":
        return (col >= start) & (col <= at)
    if kind not in edges:
        raise Unsupported("type_or_shape_mismatch", f"relative date {kind}")
    low, high = edges[kind]
    return (col >= low) & (col < high)


def selection(col: Column, mode: str, values: list | None = None) -> Column | None:
    """A view's selection: all members means no filter, a list keeps, except excludes."""
    if mode == "all":
        return None
    if mode not in ("keep", "except"):
        raise Unsupported("type_or_shape_mismatch", f"selection {mode}")
    return member(col, values or [], mode == "except")


def shared_filters(own: dict[str, Column], shared: dict[str, Column], slices: set[str]) -> list[Column]:
    """The filters of a sheet: its own, and of the shared ones those on columns its slices name; its own win."""
    return [*own.values(), *(f for c, f in shared.items() if c in slices and c not in own)]


def parameter_equals(col: Column, value, everything: str = "All") -> Column | None:
    """col = parameter; no filter where the parameter says everything."""
    return None if value == everything else col == F.lit(value)
