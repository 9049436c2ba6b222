"""Aggregates of the calculation language as Spark Columns, and their result types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def attr(x: Column) -> Column:
    """The one value of a group, or * where there are several."""
    return F.when(F.min(x) == F.max(x), F.min(x).cast("string")).when(F.min(x).isNotNull(), F.lit("*"))


def group_concat(x: Column, sep: Column | None = None) -> Column:
    """All values, duplicates kept, in ascending order so that the result is fixed."""
    return F.call_function("array_join", F.array_sort(F.collect_list(x.cast("string"))), F.lit(",") if sep is None else sep)


def percentile(x: Column, k: Column) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(x, k)


#: name: (type of the first argument or any, number of arguments, result type or same, builder)
AGGREGATES: dict[str, tuple[str, tuple[int, int], str, Callable[..., Column]]] = {
    "SUM": ("number", (1, 1), "number", F.sum),
    "AVG": ("number", (1, 1), "number", F.avg),
    "MEDIAN": ("number", (1, 1), "number", F.median),
    "COUNT": ("any", (1, 1), "number", F.count),
    "COUNTD": ("any", (1, 1), "number", F.count_distinct),
    "STDEV": ("number", (1, 1), "number", F.stddev_samp),
    "STDEVP": ("number", (1, 1), "number", F.stddev_pop),
    "VAR": ("number", (1, 1), "number", F.var_samp),
    "VARP": ("number", (1, 1), "number", F.var_pop),
    "PERCENTILE": ("number", (2, 2), "number", percentile),
    "ATTR": ("any", (1, 1), "text", attr),
    "GROUP_CONCAT": ("any", (1, 2), "text", group_concat),
    "CORR": ("number", (2, 2), "number", F.corr),
    "COVAR": ("number", (2, 2), "number", F.covar_samp),
    "COVARP": ("number", (2, 2), "number", F.covar_pop),
    "MIN": ("any", (1, 1), "same", F.min),
    "MAX": ("any", (1, 1), "same", F.max),
}
#: Aggregates of one value that give it back, so that they vanish around a parameter.
KEEPS_VALUE = {"SUM", "AVG", "MIN", "MAX", "MEDIAN", "ATTR"}


def aggregate(name: str, dtype: str, args: list[Column]) -> Column:
    """The aggregate's Column; MIN and MAX of booleans are AND and OR over the rows."""
    if dtype == "bool" and name in ("MIN", "MAX"):
        return (F.bool_and if name == "MIN" else F.bool_or)(args[0])
    return AGGREGATES[name][3](*args)
