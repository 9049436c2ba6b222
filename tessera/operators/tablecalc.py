"""Table calculations as window Columns over marks (the aggregated rows of a view).

Addressing says which dimensions partition the marks and which order them; orders are made
total with the remaining dimensions, so results don't depend on ties. Calculations that
need no order (whole-partition windows, ranks) get an unordered window and no sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import divide
from tessera.plans.ast import Call, Lit, Node, Unary
from tessera.plans.binder import Typed
from tessera.plans.errors import Unsupported


@dataclass(frozen=True)
class Addressing:
    """Partition columns and ordered (column, ascending) columns of the marks."""

    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()

    def whole(self):
        return W.partitionBy(*[F.col(f"`{c}`") for c in self.partition])

    def ordered(self):
        if not self.order:
            raise Unsupported("missing_addressing_intent", "an order is needed and the view has no dimension for it")
        return self.whole().orderBy(*[F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in self.order])


_OVER: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "MEDIAN": F.median, "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop, "VAR": F.var_samp, "VARP": F.var_pop,
}


_PAIRS: dict[str, Callable[[Column, Column], Column]] = {"CORR": F.corr, "COVAR": F.covar_samp, "COVARP": F.covar_pop}


def _number(node: Node) -> float | int:
    if isinstance(node, Lit) and isinstance(node.value, (int, float)):
        return node.value
    if isinstance(node, Unary) and node.op == "-" and isinstance(node.arg, Lit):
        return -node.arg.value  # type: ignore[operator]
    raise Unsupported("missing_addressing_intent", "a window's offset must be a whole number")


def _bound(node: Node) -> tuple[str, int]:
    """(row, n), (first, n) or (last, n) of a frame's bound; FIRST()+n and LAST()-n are anchored."""
    from tessera.plans.ast import Binary

    if isinstance(node, Call) and node.name in ("FIRST", "LAST"):
        return node.name.lower(), 0
    if isinstance(node, Binary) and isinstance(node.left, Call) and node.left.name in ("FIRST", "LAST") and node.op in "+-":
        n = int(_number(node.right))
        return node.left.name.lower(), n if node.op == "+" else -n
    return "row", int(_number(node))


def _framed(name: str, x: Column, low: tuple[str, int], high: tuple[str, int], at: Addressing, y: Column | None = None, share: float = 0.5) -> Column:
    """An aggregate over a moving or anchored frame; y: the second measure of a pair, share: that of a percentile."""
    build = _OVER[name] if name in _OVER else (lambda m: _PAIRS[name](m, y)) if name in _PAIRS else None
    far = (1 << 31) - 1
    if low[0] == high[0] == "row":
        w = at.ordered().rowsBetween(low[1], high[1])
    elif low == ("first", 0) and high[0] == "row":
        w = at.ordered().rowsBetween(W.unboundedPreceding, high[1])
    elif low[0] == "row" and high == ("last", 0):
        w = at.ordered().rowsBetween(low[1], W.unboundedFollowing)
    else:  # anchored inside the partition: rows outside the anchors are masked, the free end moves
        row, n = F.row_number().over(at.ordered()), F.count(F.lit(1)).over(at.whole())
        place = {"first": lambda k: F.lit(1) + k, "last": lambda k: n + k}
        inside = F.lit(True)
        a, b = -far, far
        if low[0] == "row":
            a = low[1]
        else:
            inside = inside & (row >= place[low[0]](low[1]))
        if high[0] == "row":
            b = high[1]
        else:
            inside = inside & (row <= place[high[0]](high[1]))
        x = F.when(inside, x)
        w = at.ordered().rowsBetween(a if a != -far else W.unboundedPreceding, b if b != far else W.unboundedFollowing)
    if name in ("MEDIAN", "PERCENTILE"):  # order statistics have no moving form: the frame's values are sorted
        values = F.array_sort(F.collect_list(x).over(w))
        place = (F.size(values) - 1) * F.lit(share)
        below, above = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
        return F.when(F.size(values) > 0, below + (above - below) * (place - F.floor(place)))
    return build(x).over(w)


def rank(kind: str, x: Column, ascending: bool, at: Addressing) -> Column:
    """Ranks with NULL marks left out of the ranking."""
    key = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    w = at.whole().orderBy(key)
    upto = w.rangeBetween(W.unboundedPreceding, W.currentRow)
    if kind == "RANK":
        out = F.rank().over(w)
    elif kind == "RANK_DENSE":
        out = F.dense_rank().over(w)
    elif kind == "RANK_MODIFIED":
        out = F.count(x).over(upto)
    elif kind == "RANK_UNIQUE":
        rest = [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in at.order]
        out = F.row_number().over(at.whole().orderBy(key, *rest))
    else:  # share of the other marks that rank at or below
        n = F.count(x).over(at.whole())
        out = F.when(n > 1, (F.count(x).over(upto) - 1) / (n - 1)).otherwise(F.lit(0.0))
    return F.when(x.isNotNull(), out)


def scope(name: str, rows: list[str], columns: list[str]) -> tuple[list[str], list[str]]:
    """(partition, address) of an addressing scope over the dimensions on the two shelves, outer ones first.

    Table: all marks, across and then down. Rows: along each row. Columns: down each column.
    Pane: within the innermost level of both shelves; PaneRow and PaneCol along and down it.
    Cell: each mark alone. CellInPane: the same cell from pane to pane.
    """
    inner_r, inner_c = rows[-1:], columns[-1:]
    outer = rows[:-1] + columns[:-1]
    ways = {
        "Table": ([], rows + columns), "Rows": (rows, columns), "Columns": (columns, rows), "Pane": (outer, inner_r + inner_c),
        "PaneRow": (rows + columns[:-1], inner_c), "PaneCol": (rows[:-1] + columns, inner_r), "Cell": (rows + columns, []), "CellInPane": (inner_r + inner_c, outer),
    }
    if name not in ways:
        raise Unsupported("missing_addressing_intent", f"scope {name}")
    return ways[name]


def table_calc(node: Call, compile_: Callable[[Node], Typed], at: Addressing, total: Callable[[Node], Typed]) -> Typed:
    """A table-calculation call as a typed Column over the marks."""
    name, args = node.name, node.args
    if name == "INDEX":
        return Typed(F.row_number().over(at.ordered()), "number")
    if name == "SIZE":
        return Typed(F.count(F.lit(1)).over(at.whole()), "number")
    if name == "FIRST":
        return Typed(1 - F.row_number().over(at.ordered()), "number")
    if name == "LAST":
        return Typed(F.count(F.lit(1)).over(at.whole()) - F.row_number().over(at.ordered()), "number")
    if not args:
        raise Unsupported("type_or_shape_mismatch", f"{name} needs an argument")
    if name == "TOTAL":
        return total(args[0])
    x = compile_(args[0])
    if name == "LOOKUP":
        n = int(_number(args[1])) if len(args) > 1 else 0
        return Typed(F.lead(x.col, n).over(at.ordered()) if n >= 0 else F.lag(x.col, -n).over(at.ordered()), x.dtype)
    if name == "PREVIOUS_VALUE":
        raise Unsupported("language_gap", "PREVIOUS_VALUE inside another table calculation")
    if name.startswith("RANK"):
        up = name == "RANK_PERCENTILE"
        if len(args) > 1:
            if not isinstance(args[1], Lit) or str(args[1].value).lower() not in ("asc", "desc"):
                raise Unsupported("type_or_shape_mismatch", "a rank's direction is 'asc' or 'desc'")
            up = str(args[1].value).lower() == "asc"
        return Typed(rank(name, x.col, up, at), "number")
    family, _, kind = name.partition("_")
    gives = x.dtype if kind in ("MIN", "MAX") else "number"
    if kind not in ("MIN", "MAX", "COUNT", "CORR", "COVAR", "COVARP") and x.dtype not in ("number", "null"):
        raise Unsupported("type_or_shape_mismatch", f"{name} of {x.dtype}")
    if family == "RUNNING":
        return Typed(_OVER[kind](x.col).over(at.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)), gives)
    if kind == "PERCENTILE":
        if len(args) not in (2, 4):
            raise Unsupported("type_or_shape_mismatch", "WINDOW_PERCENTILE takes a share and, for a frame, two bounds")
        share = float(_number(args[1]))
        if len(args) == 4:
            return Typed(_framed(kind, x.col, _bound(args[2]), _bound(args[3]), at, share=share), "number")
        return Typed(F.percentile(x.col, F.lit(share)).over(at.whole()), "number")
    if kind in _PAIRS:
        if len(args) not in (2, 4):
            raise Unsupported("type_or_shape_mismatch", f"{name} takes two measures and, for a frame, two bounds")
        y = compile_(args[1])
        if len(args) == 4:
            return Typed(_framed(kind, x.col, _bound(args[2]), _bound(args[3]), at, y=y.col), "number")
        return Typed(_PAIRS[kind](x.col, y.col).over(at.whole()), "number")
    if len(args) == 3:
        return Typed(_framed(kind, x.col, _bound(args[1]), _bound(args[2]), at), gives)
    return Typed(_OVER[kind](x.col).over(at.whole()), gives)


# -- quick calculations ------------------------------------------------------------------------


def previous(x: Column, at: Addressing, k: int = 1) -> Column:
    return F.lag(x, k).over(at.ordered())


def quick(family: str, x: Column, at: Addressing, periods: int = 1, window: int = 3, retained: tuple[str, ...] = ()) -> Column:
    """The quick-calculation families over a measure of the marks.

    retained: the dimensions whose subtotal PERCENT_OF_TOTAL divides by (none: the grand total).
    """
    w = at.ordered()
    before = F.lag(x, periods).over(w)
    if family == "RUNNING_TOTAL":  # restarts at each partition, so year as partition gives year to date
        return F.sum(x).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    if family == "YTD_GROWTH":  # two passes: year to date in each partition, then against as many periods before
        so_far = F.sum(x).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        whole = W.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in at.partition], *[F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in at.order])
        then = F.lag(so_far, periods).over(whole)
        return divide(so_far - then, then)
    if family == "WINDOW_TOTAL":
        return F.sum(x).over(at.whole())
    if family == "MOVING_AVERAGE":
        return F.avg(x).over(w.rowsBetween(1 - window, W.currentRow))
    if family == "DIFFERENCE":
        return x - before
    if family == "PERCENT_DIFFERENCE":
        return divide(x - before, before)
    if family == "PERCENT_DIFFERENCE_ABS":
        return divide(x - before, F.abs(before))
    if family == "YEAR_OVER_YEAR":  # positional: a missing period shifts the comparison
        return divide(x - before, before)
    if family == "PERCENT_OF_TOTAL":
        return divide(x, F.sum(x).over(W.partitionBy(*[F.col(f"`{c}`") for c in retained])))
    if family == "COMPOUND_GROWTH":
        n = F.row_number().over(w)
        first = F.first(x).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return F.when(n == 1, 0.0).otherwise(F.pow(divide(x, first), 1 / (n - 1)) - 1)
    if family == "PERCENTILE":
        up, down = rank("RANK_DENSE", x, True, at), rank("RANK_DENSE", x, False, at)
        return divide(up - 1, up + down - 2)
    if family.startswith("RANK"):
        return rank(family, x, False, at)
    raise Unsupported("unsupported_other", f"quick calculation {family}")
