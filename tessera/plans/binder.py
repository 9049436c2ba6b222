"""Typed compilation of syntax trees to Columns: row expressions and expressions over marks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.aggregates import AGGREGATES
from tessera.functions.scalar import REFUSED, SCALARS, divide, modulo
from tessera.plans.ast import Binary, Call, Cond, Done, Field, In, Lit, Lod, Node, Param, Unary, children
from tessera.plans.errors import Unsupported

#: Functions that act on marks, the rows of a view.
TABLE_CALCS = frozenset(
    "INDEX SIZE FIRST LAST LOOKUP TOTAL PREVIOUS_VALUE RANK RANK_DENSE RANK_MODIFIED RANK_UNIQUE RANK_PERCENTILE RUNNING_SUM RUNNING_AVG RUNNING_MIN RUNNING_MAX RUNNING_COUNT "
    "WINDOW_SUM WINDOW_AVG WINDOW_MIN WINDOW_MAX WINDOW_COUNT WINDOW_MEDIAN WINDOW_STDEV WINDOW_STDEVP WINDOW_VAR WINDOW_VARP WINDOW_PERCENTILE WINDOW_CORR WINDOW_COVAR WINDOW_COVARP".split()
)


@dataclass(frozen=True)
class Typed:
    """A Column with its static type: number, text, bool, date or null."""

    col: Column
    dtype: str


def dtype_of(spark_type: T.DataType) -> str | None:
    """Static type of a Spark type; None for types the language has no values of."""
    if isinstance(spark_type, T.BooleanType):
        return "bool"
    if isinstance(spark_type, T.NumericType):
        return "number"
    if isinstance(spark_type, T.StringType):
        return "text"
    if isinstance(spark_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return None


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, (int, float)):
        return Typed(F.lit(value), "number")
    if isinstance(value, str):
        return Typed(F.lit(value), "text")
    if isinstance(value, (dt.date, dt.datetime)):
        return Typed(F.lit(value), "date")
    raise Unsupported("type_or_shape_mismatch", f"literal {value!r}")


def _of_view(node: Node) -> Iterator[Node]:
    """The nodes outside levels of detail, whose aggregates are theirs and not the view's."""
    yield node
    if not isinstance(node, Lod):
        for c in children(node):
            yield from _of_view(c)


def has_aggregate(node: Node) -> bool:
    return any(isinstance(n, Call) and n.name in AGGREGATES and not (n.name in ("MIN", "MAX") and len(n.args) == 2) for n in _of_view(node))


def has_table_calc(node: Node) -> bool:
    return any(isinstance(n, Call) and n.name in TABLE_CALCS for n in _of_view(node))


def is_measure(node: Node) -> bool:
    """Whether an expression has a value for each mark rather than for each row."""
    return has_aggregate(node) or has_table_calc(node) or any(isinstance(n, Lod) and n.kind != "FIXED" for n in _of_view(node))


def _common(types: list[str], what: str) -> str:
    known = {t for t in types if t != "null"}
    if len(known) > 1:
        raise Unsupported("type_or_shape_mismatch", f"{what} mixes {', '.join(sorted(known))}")
    return known.pop() if known else "null"


class Compiler:
    """Compiles expressions whose fields are looked up by ``resolve`` and parameters by ``parameter``.

    ``special`` may answer a node first; aggregates, levels of detail and table calculations
    are refused unless it does.
    """

    def __init__(self, resolve: Callable[[str], Typed], parameter: Callable[[str], Typed], anchor: Column | None = None, special: Callable[[Node], Typed | None] | None = None):
        self.resolve, self.parameter, self.anchor, self.special = resolve, parameter, anchor, special

    def __call__(self, node: Node) -> Typed:
        if self.special and (found := self.special(node)):
            return found
        if isinstance(node, Lit):
            return literal(node.value)
        if isinstance(node, Field):
            return self.resolve(node.name)
        if isinstance(node, Param):
            return self.parameter(node.name)
        if isinstance(node, Done):
            return Typed(F.col(f"`{node.name}`"), node.dtype)
        if isinstance(node, Unary):
            x = self(node.arg)
            if node.op == "NOT":
                self._want(x, "bool", "NOT")
                return Typed(~x.col, "bool")
            self._want(x, "number", "unary minus")
            return Typed(-x.col, "number")
        if isinstance(node, Binary):
            return self._binary(node)
        if isinstance(node, In):
            return self._member(node)
        if isinstance(node, Cond):
            return self._conditional(node)
        if isinstance(node, Call):
            return self._call(node)
        if isinstance(node, Lod):
            raise Unsupported("missing_outer_aggregation", f"a level of detail ({node.kind}) where a row value is needed")
        raise Unsupported("unsupported_other", type(node).__name__)

    @staticmethod
    def _want(x: Typed, dtype: str, what: str) -> None:
        if x.dtype not in (dtype, "null"):
            raise Unsupported("type_or_shape_mismatch", f"{what} needs {dtype}, not {x.dtype}")

    def _binary(self, node: Binary) -> Typed:
        a, b = self(node.left), self(node.right)
        op = node.op
        if op in ("AND", "OR"):
            self._want(a, "bool", op)
            self._want(b, "bool", op)
            return Typed(a.col & b.col if op == "AND" else a.col | b.col, "bool")
        if op in ("=", "<>", "<", ">", "<=", ">="):
            dtype = _common([a.dtype, b.dtype], "a comparison")
            if dtype == "bool" and op not in ("=", "<>"):
                raise Unsupported("type_or_shape_mismatch", "booleans have no order")
            build = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
            return Typed(build(a.col, b.col), "bool")
        if op == "+" and "text" in (a.dtype, b.dtype):
            _common([a.dtype, b.dtype], "+")
            return Typed(F.concat(a.col, b.col), "text")
        if "date" in (a.dtype, b.dtype) and op in ("+", "-"):
            if a.dtype == b.dtype == "date" and op == "-":
                return Typed(F.datediff(a.col, b.col).cast("bigint"), "number")
            if a.dtype == "date" and b.dtype == "number":
                return Typed(F.timestamp_add("DAY", (b.col if op == "+" else -b.col).cast("int"), a.col.cast("timestamp")), "date")
            raise Unsupported("type_or_shape_mismatch", f"{a.dtype} {op} {b.dtype}")
        self._want(a, "number", op)
        self._want(b, "number", op)
        if op == "/":
            return Typed(divide(a.col, b.col), "number")
        if op == "%":
            return Typed(modulo(a.col, b.col), "number")
        if op == "^":
            return Typed(F.pow(a.col, b.col), "number")
        return Typed({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], "number")

    def _member(self, node: In) -> Typed:
        x, items = self(node.arg), [self(i) for i in node.items]
        if _common([x.dtype, *(i.dtype for i in items)], "IN") == "bool":
            raise Unsupported("type_or_shape_mismatch", "IN over booleans")
        return Typed(x.col.isin([i.col for i in items]) if items else F.lit(False), "bool")

    def _conditional(self, node: Cond) -> Typed:
        values = [self(v) for _, v in node.arms]
        other = self(node.other) if node.other else literal(None)
        unknown = self(node.unknown) if node.unknown else None
        dtype = _common([v.dtype for v in (*values, other, *([unknown] if unknown else []))], "a conditional")
        out = None
        for (test, _), value in zip(node.arms, values):
            t = self(test)
            self._want(t, "bool", "a condition")
            out = F.when(t.col, value.col) if out is None else out.when(t.col, value.col)
            if unknown:
                out = out.when(t.col.isNull(), unknown.col)
        return Typed(out.otherwise(other.col), dtype)  # type: ignore[union-attr]

    def _call(self, node: Call) -> Typed:
        name = node.name
        if name in ("MIN", "MAX") and len(node.args) == 2:
            a, b = self(node.args[0]), self(node.args[1])
            both = a.col.isNotNull() & b.col.isNotNull()
            return Typed(F.when(both, (F.least if name == "MIN" else F.greatest)(a.col, b.col)), _common([a.dtype, b.dtype], name))
        if name in AGGREGATES:
            raise Unsupported("type_or_shape_mismatch", f"{name} inside a row expression")
        if name in TABLE_CALCS:
            raise Unsupported("missing_addressing_intent", f"{name} outside a view")
        if name in ("TODAY", "NOW"):
            if self.anchor is None:
                raise Unsupported("model_object_parameter", f"{name} needs an anchor date")
            return Typed(F.to_date(self.anchor) if name == "TODAY" else self.anchor.cast("timestamp"), "date")
        if name in REFUSED or name.startswith(("RAWSQL", "SCRIPT_")):
            raise Unsupported("language_gap", f"{name}: {REFUSED.get(name, 'external code')}")
        if name not in SCALARS:
            raise Unsupported("unsupported_other", f"function {name}")
        f = SCALARS[name]
        takes = f.takes.split()
        least = sum(not t.startswith("?") for t in takes)
        if not least <= len(node.args) <= len(takes):
            raise Unsupported("type_or_shape_mismatch", f"{name} takes {least} to {len(takes)} arguments")
        args, types = [], []
        for want, arg in zip(takes, node.args):
            want = want.lstrip("?")
            if want.startswith("="):  # a literal that shapes the plan
                if isinstance(arg, Unary) and arg.op == "-" and isinstance(arg.arg, Lit):
                    arg = Lit(-arg.arg.value)  # type: ignore[operator]
                if not isinstance(arg, Lit):
                    raise Unsupported("type_or_shape_mismatch", f"{name} needs a literal there")
                args.append(arg.value)
                continue
            x = self(arg)
            if want != "any":
                self._want(x, want, name)
            args.append(x.col)
            types.append(x.dtype)
        gives = f.gives if f.gives != "same" else _common(types, name)
        return Typed(f.build(*args), gives)
