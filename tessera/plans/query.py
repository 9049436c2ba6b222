"""A declarative request against a semantic model, compiled to one DataFrame.

Order of operations: row security, row filters marked ``context``, FIXED levels of detail,
dimension filters, INCLUDE and EXCLUDE levels of detail with the view's aggregates, measure
filters, table calculations, mark-hiding filters, totals, sort, limit.

Request keys
  fields: list of
    fieldCaption; function (an aggregate, a date part or TRUNC_ part); calculation (formula);
    binSize; fieldAlias; maxDecimalPlaces; sortDirection (ASC, DESC); sortPriority;
    address / partition (lists of captions or aliases for table calculations);
    quickCalc (family with its options)
  filters: list of
    field {fieldCaption, function, calculation}; filterType SET, MATCH, QUANTITATIVE_NUMERICAL,
    QUANTITATIVE_DATE, DATE, TOP or CALC (a boolean formula); exclude; context
  parameters: values by name;  user: for row security;  limit;  totals: grand or rollup;
  lodMode: fixed (default) or view_context
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.aggregates import AGGREGATES, aggregate
from tessera.functions.scalar import date_part, trunc_date
from tessera.operators import filters as flt
from tessera.operators.tablecalc import Addressing, quick, scope, table_calc
from tessera.plans.ast import Call, Done, Field, Lod, Node, Param, rewrite, walk
from tessera.plans.binder import TABLE_CALCS, Compiler, Typed, has_aggregate, has_table_calc, is_measure
from tessera.plans.errors import Unsupported
from tessera.plans.model import SemanticModel
from tessera.plans.parser import parse

_DATE_PARTS = {"YEAR", "QUARTER", "MONTH", "WEEK", "DAY"}


@dataclass
class _Output:
    """One requested field: its tree, its output name, and whether it is a dimension."""

    spec: dict
    tree: Node
    name: str
    dimension: bool


@dataclass
class Query:
    """The compilation of one request; ``run`` gives its DataFrame."""

    model: SemanticModel
    request: dict
    made: int = 0
    fixed: list[tuple[Lod, str, str]] = field(default_factory=list)
    side: list[tuple[DataFrame, list[str]]] = field(default_factory=list)
    late: list[tuple[DataFrame, list[str]]] = field(default_factory=list)
    seen: dict[str, Node] = field(default_factory=dict)
    tables: set[str] = field(default_factory=set)

    # -- reading the request -----------------------------------------------------------------

    def _tree(self, spec: dict) -> Node:
        if "calculation" in spec:
            tree = parse(spec["calculation"])
        else:
            tree = Field(spec["fieldCaption"])
        tree = self.model.inline(tree)
        f = spec.get("function")
        if f in AGGREGATES:
            if has_aggregate(tree) or has_table_calc(tree):
                raise Unsupported("type_or_shape_mismatch", f"{f} of an aggregate")
            if isinstance(tree, Lod) and tree.kind == "FIXED" and not tree.dims:
                return tree  # an aggregate of a table-wide value is that value
            return Call(f, (tree,))
        return tree

    def _dated(self, x: Typed, f: str | None) -> Typed:
        if not f or f in AGGREGATES:
            return x
        if x.dtype != "date":
            raise Unsupported("type_or_shape_mismatch", f"{f} of {x.dtype}")
        if f in _DATE_PARTS:
            return Typed(date_part(f.lower(), x.col), "number")
        if f.startswith("TRUNC_") and f[6:] in _DATE_PARTS:
            return Typed(trunc_date(f[6:].lower(), x.col), "date")
        raise Unsupported("unsupported_other", f"function {f}")

    def _outputs(self) -> list[_Output]:
        out = []
        for spec in self.request["fields"]:
            tree = self._tree(spec)
            name = spec.get("fieldAlias") or (f"{spec['function']}({spec['fieldCaption']})" if spec.get("function") and "fieldCaption" in spec else spec.get("fieldCaption", spec.get("calculation")))
            measure = is_measure(tree) or self._is_reduced(tree) or spec.get("quickCalc") is not None
            out.append(_Output(spec, tree, name, not measure))
        names = [o.name for o in out]
        if len(set(names)) < len(names):
            raise Unsupported("type_or_shape_mismatch", "two fields of one name; give them aliases")
        return out

    @staticmethod
    def _is_reduced(tree: Node) -> bool:
        return isinstance(tree, Lod) and tree.kind == "FIXED" and not tree.dims

    # -- row stage -----------------------------------------------------------------------------

    def _value(self, name: str) -> Typed:
        return self.model.value(name, self.request.get("parameters"))

    def _fresh(self, what: str) -> str:
        self.made += 1
        return f"__{what}{self.made}"

    def _row(self, tree: Node) -> Typed:
        compiler = Compiler(lambda n: self.model.column(n, self.request.get("parameters"), self.tables), self._value, self.model.anchor_column())
        return compiler(tree)

    def _aggregate(self, call: Call) -> Typed:
        kind, (least, most), gives, _ = AGGREGATES[call.name]
        if not least <= len(call.args) <= most:
            raise Unsupported("type_or_shape_mismatch", f"{call.name} takes {least} to {most} arguments")
        if call.name in ("SUM", "COUNT") and isinstance(call.args[0], Field) and call.args[0].name == "Number of Records":
            return Typed(F.count(F.lit(1)), "number")
        args = [self._row(a) for a in call.args]
        if kind == "number" and args[0].dtype not in ("number", "null"):
            raise Unsupported("type_or_shape_mismatch", f"{call.name} of {args[0].dtype}")
        return Typed(aggregate(call.name, args[0].dtype, [a.col for a in args]), args[0].dtype if gives == "same" else gives)

    def _aggregated(self, df: DataFrame, keys: list[tuple[str, Column]], tree: Node, name: str) -> tuple[DataFrame, str]:
        """df grouped by keys with an aggregate expression as column ``name``; gives its type too."""
        hidden: list[Column] = []

        def take(n: Node) -> Node | None:
            if isinstance(n, Call) and n.name in AGGREGATES and not (n.name in ("MIN", "MAX") and len(n.args) == 2):
                typed = self._aggregate(n)
                alias = self._fresh("a")
                hidden.append(typed.col.alias(alias))
                return Done(alias, typed.dtype)
            return None

        tree = rewrite(tree, take)
        grouped = df.groupBy(*[c.alias(k) for k, c in keys]).agg(*(hidden or [F.lit(1).alias(self._fresh("none"))]))
        value = Compiler(self._no_field, self._value, self.model.anchor_column())(tree)
        return grouped.select(*[F.col(f"`{k}`") for k, _ in keys], value.col.alias(name)), value.dtype

    @staticmethod
    def _no_field(name: str) -> Typed:
        raise Unsupported("missing_outer_aggregation", f"[{name}] beside aggregates needs one itself")

    @staticmethod
    def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """Left join on keys where NULL meets NULL; without keys the right side is one row."""
        if not keys:
            return left.crossJoin(F.broadcast(right))
        names = {k: f"__r_{k}" for k in keys}
        right = right.withColumnsRenamed(names)
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{r}`")) for k, r in names.items()]
        return left.join(right, on, "left").drop(*names.values())

    def _attach_fixed(self, df: DataFrame, tree: Node) -> tuple[DataFrame, Node]:
        """FIXED levels of detail as row columns of df, innermost first."""
        for n in walk(tree):
            if isinstance(n, Lod) and n.kind == "FIXED" and any(isinstance(x, Lod) and not set(n.dims) <= set(x.dims) for x in walk(n.body)):
                raise Unsupported("type_or_shape_mismatch", "a nested FIXED must keep the outer dimensions")

        def change(n: Node) -> Node | None:
            nonlocal df
            if not (isinstance(n, Lod) and n.kind == "FIXED"):
                return None
            for lod, name, dtype in self.fixed:
                if lod == n and name in df.columns:
                    return Done(name, dtype)
            name = self._fresh("lod")
            keys = [(self._fresh("k"), self._row(Field(d) if d not in self.model.calcs else self.model.inline(Field(d))).col) for d in n.dims]
            side, dtype = self._aggregated(df, keys, n.body, name)
            df = df.withColumns({k: c for k, c in keys}) if keys else df
            df = self._join(df, side, [k for k, _ in keys]).drop(*[k for k, _ in keys])
            self.fixed.append((n, name, dtype))
            return Done(name, dtype)

        tree = rewrite(tree, change)
        return df, tree

    # -- filters -----------------------------------------------------------------------------

    def _predicate(self, f: dict, x: Typed) -> Column:
        kind, exclude = f["filterType"], bool(f.get("exclude"))
        if kind == "SET":
            return flt.member(x.col, f["values"], exclude)
        if kind == "MATCH":
            return flt.match(x.col, f.get("contains"), f.get("startsWith"), f.get("endsWith"), exclude)
        if kind == "QUANTITATIVE_NUMERICAL":
            return flt.bounded(x.col, f["quantitativeFilterType"], f.get("min"), f.get("max"), bool(f.get("includeNulls")))
        if kind == "QUANTITATIVE_DATE":
            return flt.date_bounded(x.col, f["quantitativeFilterType"], f.get("minDate"), f.get("maxDate"), bool(f.get("includeNulls")))
        if kind == "DATE":
            anchor = F.lit(f["anchorDate"]).cast("timestamp") if "anchorDate" in f else self.model.anchor_column()
            if anchor is None:
                raise Unsupported("model_object_parameter", "a relative date needs an anchor")
            return flt.relative_date(x.col, f["periodType"], f["dateRangeType"], anchor, f.get("rangeN", 1))
        if kind == "CALC":
            if x.dtype != "bool":
                raise Unsupported("type_or_shape_mismatch", "a filter's formula must be boolean")
            return x.col
        raise Unsupported("unsupported_other", f"filter {kind}")

    def _top(self, df: DataFrame, f: dict) -> DataFrame:
        """Rows whose dimension member is among the top or bottom N by a measure; ties fall to the smaller member."""
        member = self._dated(self._row(self._tree(f["field"])), f["field"].get("function"))
        by = self._tree(f["fieldToMeasure"])
        ranked, _ = self._aggregated(df, [("__member", member.col)], by, "__by")
        order = F.col("__by").asc_nulls_last() if f.get("direction", "TOP") == "BOTTOM" else F.col("__by").desc_nulls_last()
        ranked = ranked.orderBy(order, F.col("__member").asc_nulls_first()).limit(int(f["howMany"])).select(F.col("__member").alias("__top"))
        return df.join(F.broadcast(ranked), member.col.eqNullSafe(F.col("__top")), "left_semi")  # N rows, as requested

    # -- marks -------------------------------------------------------------------------------

    def run(self) -> DataFrame:
        outputs = self._outputs()
        wanted = [(f, self._tree(f["field"]) if f["filterType"] != "TOP" else None) for f in self.request.get("filters", [])]
        trees = [o.tree for o in outputs] + [t for _, t in wanted if t is not None]
        for f, _ in wanted:
            if f["filterType"] == "TOP":
                trees += [self._tree(f["field"]), self._tree(f["fieldToMeasure"])]
        names = set()
        for t in trees:
            for n in walk(t):
                if isinstance(n, Field) and n.name != "Number of Records":
                    names.add(n.name)
                if isinstance(n, Lod):
                    names |= {x.name for d in n.dims for x in walk(self.model.inline(Field(d))) if isinstance(x, Field)}
        self.tables = self.model.tables_of(names) or {next(iter(self.model.relations))}
        df, _ = self.model.frame(self.tables, self.request.get("user"))
        row_filters = [(f, t) for f, t in wanted if t is None or not is_measure(t)]
        mark_filters = [(f, t) for f, t in wanted if t is not None and is_measure(t)]
        for f, t in row_filters:
            if f.get("context"):
                df = self._filtered(df, f, t)
        if self.request.get("lodMode", "fixed") == "view_context":
            for f, t in row_filters:
                if not f.get("context"):
                    df = self._filtered(df, f, t)
        for o in outputs:
            df, o.tree = self._attach_fixed(df, o.tree)
        for i, (f, t) in enumerate(mark_filters):
            df, t = self._attach_fixed(df, t)
            mark_filters[i] = (f, t)
        if self.request.get("lodMode", "fixed") != "view_context":
            for f, t in row_filters:
                if not f.get("context"):
                    df = self._filtered(df, f, t)
        return self._marks(df, outputs, mark_filters)

    def _filtered(self, df: DataFrame, f: dict, tree: Node | None) -> DataFrame:
        if tree is None:
            return self._top(df, f)
        df, tree = self._attach_fixed(df, tree)
        return df.where(self._predicate(f, self._dated(self._row(tree), f["field"].get("function"))))

    def _marks(self, df: DataFrame, outputs: list[_Output], mark_filters: list) -> DataFrame:
        dims = [(o.name, self._dated(self._row(o.tree), o.spec.get("function"))) for o in outputs if o.dimension]
        for o in outputs:
            if o.dimension and "binSize" in o.spec:
                size = o.spec["binSize"]
                i = next(k for k, d in enumerate(dims) if d[0] == o.name)
                dims[i] = (o.name, Typed(F.floor(dims[i][1].col / size) * size, "number"))
        keys = [(n, d.col) for n, d in dims]
        measures = [o for o in outputs if not o.dimension]
        if not measures and not mark_filters:
            marks = df.select(*[c.alias(n) for n, c in keys]).distinct()
            return self._finish(marks, outputs, {n: d.dtype for n, d in dims})
        hidden: dict[str, Column] = {}
        types = {n: d.dtype for n, d in dims}
        trees = [self._split(o.tree, df, keys, hidden) for o in measures]
        post = [(f, self._split(t, df, keys, hidden)) for f, t in mark_filters]
        one = [c.alias(a) for a, c in hidden.items()] or [F.lit(1).alias(self._fresh("none"))]
        if self.request.get("totals"):
            if self.side or any(isinstance(n, Call) and n.name in ("TOTAL", "PREVIOUS_VALUE") for t in trees for n in walk(t)):
                raise Unsupported("unsupported_other", "totals over levels of detail, TOTAL or PREVIOUS_VALUE")
            # A total row is a window of its own: table calculations see the detail marks without it.
            alone = F.when(F.col("totalLevel") > 0, F.to_json(F.struct("totalLevel", *[F.col(f"`{n}`") for n, _ in keys])))
            marks = self._totals(df, keys, one).withColumn("__total", alone)
        else:
            marks = df.groupBy(*[c.alias(n) for n, c in keys]).agg(*one)
        for side, on in self.side:
            marks = self._join(marks, side, on)
        # Measure filters come before table calculations, filters that use those come after.
        for f, t in post:
            if not has_table_calc(t):
                marks = marks.where(self._predicate(f, self._post(t, marks, types, Addressing(), df, keys)))
        stages: dict[str, Column] = {}
        for o, t in zip(measures, trees):
            at = self._addressing(o.spec, outputs, types)
            if self.request.get("totals"):
                at = Addressing((*at.partition, "__total"), at.order)
            x = self._post(t, marks, types, at, df, keys)
            if q := o.spec.get("quickCalc"):
                options = {k: v for k, v in q.items() if k != "family"} if isinstance(q, dict) else {}
                x = Typed(quick(q["family"] if isinstance(q, dict) else q, x.col, at, **options), "number")
            stages[o.name] = x.col
            types[o.name] = x.dtype
        hide: list[str] = []
        for f, t in post:
            if has_table_calc(t):
                name = self._fresh("hide")
                at = self._addressing(f.get("field", {}), outputs, types)
                stages[name] = self._predicate(f, self._post(t, marks, types, at, df, keys))
                hide.append(name)
        marks = self.extended(marks).withColumns(stages)
        for name in hide:
            marks = marks.where(F.col(name))
        return self._finish(marks, outputs, types)

    def extended(self, marks: DataFrame) -> DataFrame:
        """marks with what TOTAL has aggregated again."""
        for side, on in self.late:
            marks = self._join(marks, side, on)
        return marks

    def _split(self, tree: Node, df: DataFrame, keys: list[tuple[str, Column]], hidden: dict[str, Column]) -> Node:
        """The tree over marks: each aggregate becomes a column of the grouping or of a side aggregation."""
        names = dict(keys)

        def lod(n: Lod) -> Node:
            name = self._fresh("v")
            if n.kind == "EXCLUDE":
                kept = [(k, c) for k, c in keys if k not in n.dims]
                side, dtype = self._aggregated(df, kept, n.body, name)
                self.side.append((side, [k for k, _ in kept]))
                return Done(name, dtype)
            raise Unsupported("missing_outer_aggregation", f"{n.kind} needs an outer aggregate here")

        def over_lod(call: Call, n: Lod) -> Node:
            """An aggregate of an INCLUDE level: group at view and dims, then at the view."""
            inner = self._fresh("i")
            extra = [(self._fresh("k"), self._row(self.model.inline(Field(d))).col) for d in n.dims if d not in names]
            side, dtype = self._aggregated(df, [*keys, *extra], n.body, inner)
            name = self._fresh("v")
            outer = aggregate(call.name, dtype, [F.col(inner)]).alias(name)
            side = side.groupBy(*[F.col(f"`{k}`") for k, _ in keys]).agg(outer)
            self.side.append((side, [k for k, _ in keys]))
            return Done(name, "number" if AGGREGATES[call.name][2] == "number" else dtype)

        def over_fixed(call: Call, done: Done) -> Node:
            """An aggregate of a FIXED value: over distinct (view, dims) tuples."""
            lod_ = next(x for x in self.fixed if x[1] == done.name)[0]
            extra = [(self._fresh("k"), self._row(self.model.inline(Field(d))).col) for d in lod_.dims if d not in names]
            side = df.groupBy(*[c.alias(k) for k, c in [*keys, *extra]]).agg(F.first(F.col(done.name)).alias(done.name))
            name = self._fresh("v")
            side = side.groupBy(*[F.col(f"`{k}`") for k, _ in keys]).agg(aggregate(call.name, done.dtype, [F.col(done.name)]).alias(name))
            self.side.append((side, [k for k, _ in keys]))
            return Done(name, "number" if AGGREGATES[call.name][2] == "number" else done.dtype)

        def visit(n: Node) -> Node:
            if isinstance(n, Call) and n.name == "TOTAL":
                return n  # compiled with its addressing, from base rows
            if isinstance(n, Call) and n.name in AGGREGATES and not (n.name in ("MIN", "MAX") and len(n.args) == 2):
                arg = n.args[0]
                if isinstance(arg, Lod) and arg.kind == "EXCLUDE":
                    return lod(arg)
                if isinstance(arg, Lod):
                    return over_lod(n, arg)
                if isinstance(arg, Done) and any(arg.name == x[1] for x in self.fixed):
                    dims = next(x for x in self.fixed if x[1] == arg.name)[0].dims
                    return over_fixed(n, arg) if dims else self._constant(arg, hidden)
                typed = self._aggregate(n)
                name = next((a for a, t in self.seen.items() if t == n), None)
                if name is None:
                    name = self._fresh("a")
                    self.seen[name] = n
                    hidden[name] = typed.col
                return Done(name, typed.dtype)
            if isinstance(n, Lod):
                return lod(n)
            if isinstance(n, Done) and any(n.name == x[1] for x in self.fixed):
                return self._constant(n, hidden)
            return n

        def down(n: Node) -> Node:
            new = visit(n)
            if new is not n or (isinstance(n, Call) and n.name == "TOTAL"):
                return new
            from dataclasses import fields as fields_of
            from dataclasses import replace

            def again(v):
                if isinstance(v, Node):
                    return down(v)
                return tuple(again(x) for x in v) if isinstance(v, tuple) else v

            return replace(n, **{f.name: again(getattr(n, f.name)) for f in fields_of(n)})  # type: ignore[type-var,arg-type]

        return down(tree)

    def _constant(self, done: Done, hidden: dict[str, Column]) -> Node:
        """A FIXED value as one value of each mark: that of its rows, the smallest if they differ."""
        name = self._fresh("a")
        hidden[name] = F.min(F.col(done.name))
        return Done(name, done.dtype)

    def _post(self, tree: Node, marks: DataFrame, types: dict[str, str], at: Addressing, df: DataFrame, keys: list[tuple[str, Column]]) -> Typed:
        """An expression over marks; fields are the view's dimensions."""

        def resolve(name: str) -> Typed:
            if name in types:
                return Typed(F.col(f"`{name}`"), types[name])
            raise Unsupported("missing_outer_aggregation", f"[{name}] is no dimension of the view and has no aggregate")

        def special(n: Node) -> Typed | None:
            if isinstance(n, Call) and n.name in TABLE_CALCS:
                return table_calc(n, compiler, at, total)
            return None

        def total(arg: Node) -> Typed:
            name = self._fresh("t")
            kept = [(k, c) for k, c in keys if k in at.partition]
            side, dtype = self._aggregated(df, kept, arg, name)
            self.late.append((side, [k for k, _ in kept]))
            return Typed(F.col(name), dtype)

        if any(isinstance(n, Call) and n.name == "PREVIOUS_VALUE" for n in walk(tree)):
            return self._folded(tree, types, at)
        compiler = Compiler(resolve, self._value, self.model.anchor_column(), special)
        return compiler(tree)

    def _folded(self, tree: Node, types: dict[str, str], at: Addressing) -> Typed:
        """An expression with PREVIOUS_VALUE: the marks up to each one are folded in order, from its argument at the first.

        A mark's fold reads the marks before it, so the cost is the square of a partition's marks,
        which are the rows of a view.
        """
        calls = [n for n in walk(tree) if isinstance(n, Call) and n.name in TABLE_CALCS]
        if any(n.name != "PREVIOUS_VALUE" for n in calls) or any(len(n.args) != 1 for n in calls):
            raise Unsupported("language_gap", "PREVIOUS_VALUE beside other table calculations")
        used = {n.name: n.dtype for n in walk(tree) if isinstance(n, Done)} | {n.name: types[n.name] for n in walk(tree) if isinstance(n, Field) and n.name in types}

        def compiled(node: Node, item: Column, before: Typed | None) -> Typed:
            def special(n: Node) -> Typed | None:
                if isinstance(n, Done):
                    return Typed(item[n.name], n.dtype)
                if isinstance(n, Call) and n.name == "PREVIOUS_VALUE":
                    return before
                return None

            def resolve(name: str) -> Typed:
                if name not in types:
                    raise Unsupported("missing_outer_aggregation", f"[{name}] is no dimension of the view and has no aggregate")
                return Typed(item[name], types[name])

            return Compiler(resolve, self._value, self.model.anchor_column(), special)(node)

        items = F.struct(*[F.col(f"`{n}`") for n in used], F.lit(1).alias("__one"))
        begin = compiled(calls[0].args[0], items, None)
        spark_type = {"number": "double", "text": "string", "bool": "boolean", "date": "timestamp"}.get(begin.dtype, "double")

        def step(acc: Column, item: Column) -> Column:
            first = compiled(calls[0].args[0], item, None).col.cast(spark_type)
            value = compiled(tree, item, Typed(F.when(acc["first"], first).otherwise(acc["value"]), begin.dtype))
            return F.struct(F.lit(False).alias("first"), value.col.cast(spark_type).alias("value"))

        so_far = F.collect_list(items).over(at.ordered().rowsBetween(W.unboundedPreceding, W.currentRow))
        zero = F.struct(F.lit(True).alias("first"), F.lit(None).cast(spark_type).alias("value"))
        return Typed(F.aggregate(so_far, zero, step, lambda acc: acc["value"]), begin.dtype)

    def _addressing(self, spec: dict, outputs: list[_Output], types: dict[str, str]) -> Addressing:
        dims = [o.name for o in outputs if o.dimension]
        partition = [d for d in spec.get("partition", [])]
        address = spec.get("address")
        if "scope" in spec:  # over the shelves that the request names
            partition, address = scope(spec["scope"], list(self.request.get("rows", [])), list(self.request.get("columns", [])))
            spec = {**spec, "partition": partition}
        if address is None:
            address = [d for d in dims if d not in partition]
        elif "partition" not in spec:
            flat = [a if isinstance(a, str) else a[0] for a in address]
            partition = [d for d in dims if d not in flat]
        for d in [*partition, *(a if isinstance(a, str) else a[0] for a in address)]:
            if d not in types:
                raise Unsupported("missing_addressing_intent", f"[{d}] isn't in the view")
        order = [(a, True) if isinstance(a, str) else (a[0], str(a[1]).upper() != "DESC") for a in address]
        rest = [(d, True) for d in dims if d not in partition and d not in {o for o, _ in order}]
        return Addressing(tuple(partition), tuple(order + rest))

    # -- finish ------------------------------------------------------------------------------

    def _totals(self, df: DataFrame, keys: list[tuple[str, Column]], one: list[Column]) -> DataFrame:
        """Marks with total rows: aggregates are computed again from the rows, never summed."""
        df = df.withColumns({n: c for n, c in keys})
        names = [F.col(f"`{n}`") for n, _ in keys]
        if self.request["totals"] == "rollup":
            return df.rollup(*names).agg(*one, F.grouping_id().alias("totalLevel"))
        if self.request["totals"] == "cube":
            return df.cube(*names).agg(*one, F.grouping_id().alias("totalLevel"))
        sets = [[n for n, _ in keys], []]
        return df.groupingSets([[F.col(f"`{n}`") for n in s] for s in sets], *names).agg(*one, F.grouping_id().alias("totalLevel"))

    def _finish(self, marks: DataFrame, outputs: list[_Output], types: dict[str, str]) -> DataFrame:
        columns = []
        for o in outputs:
            c = F.col(f"`{o.name}`")
            places = o.spec.get("maxDecimalPlaces")
            columns.append((F.round(c, places) if places is not None else c).alias(o.name))
        if "totalLevel" in marks.columns:
            columns.append(F.col("totalLevel"))
        order = sorted((o for o in outputs if "sortPriority" in o.spec or "sortDirection" in o.spec), key=lambda o: o.spec.get("sortPriority", 1 << 30))
        out = marks.select(*columns)
        if order:
            by = [F.col(f"`{o.name}`").desc_nulls_last() if o.spec.get("sortDirection", "ASC") == "DESC" else F.col(f"`{o.name}`").asc_nulls_first() for o in order]
            ties = [F.col(f"`{o.name}`").asc_nulls_first() for o in outputs if o.dimension and o not in order]
            out = out.orderBy(*by, *ties)
        return out.limit(int(self.request["limit"])) if "limit" in self.request else out


def run_request(model: SemanticModel, request: dict) -> DataFrame:
    """The result of a request."""
    return Query(model, request).run()
