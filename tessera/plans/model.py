"""Semantic model: relations, relationships, parameters, calculations, groups, bins, security.

A field is known by its caption; a caption that several relations have must be written
Relation.Field. Relationships are many-to-one edges; a query starts at the one relation
from which every other relation it uses is reached, so measures are never fanned out.
"""

from __future__ import annotations

import datetime as dt
import difflib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.ast import Call, Field, Node, Param, rewrite, walk
from tessera.plans.binder import AGGREGATES, TABLE_CALCS, Typed, dtype_of, literal
from tessera.plans.errors import Unsupported
from tessera.plans.parser import parse

LONGEST_PATH, SEARCH_BUDGET = 4, 20_000


@dataclass(frozen=True)
class Relationship:
    """Many side to one side, over one column or several. cardinality: many_to_one, or many_to_many where the target isn't unique."""

    many: str
    many_key: str | tuple[str, ...]
    one: str
    one_key: str | tuple[str, ...]
    active: bool = True
    cardinality: str = "many_to_one"


@dataclass(frozen=True)
class Parameter:
    """A named value: default, allowed members with labels, or a range."""

    name: str
    value: object
    members: tuple[tuple[object, str], ...] = ()
    low: float | None = None
    high: float | None = None
    step: float | None = None

    def domain(self, spark: SparkSession, most: int = 10_000) -> DataFrame:
        """(value, label) of every allowed value; a default off a range's grid is one too."""
        if self.members:
            return spark.createDataFrame(list(self.members), ["value", "label"])
        if self.low is None or self.step is None or self.step <= 0:
            raise Unsupported("model_object_parameter", f"{self.name} has no list or range")
        if self.high is not None and int((self.high - self.low) / self.step + 1e-9) + 1 > most:
            raise Unsupported("model_object_parameter", f"the range of {self.name} has more than {most} values")
        high = self.high if self.high is not None else self.low + self.step * (most - 1)
        n = min(most, int((high - self.low) / self.step + 1e-9) + 1)
        grid = spark.range(n).select((F.lit(float(self.low)) + F.col("id") * float(self.step)).alias("value"))
        grid = grid.unionByName(spark.createDataFrame([(float(self.value),)], ["value"])).distinct()  # type: ignore[arg-type]
        return grid.select("value", F.col("value").cast("string").alias("label"))


@dataclass(frozen=True)
class Calc:
    name: str
    formula: str
    tree: Node


@dataclass(frozen=True)
class Bin:
    """floor((x - peg) / size) * size + peg; size is a number or a parameter's name."""

    name: str
    source: str
    size: float | str
    peg: float = 0.0


@dataclass(frozen=True)
class Group:
    """Labels of members; other values stay, or become NULL."""

    name: str
    source: str
    labels: dict[str, tuple[object, ...]]
    keep_others: bool = True


@dataclass
class Relation:
    name: str
    df: DataFrame
    captions: dict[str, str]
    island: str = ""


@dataclass
class SemanticModel:
    spark: SparkSession
    relations: dict[str, Relation] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    parameters: dict[str, Parameter] = field(default_factory=dict)
    calcs: dict[str, Calc] = field(default_factory=dict)
    bins: dict[str, Bin] = field(default_factory=dict)
    groups: dict[str, Group] = field(default_factory=dict)
    hierarchies: dict[str, tuple[str, ...]] = field(default_factory=dict)
    security: list[tuple[str, str]] = field(default_factory=list)
    anchor: dt.date | dt.datetime | None = None

    # -- building --------------------------------------------------------------------------

    def add(self, name: str, df: DataFrame, captions: dict[str, str] | None = None, island: str = "") -> SemanticModel:
        """A relation; captions maps column to caption and defaults to the column names. Columns without a static type are left out."""
        usable = [f.name for f in df.schema.fields if dtype_of(f.dataType)]
        self.relations[name] = Relation(name, df, {(captions or {}).get(c, c): c for c in usable}, island)
        return self

    def relate(self, many: str, many_key: str | tuple[str, ...], one: str, one_key: str | tuple[str, ...], active: bool = True, measure: bool = False) -> SemanticModel:
        """A relationship; with ``measure`` the one side's uniqueness is checked and recorded."""
        from tessera.operators.relationships import is_unique

        if isinstance(many_key, str) != isinstance(one_key, str) or (not isinstance(many_key, str) and len(many_key) != len(one_key)):
            raise Unsupported("type_or_shape_mismatch", f"{many} and {one} need as many key columns on either side")

        kind = "many_to_one" if not measure or is_unique(self.relations[one].df, one_key) else "many_to_many"
        self.relationships.append(Relationship(many, many_key, one, one_key, active, kind))
        return self

    def calc(self, name: str, formula: str) -> SemanticModel:
        self.calcs[name] = Calc(name, formula, parse(formula))
        return self

    def parameter(self, name: str, value, members=(), low=None, high=None, step=None) -> SemanticModel:
        self.parameters[name] = Parameter(name, value, tuple(members), low, high, step)
        return self

    def bin(self, name: str, source: str, size: float | str, peg: float = 0.0) -> SemanticModel:
        self.bins[name] = Bin(name, source, size, peg)
        return self

    def group(self, name: str, source: str, labels: dict[str, tuple], keep_others: bool = True) -> SemanticModel:
        self.groups[name] = Group(name, source, labels, keep_others)
        return self

    def hierarchy(self, name: str, levels: tuple[str, ...]) -> SemanticModel:
        if len({self.locate(level)[0] for level in levels}) > 1:
            raise Unsupported("unresolved_reference", f"the levels of {name} lie in several relations")
        self.hierarchies[name] = levels
        return self

    def secure(self, relation: str, formula: str) -> SemanticModel:
        """Row security: [Field] = USERNAME(); any other formula closes every relation."""
        self.security.append((relation, formula))
        return self

    # -- names -----------------------------------------------------------------------------

    def locate(self, name: str, near: set[str] = frozenset()) -> tuple[str, str]:  # type: ignore[assignment]
        """(relation, column) of a caption: exact, else without case if that is unambiguous.

        near: relations that other fields pin; they settle a caption that several relations have.
        """
        if "." in name:
            table, _, caption = name.partition(".")
            if table in self.relations and caption in self.relations[table].captions:
                return table, self.relations[table].captions[caption]
        for same in (lambda a, b: a == b, lambda a, b: a.casefold() == b.casefold()):
            found = [(r.name, col) for r in self.relations.values() for cap, col in r.captions.items() if same(cap, name)]
            pinned = [f for f in found if f[0] in near]
            if len(found) == 1 or len(pinned) == 1:
                return (pinned or found)[0]
            if found:
                raise Unsupported("unresolved_reference", f"[{name}] is in {', '.join(sorted(t for t, _ in found))}")
        known = [c for r in self.relations.values() for c in r.captions] + list(self.calcs)
        hint = difflib.get_close_matches(name, known, 3)
        raise Unsupported("unresolved_reference", f"[{name}] is no field" + (f"; did you mean {', '.join(hint)}?" if hint else ""))

    def value(self, name: str, given: dict | None = None) -> Typed:
        """The literal of a parameter."""
        p = next((p for n, p in self.parameters.items() if n.casefold() == name.casefold()), None)
        if p is None:
            raise Unsupported("model_object_parameter", f"parameter {name}")
        return literal((given or {}).get(p.name, p.value))

    def inline(self, node: Node, above: tuple[str, ...] = ()) -> Node:
        """The tree with calculations that it names put in place; cycles are refused."""

        def change(n: Node) -> Node | None:
            if isinstance(n, Field) and n.name in self.calcs:
                if n.name in above:
                    raise Unsupported("unresolved_reference", f"[{n.name}] depends on itself")
                return self.inline(self.calcs[n.name].tree, (*above, n.name))
            if isinstance(n, Call) and n.name in ("SUM", "AVG", "MIN", "MAX", "MEDIAN", "ATTR") and len(n.args) == 1 and isinstance(n.args[0], Param):
                return n.args[0]  # an aggregate of one value is that value
            return None

        return rewrite(node, change)

    def dependency_order(self) -> list[list[str]]:
        """Calculations in layers, each using earlier ones only; members of a cycle are left out."""
        uses = {n: {f.name for f in walk(c.tree) if isinstance(f, Field) and f.name in self.calcs} for n, c in self.calcs.items()}
        layers, done = [], set()
        while ready := sorted(n for n in uses if n not in done and uses[n] <= done):
            layers.append(ready)
            done |= set(ready)
        return layers

    def is_row_level(self, name: str) -> bool:
        """Whether a calculation is a row expression all the way down."""
        return not any(isinstance(n, Call) and (n.name in AGGREGATES or n.name in TABLE_CALCS) for n in walk(self.inline(self.calcs[name].tree)))

    def check(self, formula: str) -> list[str]:
        """What is wrong with the references of a formula; empty if nothing is."""
        out = []
        for n in walk(parse(formula)):
            try:
                if isinstance(n, Param):
                    self.value(n.name)
                elif isinstance(n, Field) and n.name not in self.calcs and n.name not in self.bins and n.name not in self.groups:
                    self.locate(n.name)
            except Unsupported as e:
                out.append(e.reason)
        return out

    # -- joined frames ---------------------------------------------------------------------

    def _upward(self, start: str) -> dict[str, list[Relationship]]:
        """The path from a relation to each one that many-to-one edges lead to; two paths make it unusable."""
        paths: dict[str, list[Relationship]] = {start: []}
        twice, queue, steps = set(), [start], 0
        while queue:
            at = queue.pop(0)
            for e in self.relationships:
                steps += 1
                if steps > SEARCH_BUDGET:
                    raise Unsupported("unresolved_reference", "too many relationships to search")
                if e.many == at and e.active and e.cardinality == "many_to_one" and len(paths[at]) < LONGEST_PATH:
                    if e.one in paths:
                        twice.add(e.one)
                    else:
                        paths[e.one] = [*paths[at], e]
                        queue.append(e.one)
        return {t: p for t, p in paths.items() if t not in twice and not any(e.many in twice for e in p)}

    def root(self, tables: set[str]) -> tuple[str, dict[str, list[Relationship]]]:
        """The relation to start from and the paths to the others."""
        best = None
        for name in self.relations:
            paths = self._upward(name)
            if tables <= set(paths) and (best is None or sum(len(paths[t]) for t in tables) < best[2]):
                best = (name, paths, sum(len(paths[t]) for t in tables))
        if best is None:
            raise Unsupported("unresolved_reference", f"no single relation reaches {', '.join(sorted(tables))}")
        return best[0], best[1]

    def frame(self, tables: set[str], user: str | None = None) -> tuple[DataFrame, str]:
        """Relations joined from their root; columns are named relation.column. Row security is applied to each."""
        start, paths = self.root(tables)
        edges = list({e: None for t in sorted(tables, key=lambda t: len(paths[t])) for e in paths[t]})
        df = self._renamed(start, user)
        for e in edges:
            one = self._renamed(e.one, user)
            pairs = [(e.many_key, e.one_key)] if isinstance(e.many_key, str) else list(zip(e.many_key, e.one_key))
            df = df.join(one, [F.col(f"`{e.many}.{a}`") == F.col(f"`{e.one}.{b}`") for a, b in pairs], "left")
        return df, start

    def _renamed(self, name: str, user: str | None) -> DataFrame:
        r = self.relations[name]
        df = self.secured(name, user)
        return df.select([F.col(c).alias(f"{name}.{c}") for c in r.captions.values()])

    def secured(self, name: str, user: str | None) -> DataFrame:
        """A relation's rows that its security lets the user see."""
        df = self.relations[name].df
        for relation, formula in self.security:
            tree = parse(formula)
            plain = next((f for f in walk(tree) if isinstance(f, Field)), None)
            calls = [c for c in walk(tree) if isinstance(c, Call)]
            simple = type(tree).__name__ == "Binary" and tree.op == "=" and plain is not None and [c.name for c in calls] == ["USERNAME"] and len(list(walk(tree))) == 3  # type: ignore[attr-defined]
            if not simple:
                return df.where(F.lit(False))  # what can't be translated closes all data
            if relation == name:
                column = self.relations[name].captions.get(plain.name)  # type: ignore[union-attr]
                df = df.where(F.col(column) == F.lit(user)) if column and user is not None else df.where(F.lit(False))
        return df

    def column(self, name: str, given: dict | None = None, near: set[str] = frozenset()) -> Typed:  # type: ignore[assignment]
        """A field, bin or group as a Column over a joined frame."""
        if name in self.bins:
            b = self.bins[name]
            x = self.column(b.source, given, near).col
            size = self.value(b.size, given).col if isinstance(b.size, str) else F.lit(b.size)
            return Typed(F.floor((x - b.peg) / size) * size + b.peg, "number")
        if name in self.groups:
            g = self.groups[name]
            x = self.column(g.source, given, near)
            out = None
            for label, members in g.labels.items():
                test = x.col.isin(*members)
                out = F.when(test, label) if out is None else out.when(test, label)
            other = x.col.cast("string") if g.keep_others else F.lit(None)
            return Typed(out.otherwise(other) if out is not None else other, "text")
        table, col = self.locate(name, near)
        return Typed(F.col(f"`{table}.{col}`"), dtype_of(self.relations[table].df.schema[col].dataType) or "text")

    def tables_of(self, names: set[str]) -> set[str]:
        """Relations that fields, bins and groups come from."""
        out, unsure = set(), []
        for n in names:
            n = self.bins[n].source if n in self.bins else self.groups[n].source if n in self.groups else n
            try:
                out.add(self.locate(n)[0])
            except Unsupported:
                unsure.append(n)
        return out | {self.locate(n, out)[0] for n in unsure}

    def anchor_column(self) -> Column | None:
        return F.lit(self.anchor) if self.anchor is not None else None
