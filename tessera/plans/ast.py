"""Syntax tree of the calculation language, and walks over it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace


class Node:
    """Base of all nodes."""


@dataclass(frozen=True)
class Lit(Node):
    value: float | int | str | bool | dt.date | dt.datetime | None


@dataclass(frozen=True)
class Field(Node):
    name: str


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Done(Node):
    """A column that an earlier stage has made."""

    name: str
    dtype: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class In(Node):
    arg: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Cond(Node):
    """IF, IIF and CASE: (condition, value) arms, what comes else, what an unknown condition gives."""

    arms: tuple[tuple[Node, Node], ...]
    other: Node | None = None
    unknown: Node | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Lod(Node):
    """FIXED, INCLUDE or EXCLUDE dims : body. Without a keyword it is FIXED over no dimension."""

    kind: str
    dims: tuple[str, ...]
    body: Node


def children(node: Node) -> Iterator[Node]:
    for f in fields(node):  # type: ignore[arg-type]
        v = getattr(node, f.name)
        for x in v if isinstance(v, tuple) else (v,):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Node):
                    yield y


def walk(node: Node) -> Iterator[Node]:
    yield node
    for c in children(node):
        yield from walk(c)


def rewrite(node: Node, change: Callable[[Node], Node | None]) -> Node:
    """Bottom-up copy; ``change`` gives the new node, or None to keep it."""

    def again(v):
        if isinstance(v, Node):
            return rewrite(v, change)
        if isinstance(v, tuple):
            return tuple(again(x) for x in v)
        return v

    new = replace(node, **{f.name: again(getattr(node, f.name)) for f in fields(node)})  # type: ignore[type-var,arg-type]
    return change(new) or new
