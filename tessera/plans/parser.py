"""Formula text to syntax tree.

Precedence, low to high: OR, AND, NOT, comparison and IN, + -, * / %, ^ (to the right),
unary minus. Fields stand in brackets (a closing bracket in a name is doubled), parameters
are [Parameters].[Name], strings take either quote and double it inside, dates stand
between # signs. // and /* */ are comments. Names of functions ignore case.
"""

from __future__ import annotations

import datetime as dt
import re

from tessera.plans.ast import Binary, Call, Cond, Field, In, Lit, Lod, Node, Param, Unary
from tessera.plans.errors import Unsupported

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      |(?P<field>\[(?:[^\]]|\]\])+\](?:\s*\.\s*\[(?:[^\]]|\]\])+\])?)
      |(?P<str>"(?:[^"]|"")*"|'(?:[^']|'')*')
      |(?P<date>\#[^#]+\#)
      |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<name>[A-Za-z_][A-Za-z_0-9]*)
      |(?P<op><=|>=|<>|!=|==|[-+*/%^=<>(){},:])""",
    re.X | re.S,
)
_DATE_FORMS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%B %d, %Y", "%B %d, %Y %H:%M:%S", "%m/%d/%Y", "%m/%d/%Y %H:%M:%S")
_SAME = {"==": "=", "!=": "<>"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unsupported("type_or_shape_mismatch", f"cannot read {text[at:at + 20]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup or "", m.group()))
        at = m.end()
    return [*out, ("end", "")]


def date_literal(body: str) -> dt.date | dt.datetime:
    for form in _DATE_FORMS:
        try:
            found = dt.datetime.strptime(body.strip(), form)
        except ValueError:
            continue
        return found if "%H" in form else found.date()
    raise Unsupported("type_or_shape_mismatch", f"date literal {body!r}")


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, *words: str) -> bool:
        kind, said = self.tokens[self.at]
        return kind in ("op", "name") and said.upper() in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise Unsupported("type_or_shape_mismatch", f"expected {word}, found {self.tokens[self.at][1]!r}")

    def chain(self, ops: tuple[str, ...], below) -> Node:
        left = below()
        while op := self.take(*ops):
            left = Binary(_SAME.get(op, op), left, below())
        return left

    def expression(self) -> Node:
        return self.chain(("OR",), lambda: self.chain(("AND",), self.negation))

    def negation(self) -> Node:
        if self.take("NOT"):
            return Unary("NOT", self.negation())
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sums()
        if op := self.take("=", "==", "<>", "!=", "<", ">", "<=", ">="):
            return Binary(_SAME.get(op, op), left, self.sums())
        if self.take("IN"):
            self.need("(")
            return In(left, self.listed(")"))
        return left

    def sums(self) -> Node:
        return self.chain(("+", "-"), lambda: self.chain(("*", "/", "%"), self.power))

    def power(self) -> Node:
        base = self.signed()
        if self.take("^"):
            return Binary("^", base, self.power())
        return base

    def signed(self) -> Node:
        if self.take("-"):
            return Unary("-", self.signed())
        if self.take("+"):
            return self.signed()
        return self.primary()

    def listed(self, close: str) -> tuple[Node, ...]:
        out = []
        while not self.take(close):
            if out:
                self.need(",")
            out.append(self.expression())
        return tuple(out)

    def primary(self) -> Node:
        kind, said = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return Lit(int(said) if said.isdigit() else float(said))
        if kind == "str":
            self.at += 1
            return Lit(said[1:-1].replace(said[0] * 2, said[0]))
        if kind == "date":
            self.at += 1
            return Lit(date_literal(said[1:-1]))
        if kind == "field":
            self.at += 1
            parts = [p.replace("]]", "]") for p in re.findall(r"\[((?:[^\]]|\]\])+)\]", said)]
            if len(parts) == 1:
                return Field(parts[0])
            if parts[0].casefold() == "parameters":
                return Param(parts[1])
            return Field(".".join(parts))
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("{"):
            return self.level_of_detail()
        if kind == "name":
            self.at += 1
            return self.named(said.upper())
        raise Unsupported("type_or_shape_mismatch", f"unexpected {said!r}")

    def level_of_detail(self) -> Node:
        kind, dims = "FIXED", []
        if word := self.take("FIXED", "INCLUDE", "EXCLUDE"):
            kind = word
            while self.tokens[self.at][0] == "field":
                dim = self.primary()
                if not isinstance(dim, Field):
                    raise Unsupported("model_object_parameter", "a parameter as a level-of-detail dimension")
                dims.append(dim.name)
                self.take(",")
            self.need(":")
        body = self.expression()
        self.need("}")
        return Lod(kind, tuple(dims), body)

    def named(self, name: str) -> Node:
        if name in ("TRUE", "FALSE"):
            return Lit(name == "TRUE")
        if name == "NULL":
            return Lit(None)
        if name == "IF":
            arms = []
            while True:
                test = self.expression()
                self.need("THEN")
                arms.append((test, self.expression()))
                if not self.take("ELSEIF"):
                    break
            other = self.expression() if self.take("ELSE") else None
            self.need("END")
            return Cond(tuple(arms), other)
        if name == "CASE":
            operand = None if self.peek("WHEN") else self.expression()
            arms = []
            while self.take("WHEN"):
                test = self.expression()
                self.need("THEN")
                arms.append((test if operand is None else Binary("=", operand, test), self.expression()))
            other = self.expression() if self.take("ELSE") else None
            self.need("END")
            return Cond(tuple(arms), other)
        self.need("(")
        args = self.listed(")")
        if name == "IIF":
            if len(args) not in (3, 4):
                raise Unsupported("type_or_shape_mismatch", "IIF takes three or four arguments")
            return Cond(((args[0], args[1]),), args[2], args[3] if len(args) == 4 else None)
        return Call(name, args)


def parse(text: str) -> Node:
    """The tree of a whole formula."""
    p = _Parser(text)
    node = p.expression()
    if p.tokens[p.at][0] != "end":
        raise Unsupported("type_or_shape_mismatch", f"unexpected {p.tokens[p.at][1]!r}")
    return node
