import datetime as dt

import pytest

from tessera.plans.ast import Binary, Call, Cond, Field, In, Lit, Lod, Param, Unary
from tessera.plans.errors import CATEGORIES, Unsupported
from tessera.plans.parser import parse


def test_precedence():
    assert parse("1 + 2 * 3") == Binary("+", Lit(1), Binary("*", Lit(2), Lit(3)))
    assert parse("2 ^ 3 ^ 2") == Binary("^", Lit(2), Binary("^", Lit(3), Lit(2)))
    assert parse("-2 ^ 2") == Binary("^", Unary("-", Lit(2)), Lit(2))
    assert parse("NOT [a] = 1 AND [b] = 2 OR [c] = 3").op == "OR"


def test_fields_strings_dates_and_comments():
    assert parse("[a]]b]") == Field("a]b")
    assert parse("[Parameters].[P q]") == Param("P q")
    assert parse("'it''s' // end") == Lit("it's")
    assert parse("#2020-01-31#") == Lit(dt.date(2020, 1, 31))
    assert parse("#August 22, 2005#") == Lit(dt.date(2005, 8, 22))
    assert parse("#2020-01-31 10:30:00#") == Lit(dt.datetime(2020, 1, 31, 10, 30))
    assert parse("/* c */ [x] IN (1, 2)") == In(Field("x"), (Lit(1), Lit(2)))


def test_conditionals():
    assert parse("IF [a] THEN 1 ELSEIF [b] THEN 2 END") == Cond(((Field("a"), Lit(1)), (Field("b"), Lit(2))))
    assert parse("CASE [a] WHEN 1 THEN 'x' ELSE 'y' END") == Cond(((Binary("=", Field("a"), Lit(1)), Lit("x")),), Lit("y"))
    assert parse("IIF([a], 1, 2, 3)") == Cond(((Field("a"), Lit(1)),), Lit(2), Lit(3))


def test_levels_of_detail():
    assert parse("{FIXED [a], [b] : SUM([x])}") == Lod("FIXED", ("a", "b"), Call("SUM", (Field("x"),)))
    assert parse("{MAX([x])}") == Lod("FIXED", (), Call("MAX", (Field("x"),)))
    assert parse("AVG({INCLUDE [a] : SUM([x])})").args[0].kind == "INCLUDE"


@pytest.mark.parametrize("text", ["", "1 +", "[a", "IF [a] THEN 1", "#what#", "IIF([a], 1)", "{FIXED [Parameters].[P] : SUM([x])}", "a b"])
def test_what_cannot_be_read_is_refused(text):
    with pytest.raises(Unsupported) as e:
        parse(text)
    assert e.value.category in CATEGORIES
