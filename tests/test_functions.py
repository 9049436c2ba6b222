"""Scalar functions on literal frames, and refusals by category."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.plans.binder import Compiler, Typed, dtype_of, literal
from tessera.plans.errors import Unsupported
from tessera.plans.parser import parse


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([(-7, 3, 7.5, "o'brien ab", None, dt.datetime(2024, 1, 31, 10, 30), dt.datetime(2020, 12, 27))], "a long, b long, x double, s string, n long, d timestamp, e timestamp")
    kinds = {f.name: dtype_of(f.dataType) for f in df.schema.fields}

    def value(formula):
        compiled = Compiler(lambda n: Typed(F.col(n), kinds[n]), lambda n: literal(5), F.lit(dt.datetime(2025, 3, 4, 5)))(parse(formula))
        return df.select(compiled.col.alias("v")).first().v

    return value


@pytest.mark.parametrize(
    "formula,want",
    [
        ("MOD([a], [b])", 2), ("MOD(7, -3)", -2), ("[a] % -3", -1), ("DIV([a], 2)", -3), ("DIV(1, 0)", None), ("[a] / 0", None), ("INT(-2.7)", -2), ("INT('12.9')", 12), ("FLOOR(-2.1)", -3), ("CEILING(2.1)", 3), ("ROUND(2.5)", 3.0), ("ROUND(-2.45, 1)", -2.5),
        ("SQRT(-1)", None), ("LN(0)", None), ("LOG(8, 2)", 3.0), ("LOG(1000)", pytest.approx(3)), ("ACOS(2)", None), ("2 ^ 3 ^ 2", 512.0), ("-2 ^ 2", 4.0), ("SIGN(-3)", -1.0), ("SQUARE(3)", 9), ("ATAN2(1, 1)", pytest.approx(0.7853981)),
        ("PROPER([s])", "O'Brien Ab"), ("CHAR(300)", None), ("CHAR(65)", "A"), ("SPACE(2) + 'x'", "  x"), ("MID('abcdef', 3)", "cdef"), ("MID('abcdef', 2, 2)", "bc"), ("FIND('abcab', 'b', 3)", 5), ("FIND('abc', 'z')", 0), ("FINDNTH('abab', 'b', 2)", 4), ("FINDNTH('abab', 'z', 1)", 0),
        ("SPLIT('a-b-c', '-', -1)", "c"), ("REGEXP_EXTRACT('a12', '([0-9]+)')", "12"), ("REGEXP_EXTRACT_NTH('a12b', '([a-z])([0-9]+)', 2)", "12"), ("REGEXP_MATCH('abc', 'b')", True), ("'a' + [s]", "ao'brien ab"), ("'a' = 'A'", False), ("'a' < 'b'", True), ("LEFT('abc', 2) + RIGHT('abc', 1)", "abc"),
        ("WEEK([e])", 53), ("WEEK(#2021-01-02#)", 1), ("WEEK(#2021-01-03#)", 2), ("ISOWEEK([e])", 52), ("ISOYEAR(#2021-01-03#)", 2020), ("ISOWEEKDAY([e])", 7), ("DATEPART('weekday', [e])", 1), ("DATEPART('hour', [d])", 10), ("DATENAME('weekday', [e])", "Sunday"),
        ("DATEADD('month', 1, [d])", dt.datetime(2024, 2, 29, 10, 30)), ("DATEADD('year', 1, #2024-02-29#)", dt.datetime(2025, 2, 28)), ("DATEDIFF('month', [d], #2024-02-01#)", 1), ("DATEDIFF('year', #2023-12-31#, #2024-01-01#)", 1), ("DATEDIFF('week', #2021-01-02#, #2021-01-03#)", 1), ("DATEDIFF('hour', #2024-01-01 10:59:00#, #2024-01-01 11:00:00#)", 1), ("DATEDIFF('day', [d], #2024-01-30#)", -1), ("DATEDIFF('quarter', #2023-12-31#, #2024-01-01#)", 1),
        ("DATE(DATETRUNC('week', #2021-01-01#))", dt.date(2020, 12, 27)), ("DATETRUNC('quarter', #2024-05-05#)", dt.datetime(2024, 4, 1)), ("#2024-03-01# - #2024-02-28#", 2), ("#2024-02-28# + 2", dt.datetime(2024, 3, 1)), ("MAKEDATE(2024, 2, 30)", None), ("MAKEDATE(2024, 2, 29)", dt.date(2024, 2, 29)), ("DATEPARSE('yyyy', '2024')", dt.datetime(2024, 1, 1)), ("ISDATE('2024-02-30')", False), ("MAKEDATETIME(#2024-01-02#, [d])", dt.datetime(2024, 1, 2, 10, 30)), ("TODAY()", dt.date(2025, 3, 4)),
        ("IF [n] > 1 THEN 1 END", None), ("IIF([n] > 1, 'y', 'n', 'u')", "u"), ("IIF([n] > 1, 'y', 'n')", "n"), ("ZN([n])", 0), ("IFNULL([n], 4)", 4), ("ISNULL([n])", True), ("[n] = 1 OR TRUE", True), ("[n] = 1 AND TRUE", None), ("CASE [b] WHEN 3 THEN 'three' END", "three"), ("MIN(3, 2)", 2), ("MAX(3, [n])", None), ("[Parameters].[P] + 1", 6),
    ],
)
def test_value(row, formula, want):
    assert row(formula) == want


@pytest.mark.parametrize(
    "formula,category",
    [
        ("'a' + 1", "type_or_shape_mismatch"), ("[d] + [e]", "type_or_shape_mismatch"), ("IF TRUE THEN 1 ELSE 'a' END", "type_or_shape_mismatch"), ("TRUE < FALSE", "type_or_shape_mismatch"), ("[b] IN (1, 'a')", "type_or_shape_mismatch"), ("NOT 1", "type_or_shape_mismatch"), ("LEFT('a')", "type_or_shape_mismatch"), ("UPPER(1)", "type_or_shape_mismatch"),
        ("SUM([a])", "type_or_shape_mismatch"), ("RUNNING_SUM([a])", "missing_addressing_intent"), ("{FIXED : SUM([a])}", "missing_outer_aggregation"), ("MAKEPOINT(1, 2)", "language_gap"), ("SCRIPT_REAL('x')", "language_gap"), ("RAWSQL_INT('x')", "language_gap"), ("USERNAME()", "language_gap"), ("NOSUCH(1)", "unsupported_other"), ("DATEPART('eon', [d])", "type_or_shape_mismatch"),
    ],
)
def test_refusal(row, formula, category):
    with pytest.raises(Unsupported) as e:
        row(formula)
    assert e.value.category == category
