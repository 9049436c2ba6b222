"""Scalar functions of the calculation language as Spark Columns.

Each entry says what static types it takes and gives, so a mismatch is refused before a
plan exists. Types: number, text, bool, date (dates and timestamps), any. Division by zero,
impossible dates and failed casts give NULL rather than the run-time errors of ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.errors import Unsupported


@dataclass(frozen=True)
class Scalar:
    """Argument types (optional ones after a ?), result type and builder."""

    takes: str
    gives: str
    build: Callable[..., Column]


def divide(a: Column, b: Column) -> Column:
    """Quotient; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return F.when(b != 0, a - b * F.floor(divide(a, b)))


def _whole(a: Column, b: Column) -> Column:
    q = divide(a, b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def proper(s: Column) -> Column:
    """Each run of letters with a capital first, the rest small; any other character ends a run."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def week(d: Column) -> Column:
    """Week of the year, Sunday first, week 1 holding January 1."""
    first = F.dayofweek(F.trunc(d, "YEAR")) - 1
    return (F.floor((F.dayofyear(d) - 1 + first) / 7) + 1).cast("int")


def _unit(part) -> str:
    if not isinstance(part, str) or part.lower() not in ("second", "minute", "hour", "day", "weekday", "week", "month", "quarter", "year", "dayofyear", "iso-week", "iso-year", "iso-quarter", "iso-weekday"):
        raise Unsupported("type_or_shape_mismatch", f"date part {part!r}")
    return part.lower()


def trunc_date(part, d: Column) -> Column:
    """Start of the period; weeks begin on Sunday."""
    unit = _unit(part)
    if unit == "week":
        day = F.to_date(d)
        return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp")
    if unit in ("iso-week", "weekday", "dayofyear", "iso-year", "iso-quarter", "iso-weekday"):
        return F.date_trunc({"iso-week": "week", "iso-quarter": "quarter"}.get(unit, "day" if unit != "iso-year" else "year"), d)
    return F.date_trunc(unit, d)


def date_part(part, d: Column) -> Column:
    unit = _unit(part)
    plain = {"second": F.second, "minute": F.minute, "hour": F.hour, "day": F.dayofmonth, "weekday": F.dayofweek, "week": week, "month": F.month, "quarter": F.quarter, "year": F.year, "dayofyear": F.dayofyear, "iso-week": F.weekofyear, "iso-quarter": F.quarter}
    if unit == "iso-weekday":
        return F.weekday(d) + 1
    if unit == "iso-year":
        return F.extract(F.lit("YEAROFWEEK"), d)
    return plain[unit](d)


def date_name(part, d: Column) -> Column:
    unit = _unit(part)
    form = {"year": "yyyy", "month": "MMMM", "weekday": "EEEE"}.get(unit)
    return F.date_format(d, form) if form else date_part(part, d).cast("string")


def date_add(part, n: Column, d: Column) -> Column:
    """Moved by whole units; months clamp to the month's end, the time of day stays."""
    unit = {"weekday": "DAY", "dayofyear": "DAY"}.get(_unit(part), _unit(part).upper())
    if unit.startswith("ISO"):
        raise Unsupported("language_gap", f"DATEADD by {part}")
    return F.timestamp_add(unit, n.cast("int"), d.cast("timestamp"))


def date_diff(part, a: Column, b: Column) -> Column:
    """Boundaries of the unit crossed from a to b."""
    unit = _unit(part)
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if unit in ("month", "quarter"):
        index = lambda d: F.year(d) * (12 if unit == "month" else 4) + (F.month(d) if unit == "month" else F.quarter(d))
        return (index(b) - index(a)).cast("bigint")
    if unit in ("week", "iso-week"):
        return (F.datediff(trunc_date(unit, b), trunc_date(unit, a)) / 7).cast("bigint")
    if unit in ("day", "weekday", "dayofyear"):
        return F.datediff(b, a).cast("bigint")
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    index = lambda d: F.floor(F.unix_timestamp(d.cast("timestamp")) / size)
    return (index(b) - index(a)).cast("bigint")


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.to_date(F.try_make_timestamp(y.cast("int"), m.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0)))


def find(s: Column, sub: Column, start: Column | None = None) -> Column:
    """Place of the first match from start on, counted from 1; 0 without one."""
    return F.call_function("locate", sub, s, F.lit(1) if start is None else start.cast("int"))


def _find_nth(s: Column, sub: Column, n: Column) -> Column:
    before = F.call_function("substring_index", s, sub, n.cast("int"))
    return F.when(F.length(before) < F.length(s), F.length(before) + 1).otherwise(0)


def _split(s: Column, by: Column, n: Column) -> Column:
    return F.call_function("split_part", s, by, n.cast("int"))


def _text(x: Column) -> Column:
    return x.cast("string")


_MATH = {"ABS": F.abs, "SIGN": F.signum, "EXP": F.exp, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "COT": F.cot, "DEGREES": F.degrees, "RADIANS": F.radians}

SCALARS: dict[str, Scalar] = {
    **{name: Scalar("number", "number", f) for name, f in _MATH.items()},
    "SQRT": Scalar("number", "number", lambda x: F.when(x >= 0, F.sqrt(x))),
    "LN": Scalar("number", "number", lambda x: F.when(x > 0, F.log(x))),
    "LOG": Scalar("number ?number", "number", lambda x, b=None: F.when(x > 0, F.log10(x) if b is None else divide(F.log(x), F.log(b)))),
    "LOG2": Scalar("number", "number", lambda x: F.when(x > 0, F.log2(x))),
    "ASIN": Scalar("number", "number", lambda x: _finite(F.asin(x))),
    "ACOS": Scalar("number", "number", lambda x: _finite(F.acos(x))),
    "ATAN2": Scalar("number number", "number", F.atan2),
    "PI": Scalar("", "number", F.pi),
    "POWER": Scalar("number number", "number", F.pow),
    "SQUARE": Scalar("number", "number", lambda x: x * x),
    "CEILING": Scalar("number", "number", lambda x: F.ceil(x).cast("bigint")),
    "FLOOR": Scalar("number", "number", lambda x: F.floor(x).cast("bigint")),
    "ROUND": Scalar("number ?=number", "number", lambda x, n=0: F.round(x, int(n))),
    "DIV": Scalar("number number", "number", _whole),
    "MOD": Scalar("number number", "number", modulo),
    "INT": Scalar("any", "number", lambda x: x.try_cast("double").cast("bigint")),
    "FLOAT": Scalar("any", "number", lambda x: x.try_cast("double")),
    "STR": Scalar("any", "text", _text),
    "LEN": Scalar("text", "number", F.length),
    "UPPER": Scalar("text", "text", F.upper),
    "LOWER": Scalar("text", "text", F.lower),
    "PROPER": Scalar("text", "text", proper),
    "ASCII": Scalar("text", "number", F.ascii),
    "CHAR": Scalar("number", "text", lambda n: F.when((n >= 0) & (n < 256), F.char(n.cast("int")))),
    "SPACE": Scalar("number", "text", lambda n: F.repeat(F.lit(" "), n.cast("int"))),
    "LEFT": Scalar("text number", "text", lambda s, n: F.left(s, n.cast("int"))),
    "RIGHT": Scalar("text number", "text", lambda s, n: F.right(s, n.cast("int"))),
    "MID": Scalar("text number ?number", "text", lambda s, a, n=None: F.substring(s, a.cast("int"), F.lit(2147483647) if n is None else n.cast("int"))),
    "REPLACE": Scalar("text text text", "text", F.replace),
    "CONTAINS": Scalar("text text", "bool", F.contains),
    "STARTSWITH": Scalar("text text", "bool", F.startswith),
    "ENDSWITH": Scalar("text text", "bool", F.endswith),
    "FIND": Scalar("text text ?number", "number", find),
    "FINDNTH": Scalar("text text number", "number", _find_nth),
    "TRIM": Scalar("text", "text", F.trim),
    "LTRIM": Scalar("text", "text", F.ltrim),
    "RTRIM": Scalar("text", "text", F.rtrim),
    "SPLIT": Scalar("text text number", "text", _split),
    "REGEXP_MATCH": Scalar("text text", "bool", F.regexp_like),
    "REGEXP_EXTRACT": Scalar("text =text", "text", lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))),
    "REGEXP_EXTRACT_NTH": Scalar("text =text =number", "text", lambda s, p, n: F.nullif(F.regexp_extract(s, p, int(n)), F.lit(""))),
    "REGEXP_REPLACE": Scalar("text text text", "text", F.regexp_replace),
    "YEAR": Scalar("date", "number", F.year),
    "QUARTER": Scalar("date", "number", F.quarter),
    "MONTH": Scalar("date", "number", F.month),
    "DAY": Scalar("date", "number", F.dayofmonth),
    "WEEK": Scalar("date", "number", week),
    "ISOWEEK": Scalar("date", "number", F.weekofyear),
    "ISOWEEKDAY": Scalar("date", "number", lambda d: F.weekday(d) + 1),
    "ISOYEAR": Scalar("date", "number", lambda d: date_part("iso-year", d)),
    "ISOQUARTER": Scalar("date", "number", F.quarter),
    "DATEPART": Scalar("=text date ?=text", "number", lambda p, d, s=None: date_part(p, d)),
    "DATENAME": Scalar("=text date", "text", date_name),
    "DATEADD": Scalar("=text number date", "date", date_add),
    "DATEDIFF": Scalar("=text date date", "number", date_diff),
    "DATETRUNC": Scalar("=text date", "date", trunc_date),
    "DATE": Scalar("any", "date", lambda x: F.to_date(x.try_cast("timestamp"))),
    "DATETIME": Scalar("any", "date", lambda x: x.try_cast("timestamp")),
    "MAKEDATE": Scalar("number number number", "date", make_date),
    "MAKEDATETIME": Scalar("date date", "date", lambda d, t: F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", d)) + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))),
    "MAKETIME": Scalar("number number number", "date", lambda h, m, s: F.try_make_timestamp(F.lit(1899), F.lit(12), F.lit(30), h.cast("int"), m.cast("int"), s)),
    "DATEPARSE": Scalar("text text", "date", lambda f, s: F.try_to_timestamp(s, f)),
    "ISDATE": Scalar("text", "bool", lambda s: s.try_cast("timestamp").isNotNull()),
    "ISNULL": Scalar("any", "bool", lambda x: x.isNull()),
    "ZN": Scalar("number", "number", lambda x: F.coalesce(x, F.lit(0))),
    "IFNULL": Scalar("any any", "same", lambda a, b: F.coalesce(a, b)),
}
#: Names that are known but have no plan, with the reason.
REFUSED = {
    **dict.fromkeys(("MAKEPOINT", "MAKELINE", "HEXBINX", "HEXBINY", "DISTANCE", "BUFFER", "AREA"), "spatial functions aren't built"),
    **dict.fromkeys(("USERNAME", "FULLNAME", "ISMEMBEROF", "USERDOMAIN", "ISFULLNAME", "ISUSERNAME"), "the user is known to row security only"),
}
