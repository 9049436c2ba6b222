"""The calendar dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import week


def calendar(facts: list[tuple[DataFrame, str]]) -> DataFrame:
    """One row for each day from the first year's start to the last year's end of the given date columns."""
    spans = None
    for df, c in facts:
        part = df.agg(F.min(F.to_date(c)).alias("low"), F.max(F.to_date(c)).alias("high"))
        spans = part if spans is None else spans.unionByName(part)
    span = spans.agg(F.min("low").alias("low"), F.max("high").alias("high"))  # type: ignore[union-attr]
    end = F.date_sub(F.add_months(F.trunc("high", "YEAR"), 12), 1)
    d = F.col("Date")
    days = span.select(F.explode(F.sequence(F.trunc("low", "YEAR"), end)).alias("Date"))
    return days.select(
        d, F.year(d).alias("Year"), F.quarter(d).alias("Quarter"), F.month(d).alias("Month"), F.date_format(d, "MMMM").alias("MonthName"),
        F.trunc(d, "YEAR").alias("YearStart"), F.trunc(d, "QUARTER").alias("QuarterStart"), F.trunc(d, "MONTH").alias("MonthStart"),
        F.date_sub(d, F.dayofweek(d) - 1).alias("WeekStart"), week(d).alias("WeekOfYear"),
        (F.floor((F.dayofmonth(d) - 1 + F.dayofweek(F.trunc(d, "MONTH")) - 1) / 7) + 1).cast("int").alias("WeekOfMonth"),
        F.dayofmonth(d).alias("Day"), F.dayofweek(d).alias("WeekdayNo"), F.date_format(d, "EEEE").alias("DayName"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("IsoYear"), F.weekofyear(d).alias("IsoWeek"),
    )


def date_domain(facts: list[tuple[DataFrame, str]]) -> DataFrame:
    """The days between the smallest and largest date of the compared columns, as a parameter's domain."""
    spans = None
    for df, c in facts:
        part = df.agg(F.min(F.to_date(c)).alias("low"), F.max(F.to_date(c)).alias("high"))
        spans = part if spans is None else spans.unionByName(part)
    span = spans.agg(F.min("low").alias("low"), F.max("high").alias("high"))  # type: ignore[union-attr]
    return span.select(F.explode(F.sequence("low", "high")).alias("value"))
