"""Registered queries of the engine, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compare as cmp
from tessera.operators import extras
from tessera.operators import profile, reconcile, relationships, verify
from tessera.operators import filters as flt
from tessera.plans.model import SemanticModel
from tessera.plans.query import run_request
from tessera.sources import calendar as cal
from tessera.sources import readers
from tessera.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def star_model(spark: SparkSession, sf_dir: str) -> SemanticModel:
    """The star schema with its relationships, calculations, parameters, bins, groups and a hierarchy."""
    m = SemanticModel(spark, anchor=dt.datetime(2001, 8, 1))
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        m.add(t, readers.table(spark, sf_dir, t))
    m.relate("lineitem", "l_orderkey", "orders", "o_orderkey").relate("orders", "o_custkey", "customer", "c_custkey")
    m.relate("customer", "c_nationkey", "nation", "n_nationkey").relate("nation", "n_regionkey", "region", "r_regionkey")
    m.relate("lineitem", "l_partkey", "part", "p_partkey").relate("lineitem", "l_suppkey", "supplier", "s_suppkey")
    m.parameter("Rate", 0.5).parameter("Segment", "All").parameter("Width", 10).parameter("Show", "quantity")
    m.calc("Revenue", "SUM([l_extendedprice] * (1 - [l_discount]))")
    m.calc("Line Revenue", "[l_extendedprice] * (1 - [l_discount])")
    m.calc("Price per Unit", "[Revenue] / SUM([l_quantity])")
    m.bin("Quantity Bin", "l_quantity", "Width").bin("Size Bin", "p_size", 5)
    m.group("Priority Group", "o_orderpriority", {"high": ("1-URGENT", "2-HIGH")}, True).group("Flag Group", "l_returnflag", {"returned": ("R",)}, False)
    m.hierarchy("Ship", ("l_returnflag", "l_linestatus"))
    return m


def ask(spark: SparkSession, sf_dir: str, fields: list, **more) -> DataFrame:
    return run_request(star_model(spark, sf_dir), {"fields": fields, **more})


def f(caption: str, function: str | None = None, name: str | None = None, **more) -> dict:
    return {"fieldCaption": caption, **({"function": function} if function else {}), **({"fieldAlias": name} if name else {}), **more}


def c(formula: str, name: str, places: int | None = None, **more) -> dict:
    return {"calculation": formula, "fieldAlias": name, **({"maxDecimalPlaces": places} if places is not None else {}), **more}


def register_request(name: str, fields: list, sql: str, **more) -> None:
    """A query that is one request."""
    query(name, sql)(lambda spark, sf_dir: ask(spark, sf_dir, [dict(x) for x in fields], **more))


# -- aggregates ------------------------------------------------------------------------------

register_request(
    "agg_core",
    [f("l_returnflag"), c("SUM([l_quantity])", "sum_qty", 2), c("AVG([l_extendedprice])", "avg_price", 4), c("MIN([l_discount])", "min_disc"), c("MAX([l_tax])", "max_tax"), c("COUNT([l_orderkey])", "n"), c("COUNTD([l_suppkey])", "n_supp"), c("SUM([Number of Records])", "n_rows")],
    "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(l_orderkey) AS n, count(DISTINCT l_suppkey) AS n_supp, count(*) AS n_rows FROM lineitem GROUP BY 1",
)
register_request(
    "agg_stats",
    [f("l_linestatus"), c("STDEV([l_quantity])", "sd", 6), c("STDEVP([l_quantity])", "sdp", 6), c("VAR([l_quantity])", "v", 5), c("VARP([l_quantity])", "vp", 5), c("CORR([l_quantity], [l_extendedprice])", "r", 6), c("COVAR([l_quantity], [l_discount])", "cv", 6), c("COVARP([l_quantity], [l_discount])", "cvp", 6)],
    "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cv, round(covar_pop(l_quantity, l_discount), 6) AS cvp FROM lineitem GROUP BY 1",
)
register_request(
    "agg_percentile",
    [f("o_orderstatus"), c("MEDIAN([o_totalprice])", "med", 4), c("PERCENTILE([o_totalprice], 0.9)", "p90", 4)],
    "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1",
)
register_request(
    "agg_if",
    [f("l_returnflag"), c("SUM(IF [l_discount] > 0.05 THEN [l_extendedprice] END)", "disc_sum", 2), c("COUNTD(IF [l_quantity] > 49 THEN [l_suppkey] END)", "n_big"), c("SUM([l_extendedprice] * [l_discount])", "given", 4)],
    "SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 2) AS disc_sum, count(DISTINCT CASE WHEN l_quantity > 49 THEN l_suppkey END) AS n_big, round(sum(l_extendedprice * l_discount), 4) AS given FROM lineitem GROUP BY 1",
)
register_request(
    "agg_bool_attr",
    [f("o_orderpriority"), c("MAX([o_totalprice] > 400000)", "any_big"), c("MIN([o_totalprice] > 1)", "all_pos"), c("ATTR([o_orderpriority])", "one"), c("ATTR([o_orderstatus])", "many")],
    "SELECT o_orderpriority, bool_or(o_totalprice > 400000) AS any_big, bool_and(o_totalprice > 1) AS all_pos, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) ELSE '*' END AS one, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE '*' END AS many FROM orders GROUP BY 1",
)
register_request(
    "agg_concat",
    [f("r_name"), c("GROUP_CONCAT([n_name], '; ')", "nations")],
    "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
register_request(
    "agg_ratio",
    [f("l_shipdate", "YEAR", "y"), c("[Price per Unit]", "unit", 6), c("SUM([l_tax]) / SUM([l_discount])", "ratio", 6), c("SUM([Parameters].[Rate]) * SUM([l_quantity])", "rated", 2)],
    "SELECT year(l_shipdate) AS y, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS unit, round(sum(l_tax) / sum(l_discount), 6) AS ratio, round(0.5 * sum(l_quantity), 2) AS rated FROM lineitem GROUP BY 1",
)
register_request(
    "agg_year_gated",
    [f("o_orderpriority"), c("SUM(IF YEAR([o_orderdate]) = 1998 THEN [o_totalprice] END)", "y1998", 2), c("SUM(IF YEAR([o_orderdate]) = {MAX(YEAR([o_orderdate]))} THEN [o_totalprice] END)", "latest", 2)],
    "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998), 2) AS y1998, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)), 2) AS latest FROM orders GROUP BY 1",
)
register_request(
    "agg_at_last_date",
    [f("o_orderstatus"), c("SUM(IF [o_orderdate] = {FIXED [o_orderstatus] : MAX([o_orderdate])} THEN [o_totalprice] END)", "at_last", 2), c("SUM(IF [o_orderdate] = {FIXED [o_orderstatus] : MIN([o_orderdate])} THEN [o_totalprice] END)", "at_first", 2)],
    "WITH x AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_orderstatus) AS z, min(o_orderdate) OVER (PARTITION BY o_orderstatus) AS a FROM orders) SELECT o_orderstatus, round(sum(CASE WHEN o_orderdate = z THEN o_totalprice END), 2) AS at_last, round(sum(CASE WHEN o_orderdate = a THEN o_totalprice END), 2) AS at_first FROM x GROUP BY 1",
)
register_request(
    "agg_argmax",
    [f("n_name"), f("c_mktsegment"), c("SUM([c_acctbal])", "bal", 2)],
    "WITH g AS (SELECT n_name, c_mktsegment, sum(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY n_name ORDER BY bal DESC) AS k FROM g) SELECT n_name, c_mktsegment, round(bal, 2) AS bal FROM r WHERE k = 1",
    filters=[{"field": {"calculation": "RANK(SUM([c_acctbal]))", "address": ["c_mktsegment"]}, "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "MAX", "max": 1}],
)
register_request(
    "totals_rollup",
    [f("l_returnflag"), f("l_linestatus"), c("SUM([l_quantity])", "q", 2), c("AVG([l_extendedprice])", "p", 4), c("COUNTD([l_suppkey])", "s")],
    'SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, count(DISTINCT l_suppkey) AS s, grouping(l_returnflag, l_linestatus) AS "totalLevel" FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)',
    totals="rollup",
)
register_request(
    "totals_grand",
    [f("o_orderpriority"), c("AVG([o_totalprice])", "p", 4), c("MEDIAN([o_totalprice])", "m", 4)],
    'SELECT o_orderpriority, round(avg(o_totalprice), 4) AS p, round(median(o_totalprice), 4) AS m, grouping(o_orderpriority) AS "totalLevel" FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())',
    totals="grand",
)

# -- levels of detail ------------------------------------------------------------------------

register_request(
    "lod_fixed",
    [f("o_orderkey"), c("SUM([o_totalprice]) / SUM({FIXED [o_custkey] : SUM([o_totalprice])})", "share", 8)],
    "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders",
)
register_request(
    "lod_fixed_dimension",
    [c("{FIXED [o_custkey] : COUNT([o_orderkey])}", "orders_of_customer"), c("COUNTD([o_custkey])", "customers")],
    "WITH g AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT k AS orders_of_customer, count(*) AS customers FROM g GROUP BY 1",
)
register_request(
    "lod_fixed_reagg",
    [f("c_mktsegment"), c("AVG({FIXED [o_custkey] : SUM([o_totalprice])})", "avg_customer", 4)],
    "WITH g AS (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_mktsegment, round(avg(t), 4) AS avg_customer FROM g GROUP BY 1",
)
register_request(
    "lod_fixed_before_filter",
    [f("o_orderstatus"), c("SUM([o_totalprice])", "s", 2), c("MAX({FIXED [o_orderstatus] : SUM([o_totalprice])})", "before", 2)],
    "SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 2) AS s, round(sum(o_totalprice), 2) AS before FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderpriority = '5-LOW') > 0",
    filters=[{"field": f("o_orderpriority"), "filterType": "SET", "values": ["5-LOW"]}],
)
register_request(
    "lod_context_filter",
    [f("o_orderstatus"), c("SUM([o_totalprice])", "s", 2), c("MAX({FIXED [o_orderstatus] : SUM([o_totalprice])})", "after", 2)],
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, round(sum(o_totalprice), 2) AS after FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1",
    filters=[{"field": f("o_orderpriority"), "filterType": "SET", "values": ["5-LOW"], "context": True}],
)
register_request(
    "lod_view_context",
    [f("c_mktsegment"), c("AVG({FIXED [o_custkey] : SUM([o_totalprice])})", "a", 4)],
    "WITH g AS (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT c_mktsegment, round(avg(t), 4) AS a FROM g GROUP BY 1",
    filters=[{"field": f("o_orderstatus"), "filterType": "SET", "values": ["F"]}], lodMode="view_context",
)
register_request(
    "lod_table",
    [f("o_orderpriority"), c("SUM([o_totalprice]) / {SUM([o_totalprice])}", "share", 8), c("SUM({MAX([o_totalprice])})", "top", 2)],
    "SELECT o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 8) AS share, round((SELECT max(o_totalprice) FROM orders), 2) AS top FROM orders GROUP BY 1",
)
register_request(
    "lod_include",
    [f("o_orderpriority"), c("AVG({INCLUDE [o_custkey] : SUM([o_totalprice])})", "a", 4)],
    "WITH g AS (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(avg(t), 4) AS a FROM g GROUP BY 1",
)
register_request(
    "lod_exclude",
    [f("l_returnflag"), f("l_linestatus"), c("SUM([l_quantity])", "q", 2), c("SUM([l_quantity]) / {EXCLUDE [l_linestatus] : SUM([l_quantity])}", "share", 8)],
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 8) AS share FROM lineitem GROUP BY 1, 2",
)
register_request(
    "lod_nested",
    [f("c_mktsegment"), c("MAX({FIXED [c_mktsegment] : AVG({FIXED [c_mktsegment], [o_custkey] : SUM([o_totalprice])})})", "a", 3)],
    "WITH g AS (SELECT c_mktsegment, o_custkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY c_mktsegment, o_custkey) AS t FROM orders JOIN customer ON o_custkey = c_custkey) SELECT c_mktsegment, round(avg(t), 3) AS a FROM g GROUP BY 1",
)
register_request(
    "lod_cross_table",
    [f("o_orderpriority"), c("MAX({FIXED [r_name] : SUM([o_totalprice])})", "m", 2)],
    "WITH x AS (SELECT o_orderpriority, sum(o_totalprice) OVER (PARTITION BY r_name) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT o_orderpriority, round(max(t), 2) AS m FROM x GROUP BY 1",
)
register_request(
    "lod_stats_over",
    [f("o_orderpriority"), c("STDEV({INCLUDE [o_custkey] : SUM([o_totalprice])})", "sd", 4), c("COUNTD({INCLUDE [o_custkey] : COUNT([o_orderkey])})", "kinds")],
    "WITH g AS (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(stddev_samp(t), 4) AS sd, count(DISTINCT n) AS kinds FROM g GROUP BY 1",
)

# -- table calculations ------------------------------------------------------------------------

_MONTHS = "WITH m AS (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mon, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) "
_MONTH = c("STR(DATE(DATETRUNC('month', [o_orderdate])))", "mon")
register_request(
    "win_running",
    [_MONTH, c("RUNNING_SUM(SUM([o_totalprice]))", "rs", 2), c("RUNNING_AVG(SUM([o_totalprice]))", "ra", 2), c("RUNNING_MIN(SUM([o_totalprice]))", "rmin", 2), c("RUNNING_MAX(SUM([o_totalprice]))", "rmax", 2), c("RUNNING_COUNT(SUM([o_totalprice]))", "rc")],
    _MONTHS + "SELECT mon, round(sum(s) OVER w, 2) AS rs, round(avg(s) OVER w, 2) AS ra, round(min(s) OVER w, 2) AS rmin, round(max(s) OVER w, 2) AS rmax, count(s) OVER w AS rc FROM m WINDOW w AS (ORDER BY mon ROWS UNBOUNDED PRECEDING)",
)
register_request(
    "win_index",
    [_MONTH, c("INDEX()", "i"), c("SIZE()", "k"), c("FIRST()", "a"), c("LAST()", "z")],
    _MONTHS + "SELECT mon, row_number() OVER (ORDER BY mon) AS i, count(*) OVER () AS k, 1 - row_number() OVER (ORDER BY mon) AS a, count(*) OVER () - row_number() OVER (ORDER BY mon) AS z FROM m",
)
register_request(
    "win_whole",
    [_MONTH, c("WINDOW_SUM(SUM([o_totalprice]))", "s", 2), c("WINDOW_AVG(SUM([o_totalprice]))", "a", 2), c("WINDOW_MEDIAN(SUM([o_totalprice]))", "m", 4), c("WINDOW_STDEV(SUM([o_totalprice]))", "sd", 2), c("WINDOW_VARP(COUNT([o_orderkey]))", "vp", 4), c("WINDOW_PERCENTILE(SUM([o_totalprice]), 0.25)", "p25", 4), c("WINDOW_COUNT(COUNTD([o_custkey]))", "marks"), c("WINDOW_CORR(SUM([o_totalprice]), COUNT([o_orderkey]))", "r", 6)],
    _MONTHS + "SELECT mon, round(sum(s) OVER (), 2) AS s, round(avg(s) OVER (), 2) AS a, round(median(s) OVER (), 4) AS m, round(stddev_samp(s) OVER (), 2) AS sd, round(var_pop(n) OVER (), 4) AS vp, round(quantile_cont(s, 0.25) OVER (), 4) AS p25, count(*) OVER () AS marks, round(corr(s, n) OVER (), 6) AS r FROM m",
)
register_request(
    "win_moving",
    [_MONTH, c("WINDOW_AVG(SUM([o_totalprice]), -2, 0)", "ma", 2), c("WINDOW_SUM(SUM([o_totalprice]), -1, 1)", "ms", 2), c("WINDOW_COUNT(SUM([o_totalprice]), 0, 2)", "mc"), c("WINDOW_MEDIAN(SUM([o_totalprice]), -2, 2)", "mm", 4)],
    _MONTHS + "SELECT mon, round(avg(s) OVER (ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma, round(sum(s) OVER (ORDER BY mon ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS ms, count(s) OVER (ORDER BY mon ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS mc, round(median(s) OVER (ORDER BY mon ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS mm FROM m",
)
register_request(
    "win_anchored",
    [_MONTH, c("WINDOW_SUM(SUM([o_totalprice]), FIRST()+1, 0)", "s1", 2), c("WINDOW_MAX(SUM([o_totalprice]), FIRST(), 0)", "m0", 2), c("WINDOW_SUM(SUM([o_totalprice]), 0, LAST()-1)", "s2", 2), c("WINDOW_MIN(SUM([o_totalprice]), FIRST()+2, LAST()-2)", "m2", 2)],
    "WITH m AS (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mon, sum(o_totalprice) AS s FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY mon) AS i, count(*) OVER () AS k FROM m) SELECT mon, round(sum(CASE WHEN i >= 2 THEN s END) OVER (ORDER BY mon ROWS UNBOUNDED PRECEDING), 2) AS s1, round(max(s) OVER (ORDER BY mon ROWS UNBOUNDED PRECEDING), 2) AS m0, round(sum(CASE WHEN i <= k - 1 THEN s END) OVER (ORDER BY mon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS s2, round(min(CASE WHEN i BETWEEN 3 AND k - 2 THEN s END) OVER (), 2) AS m2 FROM n",
)
register_request(
    "win_lookup",
    [_MONTH, c("LOOKUP(SUM([o_totalprice]), -1)", "before", 2), c("LOOKUP(SUM([o_totalprice]), 2)", "ahead", 2), c("SUM([o_totalprice]) - LOOKUP(SUM([o_totalprice]), -1)", "diff", 2), c("(SUM([o_totalprice]) - LOOKUP(SUM([o_totalprice]), -1)) / ABS(LOOKUP(SUM([o_totalprice]), -1))", "pct", 6)],
    _MONTHS + "SELECT mon, round(lag(s) OVER (ORDER BY mon), 2) AS before, round(lead(s, 2) OVER (ORDER BY mon), 2) AS ahead, round(s - lag(s) OVER (ORDER BY mon), 2) AS diff, round((s - lag(s) OVER (ORDER BY mon)) / abs(lag(s) OVER (ORDER BY mon)), 6) AS pct FROM m",
)
register_request(
    "win_rank_family",
    [f("n_name"), f("c_mktsegment"), c("COUNT([c_custkey])", "k"), c("RANK(COUNT([c_custkey]))", "r", address=["c_mktsegment"]), c("RANK_DENSE(COUNT([c_custkey]), 'asc')", "d", address=["c_mktsegment"]), c("RANK_MODIFIED(COUNT([c_custkey]))", "m", address=["c_mktsegment"]), c("RANK_UNIQUE(COUNT([c_custkey]))", "u", address=["c_mktsegment"]), c("RANK_PERCENTILE(COUNT([c_custkey]))", "p", 8, address=["c_mktsegment"])],
    "WITH g AS (SELECT n_name, c_mktsegment, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_name, c_mktsegment, k, rank() OVER (PARTITION BY n_name ORDER BY k DESC) AS r, dense_rank() OVER (PARTITION BY n_name ORDER BY k) AS d, count(*) OVER (PARTITION BY n_name ORDER BY k DESC RANGE UNBOUNDED PRECEDING) AS m, row_number() OVER (PARTITION BY n_name ORDER BY k DESC, c_mktsegment) AS u, round(CASE WHEN count(*) OVER (PARTITION BY n_name) > 1 THEN (count(*) OVER (PARTITION BY n_name ORDER BY k RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER (PARTITION BY n_name) - 1) ELSE 0 END, 8) AS p FROM g",
)
register_request(
    "win_total",
    [f("l_returnflag"), f("l_linestatus"), c("AVG([l_extendedprice]) / TOTAL(AVG([l_extendedprice]))", "t", 8, address=["l_linestatus"]), c("COUNTD([l_suppkey]) / TOTAL(COUNTD([l_suppkey]))", "d", 8, address=["l_returnflag", "l_linestatus"])],
    "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice) / (SELECT avg(b.l_extendedprice) FROM lineitem b WHERE b.l_returnflag = a.l_returnflag), 8) AS t, round(count(DISTINCT l_suppkey) / (SELECT count(DISTINCT l_suppkey) FROM lineitem), 8) AS d FROM lineitem a GROUP BY 1, 2",
)
register_request(
    "win_addressing",
    [f("o_orderdate", "YEAR", "y"), f("o_orderpriority"), c("RUNNING_SUM(COUNT([o_orderkey]))", "down", address=["y"]), c("RUNNING_SUM(COUNT([o_orderkey]))", "across", address=[["o_orderpriority", "DESC"]])],
    "WITH g AS (SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS k FROM orders GROUP BY 1, 2) SELECT y, o_orderpriority, sum(k) OVER (PARTITION BY o_orderpriority ORDER BY y ROWS UNBOUNDED PRECEDING) AS down, sum(k) OVER (PARTITION BY y ORDER BY o_orderpriority DESC ROWS UNBOUNDED PRECEDING) AS across FROM g",
)
register_request(
    "win_nested",
    [_MONTH, c("RANK(RUNNING_SUM(SUM([o_totalprice])))", "r"), c("WINDOW_MAX(RUNNING_SUM(COUNT([o_orderkey])))", "top")],
    _MONTHS + ", x AS (SELECT mon, sum(s) OVER (ORDER BY mon ROWS UNBOUNDED PRECEDING) AS rs, sum(n) OVER (ORDER BY mon ROWS UNBOUNDED PRECEDING) AS rn FROM m) SELECT mon, rank() OVER (ORDER BY rs DESC) AS r, max(rn) OVER () AS top FROM x",
)
register_request(
    "win_hide_marks",
    [f("o_orderdate", "YEAR", "y"), c("SUM([o_totalprice])", "s", 2), c("RUNNING_SUM(SUM([o_totalprice]))", "rs", 2)],
    "WITH g AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1), x AS (SELECT *, sum(s) OVER (ORDER BY y ROWS UNBOUNDED PRECEDING) AS rs, avg(s) OVER () AS a FROM g) SELECT y, round(s, 2) AS s, round(rs, 2) AS rs FROM x WHERE s > a",
    filters=[{"field": {"calculation": "SUM([o_totalprice]) > WINDOW_AVG(SUM([o_totalprice]))"}, "filterType": "CALC"}],
)
_YEARS = "WITH g AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1) "
register_request(
    "win_quick",
    [f("o_orderdate", "YEAR", "y"), *[c("SUM([o_totalprice])", n, 6, quickCalc=q) for n, q in (("pt", "PERCENT_OF_TOTAL"), ("pd", "PERCENT_DIFFERENCE"), ("cagr", "COMPOUND_GROWTH"), ("rk", "RANK"), ("pc", "PERCENTILE"))], c("SUM([o_totalprice])", "ma", 4, quickCalc={"family": "MOVING_AVERAGE", "window": 2}), c("SUM([o_totalprice])", "df", 2, quickCalc="DIFFERENCE"), c("SUM([o_totalprice])", "rt", 2, quickCalc="RUNNING_TOTAL")],
    _YEARS + "SELECT y, round(s / sum(s) OVER (), 6) AS pt, round((s - lag(s) OVER w) / lag(s) OVER w, 6) AS pd, round(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE pow(s / first_value(s) OVER w, 1.0 / (row_number() OVER w - 1)) - 1 END, 6) AS cagr, rank() OVER (ORDER BY s DESC) AS rk, round((dense_rank() OVER (ORDER BY s) - 1) / (dense_rank() OVER (ORDER BY s) + dense_rank() OVER (ORDER BY s DESC) - 2), 6) AS pc, round(avg(s) OVER (ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS ma, round(s - lag(s) OVER w, 2) AS df, round(sum(s) OVER (ORDER BY y ROWS UNBOUNDED PRECEDING), 2) AS rt FROM g WINDOW w AS (ORDER BY y)",
)
register_request(
    "win_yoy_ytd",
    [f("o_orderdate", "YEAR", "y"), f("o_orderdate", "QUARTER", "q"), c("SUM([o_totalprice])", "yoy", 6, address=["y", "q"], quickCalc={"family": "YEAR_OVER_YEAR", "periods": 4}), c("SUM([o_totalprice])", "ytd", 2, address=["q"], partition=["y"], quickCalc="RUNNING_TOTAL")],
    "WITH g AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) SELECT y, q, round((s - lag(s, 4) OVER (ORDER BY y, q)) / lag(s, 4) OVER (ORDER BY y, q), 6) AS yoy, round(sum(s) OVER (PARTITION BY y ORDER BY q ROWS UNBOUNDED PRECEDING), 2) AS ytd FROM g",
)

# -- filters -----------------------------------------------------------------------------------

_PART = [f("p_brand"), c("COUNT([p_partkey])", "n")]


def _part_filter(name: str, where: str, *filters: dict) -> None:
    register_request(name, _PART, f"SELECT p_brand, count(p_partkey) AS n FROM part WHERE {where} GROUP BY 1", filters=list(filters))


_part_filter("flt_set", "p_size IN (1, 2, 3)", {"field": f("p_size"), "filterType": "SET", "values": [1, 2, 3]})
_part_filter("flt_set_exclude", "p_size NOT IN (1, 2, 3)", {"field": f("p_size"), "filterType": "SET", "values": [1, 2, 3], "exclude": True})
_part_filter("flt_match", "contains(p_type, 'A') AND starts_with(p_name, 'p')", {"field": f("p_type"), "filterType": "MATCH", "contains": "A"}, {"field": f("p_name"), "filterType": "MATCH", "startsWith": "p"})
_part_filter("flt_match_exclude", "NOT suffix(p_brand, '1')", {"field": f("p_brand"), "filterType": "MATCH", "endsWith": "1", "exclude": True})
_part_filter("flt_range", "p_retailprice BETWEEN 1000 AND 1500", {"field": f("p_retailprice"), "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "RANGE", "min": 1000, "max": 1500})
_part_filter("flt_min_max", "p_retailprice >= 1200 AND p_size <= 20", {"field": f("p_retailprice"), "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "MIN", "min": 1200}, {"field": f("p_size"), "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "MAX", "max": 20})
_part_filter("flt_nulls", "p_size IS NOT NULL", {"field": f("p_size"), "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "ONLY_NON_NULL"})
_part_filter("flt_formula", "p_size IN (5, 6) OR (p_brand >= 'B' AND NOT p_retailprice < 1300)", {"field": {"calculation": "[p_size] IN (5, 6) OR ([p_brand] >= 'B' AND NOT [p_retailprice] < 1300)"}, "filterType": "CALC"})
_ORD = [f("o_orderpriority"), c("COUNT([o_orderkey])", "n")]


def _order_filter(name: str, where: str, *filters: dict) -> None:
    register_request(name, _ORD, f"SELECT o_orderpriority, count(o_orderkey) AS n FROM orders WHERE {where} GROUP BY 1", filters=list(filters))


def _relative(period: str, kind: str, n: int = 1) -> dict:
    return {"field": f("o_orderdate"), "filterType": "DATE", "periodType": period, "dateRangeType": kind, "rangeN": n, "anchorDate": "1998-06-15"}


_order_filter("flt_date_range", "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-03-02'", {"field": f("o_orderdate"), "filterType": "QUANTITATIVE_DATE", "quantitativeFilterType": "RANGE", "minDate": "1996-01-01", "maxDate": "1997-03-01"})
_order_filter("flt_date_last_n", "o_orderdate >= DATE '1998-04-01' AND o_orderdate < DATE '1998-07-01'", _relative("MONTHS", "LASTN", 3))
_order_filter("flt_date_current", "year(o_orderdate) = 1998 AND quarter(o_orderdate) = 2", _relative("QUARTERS", "CURRENT"))
_order_filter("flt_date_last_next", "(o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01')", _relative("YEARS", "LAST"))
_order_filter("flt_date_to_date", "o_orderdate >= DATE '1998-01-01' AND o_orderdate <= DATE '1998-06-15'", _relative("YEARS", "TODATE"))
_order_filter("flt_date_week", "o_orderdate >= DATE '1998-06-14' AND o_orderdate < DATE '1998-06-28'", _relative("WEEKS", "NEXTN", 2))
register_request(
    "flt_topn",
    [f("o_orderstatus"), c("SUM([o_totalprice])", "s", 2)],
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10) GROUP BY 1",
    filters=[{"filterType": "TOP", "field": f("o_custkey"), "howMany": 10, "direction": "TOP", "fieldToMeasure": f("o_totalprice", "SUM")}],
)
register_request(
    "flt_having",
    [f("o_custkey"), c("SUM([o_totalprice])", "s", 2)],
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000 AND count(*) > 5",
    filters=[{"field": f("o_totalprice", "SUM"), "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "MIN", "min": 1000000.01}, {"field": {"calculation": "COUNT([o_orderkey]) > 5"}, "filterType": "CALC"}],
)


@query("flt_parameter_all", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def flt_parameter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.table(spark, sf_dir, "customer")
    parts = []
    for value in ("All", "BUILDING"):
        p = flt.parameter_equals(F.col("c_mktsegment"), value)
        parts.append((df if p is None else df.where(p)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
    return relationships.union_sources(parts)


@query("flt_date_band", "WITH a AS (SELECT max(o_orderdate) AS z FROM orders) SELECT CASE WHEN o_orderdate > z - INTERVAL 30 DAY THEN 'last 30' WHEN o_orderdate > z - INTERVAL 90 DAY THEN 'last 90' ELSE 'older' END AS band, count(*) AS n FROM orders, a GROUP BY 1")
def flt_date_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [c("IF [o_orderdate] > DATEADD('day', -30, {MAX([o_orderdate])}) THEN 'last 30' ELSEIF [o_orderdate] > DATEADD('day', -90, {MAX([o_orderdate])}) THEN 'last 90' ELSE 'older' END", "band"), c("COUNT([o_orderkey])", "n")]
    return ask(spark, sf_dir, fields)


@query("flt_row_security", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1")
def flt_row_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = star_model(spark, sf_dir).secure("customer", "[c_mktsegment] = USERNAME()")
    return run_request(m, {"fields": [f("c_nationkey"), c("COUNT([c_custkey])", "n")], "user": "MACHINERY"})


# -- joins, relations, sources -------------------------------------------------------------------

register_request(
    "join_star",
    [f("r_name"), f("p_brand"), c("[Revenue]", "rev", 4), c("COUNTD([s_nationkey])", "nations")],
    f"SELECT r_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev, count(DISTINCT s_nationkey) AS nations FROM {STAR} JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
)
register_request(
    "flagship_top_nations",
    [f("n_name"), c("[Revenue]", "rev", 4, sortDirection="DESC", sortPriority=1), c("[Price per Unit]", "unit", 4), c("RANK(SUM([l_quantity]))", "by_quantity")],
    f"WITH g AS (SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_quantity) AS q FROM {STAR} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY 1) SELECT n_name, round(rev, 4) AS rev, round(rev / q, 4) AS unit, rank() OVER (ORDER BY q DESC) AS by_quantity FROM g ORDER BY rev DESC LIMIT 10",
    filters=[{"field": f("l_shipdate"), "filterType": "QUANTITATIVE_DATE", "quantitativeFilterType": "RANGE", "minDate": "1996-01-01", "maxDate": "1998-12-31"}], limit=10,
)


@query("join_path_countd", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))")
def join_path_countd(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    return relationships.count_distinct_where_related(t("lineitem"), "l_partkey", [(t("orders"), "l_orderkey", "o_orderkey"), (t("customer"), "o_custkey", "c_custkey")], F.col("c_acctbal") > 5000)


@query("join_cardinality", "SELECT 'orders' AS t, 'o_orderkey' AS k, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'many_to_one' ELSE 'many_to_many' END AS cardinality FROM orders UNION ALL SELECT 'orders', 'o_custkey', CASE WHEN count(*) = count(DISTINCT o_custkey) THEN 'many_to_one' ELSE 'many_to_many' END FROM orders UNION ALL SELECT 'nation', 'n_nationkey', CASE WHEN count(*) = count(DISTINCT n_nationkey) THEN 'many_to_one' ELSE 'many_to_many' END FROM nation")
def join_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, k, relationships.cardinality(readers.table(spark, sf_dir, t), t, k)[0]) for t, k in (("orders", "o_orderkey"), ("orders", "o_custkey"), ("nation", "n_nationkey"))]
    return spark.createDataFrame(rows, "t string, k string, cardinality string")


@query("join_blend", "WITH s AS (SELECT s_nationkey, count(*) AS suppliers, round(avg(s_acctbal), 4) AS bal FROM supplier GROUP BY 1) SELECT n_name, suppliers, bal FROM nation LEFT JOIN s ON n_nationkey = s_nationkey")
def join_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    out = relationships.blend(t("nation"), t("supplier"), [("n_nationkey", "s_nationkey")], {"suppliers": F.count(F.lit(1)), "bal": F.round(F.avg("s_acctbal"), 4)})
    return out.select("n_name", "suppliers", "bal")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "customer").join(readers.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_theta", "SELECT r_name, count(*) AS n FROM region, part WHERE p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 4 GROUP BY 1")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.broadcast(readers.table(spark, sf_dir, "region"))  # the regions are five
    p = readers.table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("k"))
    return p.join(r, F.col("p_size").between(F.col("r_regionkey") * 10, F.col("r_regionkey") * 10 + 4)).groupBy("r_name").agg(F.sum("k").alias("n"))


@query("join_role_dates", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS o, CAST(l_shipdate AS DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey), o AS (SELECT year(o) AS y, count(*) AS ordered FROM d GROUP BY 1), s AS (SELECT year(s) AS y, count(*) AS shipped FROM d GROUP BY 1) SELECT o.y AS \"Year\", ordered, shipped FROM o JOIN s USING (y)")
def join_role_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.table(spark, sf_dir, "lineitem").join(readers.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = cal.calendar([(lines, "o_orderdate"), (lines, "l_shipdate")])
    role = lambda c, n: lines.groupBy(F.to_date(c).alias("Date")).agg(F.count(F.lit(1)).alias("k")).join(days, "Date").groupBy("Year").agg(F.sum("k").alias(n))
    return role("o_orderdate", "ordered").join(role("l_shipdate", "shipped"), "Year")


@query("src_custom_sql", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 100000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def src_custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT o_orderstatus, o_orderpriority FROM orders_src WHERE o_totalprice << 100000 AND o_orderpriority = <[Parameters].[P]>"
    sql, lifted, _ = readers.lift_parameters(sql, ["o_orderstatus", "o_orderpriority"])
    df = readers.custom_sql(spark, sql, {"orders_src": readers.table(spark, sf_dir, "orders")})
    for column, _ in lifted:
        df = df.where(F.col(column) == F.lit("1-URGENT"))
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src_union", "SELECT c_name AS name, c_acctbal AS bal, NULL AS nation FROM customer UNION ALL SELECT s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier")
def src_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = readers.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = readers.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return relationships.union_sources([a, b])


@query("src_wildcard", "SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation)")
def src_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.wildcard_union(spark, sf_dir, "nation*.parquet").agg(F.count(F.lit(1)).alias("n"))


@query("src_decimal_text", "SELECT p_brand, round(sum(p_retailprice), 2) AS s FROM part GROUP BY 1")
def src_decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = readers.table(spark, sf_dir, "part").select("p_brand", F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")).alias("price"))
    said = readers.decimal_convention(part, ["price"])
    return part.groupBy("p_brand").agg(F.round(F.sum(readers.parse_number(F.col("price"), said)), 2).alias("s"))


@query(
    "calendar_dim",
    "WITH b AS (SELECT date_trunc('year', min(o_orderdate)) AS a, date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS z FROM orders), d AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM b) "
    'SELECT CAST(d AS VARCHAR) AS "Date", year(d) AS "Year", quarter(d) AS "Quarter", month(d) AS "Month", monthname(d) AS "MonthName", CAST(CAST(date_trunc(\'quarter\', d) AS DATE) AS VARCHAR) AS "QuarterStart", CAST(d - CAST(dayofweek(d) AS INTEGER) AS VARCHAR) AS "WeekStart", (dayofyear(d) - 1 + dayofweek(date_trunc(\'year\', d))) // 7 + 1 AS "WeekOfYear", (day(d) - 1 + dayofweek(date_trunc(\'month\', d))) // 7 + 1 AS "WeekOfMonth", dayofweek(d) + 1 AS "WeekdayNo", dayname(d) AS "DayName", isoyear(d) AS "IsoYear", weekofyear(d) AS "IsoWeek" FROM d',
)
def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = cal.calendar([(readers.table(spark, sf_dir, "orders"), "o_orderdate")])
    text = [F.col(x).cast("string").alias(x) for x in ("Date", "QuarterStart", "WeekStart")]
    return days.select(*text, "Year", "Quarter", "Month", "MonthName", "WeekOfYear", "WeekOfMonth", "WeekdayNo", "DayName", "IsoYear", "IsoWeek")


@query("par_range", "SELECT CAST(v AS DOUBLE) AS value FROM (SELECT unnest([0, 2.5, 5, 7.5, 10, 6]) AS v)")
def par_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_model(spark, sf_dir).parameter("P", 6.0, low=0.0, high=10.0, step=2.5).parameters["P"].domain(spark).select("value")


@query("par_field_swap", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS shown FROM lineitem GROUP BY 1")
def par_field_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.swaps import swap_field

    m = star_model(spark, sf_dir)
    chosen = swap_field(m, "CASE [Parameters].[Show] WHEN 'quantity' THEN [l_quantity] WHEN 'price' THEN [l_extendedprice] END", {"Show": "price"})
    return run_request(m, {"fields": [f("l_returnflag"), f(chosen, "SUM", "shown", maxDecimalPlaces=2)]})


# -- groups, bins, hierarchies, order ------------------------------------------------------------

register_request("grp_categorical", [f("Priority Group", None, "g"), c("COUNT([o_orderkey])", "n")], "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE o_orderpriority END AS g, count(*) AS n FROM orders GROUP BY 1")
register_request("grp_null_tail", [f("Flag Group", None, "g"), c("COUNT([l_orderkey])", "n")], "SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' END AS g, count(*) AS n FROM lineitem GROUP BY 1")
register_request("bin_numeric", [f("Quantity Bin", None, "b"), c("COUNT([l_orderkey])", "n")], "SELECT floor(l_quantity / 10) * 10 AS b, count(*) AS n FROM lineitem GROUP BY 1")
register_request("bin_request", [f("p_retailprice", None, "b", binSize=100), c("COUNT([p_partkey])", "n")], "SELECT floor(p_retailprice / 100) * 100 AS b, count(*) AS n FROM part GROUP BY 1")
register_request("ord_sort_limit", [f("c_name"), c("SUM([c_acctbal])", "bal", 2, sortDirection="DESC", sortPriority=1), f("c_mktsegment")], "SELECT c_name, round(sum(c_acctbal), 2) AS bal, c_mktsegment FROM customer GROUP BY 1, 3 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 25", limit=25)
register_request("ord_distinct", [f("o_orderstatus"), f("o_orderpriority")], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
register_request("date_truncs", [f("o_orderdate", "TRUNC_QUARTER", "q"), c("COUNT([o_orderkey])", "n")], "SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, count(*) AS n FROM orders GROUP BY 1")


@query("hier_drill", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hier_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = star_model(spark, sf_dir)
    return run_request(m, {"fields": [*[f(x) for x in m.hierarchies["Ship"][:2]], c("COUNT([l_orderkey])", "n")]})


@query("set_algebra", "SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'suppliers only', count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = readers.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = readers.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "customers only")).unionByName(count(b.subtract(a), "suppliers only"))


@query("set_in_out", "SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS in_set, count(*) AS n FROM customer GROUP BY 1")
def set_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = readers.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), F.lit(True).alias("hit")).distinct()
    df = readers.table(spark, sf_dir, "customer").join(members, F.col("c_custkey") == F.col("k"), "left")
    return df.groupBy(F.coalesce("hit", F.lit(False)).alias("in_set")).agg(F.count(F.lit(1)).alias("n"))


# -- scalar functions ------------------------------------------------------------------------------

register_request(
    "fn_math",
    [f("p_partkey"), c("ROUND(SQRT([p_retailprice]), 4)", "sq"), c("MOD([p_size] - 25, 7)", "md"), c("([p_size] - 25) % -7", "mn"), c("DIV([p_size], 4)", "dv"), c("[p_size] / ([p_size] - [p_size])", "zero"), c("ROUND(LOG([p_retailprice]), 6)", "lg"), c("ROUND(LOG([p_retailprice], 2), 6)", "l2"), c("2 ^ 3 ^ 2 + -2 ^ 2", "pw"), c("CEILING([p_retailprice])", "ce"), c("FLOOR([p_retailprice])", "fl"), c("INT(-[p_retailprice])", "it"), c("SIGN([p_size] - 20)", "sg"), c("SQUARE([p_size])", "s2"), c("ROUND(ATAN2([p_size], 3), 6)", "at"), c("ROUND(DEGREES(PI()), 2)", "dg")],
    "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS sq, (p_size - 25) - 7 * floor((p_size - 25) / 7) AS md, (p_size - 25) + 7 * floor((p_size - 25) / -7) AS mn, trunc(p_size / 4) AS dv, CAST(NULL AS DOUBLE) AS zero, round(log10(p_retailprice), 6) AS lg, round(log2(p_retailprice), 6) AS l2, 516.0 AS pw, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, trunc(-p_retailprice) AS it, CAST(sign(p_size - 20) AS DOUBLE) AS sg, p_size * p_size AS s2, round(atan2(p_size, 3), 6) AS at, 180.0 AS dg FROM part",
)
register_request(
    "fn_text",
    [f("p_partkey"), c("UPPER([p_name])", "up"), c("LEN([p_name])", "ln"), c("LEFT([p_name], 3)", "lf"), c("RIGHT([p_name], 2)", "rt"), c("MID([p_name], 2, 3)", "md"), c("REPLACE([p_brand], 'B', 'x')", "rp"), c("CONTAINS([p_type], 'A')", "ct"), c("FIND([p_name], 'a')", "fd"), c("[p_brand] + '-' + [p_type]", "jn"), c("SPLIT([p_brand], '#', 2)", "sp"), c("ASCII([p_name])", "asc"), c("TRIM('  x ')", "tr"), c("REGEXP_REPLACE([p_brand], '[0-9]', '')", "rx"), c("STR([p_size])", "st"), c("CHAR(300)", "ch"), c("PROPER('o''brien st')", "pr")],
    "SELECT p_partkey, upper(p_name) AS up, length(p_name) AS ln, left(p_name, 3) AS lf, right(p_name, 2) AS rt, substring(p_name, 2, 3) AS md, replace(p_brand, 'B', 'x') AS rp, contains(p_type, 'A') AS ct, strpos(p_name, 'a') AS fd, p_brand || '-' || p_type AS jn, split_part(p_brand, '#', 2) AS sp, ascii(p_name) AS asc, 'x' AS tr, regexp_replace(p_brand, '[0-9]', '', 'g') AS rx, CAST(p_size AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS ch, 'O''Brien St' AS pr FROM part",
)
register_request(
    "fn_date",
    [f("o_orderkey"), c("YEAR([o_orderdate])", "y"), c("WEEK([o_orderdate])", "w"), c("ISOWEEK([o_orderdate])", "iw"), c("ISOYEAR([o_orderdate])", "iy"), c("ISOWEEKDAY([o_orderdate])", "id"), c("DATEPART('weekday', [o_orderdate])", "wd"), c("DATENAME('month', [o_orderdate])", "mn"), c("STR(DATE(DATETRUNC('week', [o_orderdate])))", "tw"), c("STR(DATE(DATEADD('month', 1, [o_orderdate])))", "am"), c("DATEDIFF('month', #1995-01-31#, [o_orderdate])", "dm"), c("DATEDIFF('week', #1995-01-01#, [o_orderdate])", "dw"), c("DATE([o_orderdate]) - #1995-01-01#", "dd"), c("STR(MAKEDATE(2024, 2, 30))", "bad"), c("DATEDIFF('year', [o_orderdate], TODAY())", "age")],
    "SELECT o_orderkey, year(o_orderdate) AS y, (dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 + 1 AS w, weekofyear(o_orderdate) AS iw, isoyear(o_orderdate) AS iy, isodow(o_orderdate) AS id, dayofweek(o_orderdate) + 1 AS wd, monthname(o_orderdate) AS mn, CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS VARCHAR) AS tw, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS am, datediff('month', DATE '1995-01-31', CAST(o_orderdate AS DATE)) AS dm, (CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) - DATE '1995-01-01') // 7 AS dw, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS dd, CAST(NULL AS VARCHAR) AS bad, 2001 - year(o_orderdate) AS age FROM orders",
)
register_request(
    "fn_logic",
    [f("p_partkey"), c("IF [p_size] > 40 THEN 'big' ELSEIF [p_size] > 20 THEN 'mid' END", "i"), c("IIF([p_size] > 25, 1, 0)", "ii"), c("IIF(NULL = 1, 'a', 'b', 'c')", "i4"), c("CASE [p_brand] WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END", "cs"), c("CASE WHEN [p_size] IN (1, 2) THEN TRUE ELSE FALSE END", "cw"), c("ZN(NULL)", "zn"), c("IFNULL([p_name], 'none')", "nn"), c("ISNULL([p_size])", "isn"), c("NOT ([p_size] = 1) AND [p_retailprice] <> 1000", "bl")],
    "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' END AS i, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS ii, 'c' AS i4, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS cs, p_size IN (1, 2) AS cw, 0 AS zn, coalesce(p_name, 'none') AS nn, p_size IS NULL AS isn, NOT (p_size = 1) AND p_retailprice <> 1000 AS bl FROM part",
)

# -- profiling, reconciliation, comparison -----------------------------------------------------------


@query(
    "profile_stats",
    " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(*) AS rows, count({x}) AS non_null, count(*) - count({x}) AS null_count, round(1 - count({x}) / count(*), 4) AS null_rate, count(DISTINCT {x}) AS cardinality, CAST(min({x}) AS VARCHAR) AS min, CAST(max({x}) AS VARCHAR) AS max, {a} AS avg FROM customer"
        for x, a in (("c_custkey", "round(avg(c_custkey), 4)"), ("c_name", "CAST(NULL AS DOUBLE)"), ("c_nationkey", "round(avg(c_nationkey), 4)"), ("c_acctbal", "round(avg(c_acctbal), 4)"), ("c_mktsegment", "CAST(NULL AS DOUBLE)"))
    ),
)
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(readers.table(spark, sf_dir, "customer")).drop("type").withColumn("avg", F.round("avg", 4))


@query("profile_schema")
def profile_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.schema_profile(star_model(spark, sf_dir))


@query("reconcile_pass", "SELECT * FROM (VALUES ('(all)', 1, 0, 'pass'), ('l_returnflag', 3, 0, 'pass'), ('l_linestatus', 2, 0, 'pass')) t(grouping, groups, mismatches, state)")
def reconcile_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(star_model(spark, sf_dir), "SUM([l_extendedprice]) - SUM([l_extendedprice] * [l_discount])", "[Revenue]", ["l_returnflag", "l_linestatus"], 1e-9)


@query("reconcile_fail", "SELECT * FROM (VALUES ('(all)', 1, 1, 'fail'), ('l_returnflag', 3, 3, 'fail')) t(grouping, groups, mismatches, state)")
def reconcile_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(star_model(spark, sf_dir), "SUM([l_extendedprice])", "[Revenue]", ["l_returnflag"])


@query("reconcile_coverage", "SELECT 'translated' AS status, 3 AS n")
def reconcile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.coverage(star_model(spark, sf_dir))


@query(
    "verify_overlap",
    "WITH a AS (SELECT * FROM orders WHERE o_orderdate < DATE '1999-01-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1997-01-01'), w AS (SELECT (SELECT min(o_orderdate) FROM b) AS lo, (SELECT max(o_orderdate) FROM a) AS hi), x AS (SELECT sum(o_totalprice) AS s, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS d FROM a, w WHERE o_orderdate BETWEEN lo AND hi) SELECT 'SUM(o_totalprice)' AS probe, round(s, 2) AS left_value, round(s, 2) AS right_value, 'agree' AS outcome FROM x UNION ALL SELECT 'COUNTD(o_custkey)', d, d, 'agree' FROM x",
)
def verify_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = readers.table(spark, sf_dir, "orders")
    out = verify.probe(o.where("o_orderdate < DATE '1999-01-01'"), o.where("o_orderdate >= DATE '1997-01-01'"), "o_orderdate", ["o_totalprice"], ["o_custkey"])
    return out.select("probe", F.round("left_value", 2).alias("left_value"), F.round("right_value", 2).alias("right_value"), "outcome")


@query("verify_ranges", "SELECT 'partial' AS relationship, CAST(DATE '1997-01-01' AS VARCHAR) AS low, CAST((SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate < DATE '1999-01-01') AS VARCHAR) AS high")
def verify_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = readers.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    low = spark.createDataFrame([(dt.date(1997, 1, 1),), (dt.date(2050, 1, 1),)], "d date")
    return verify.overlap(o.where("d < DATE '1999-01-01'"), low, "d").select("relationship", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


def inventories(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two small inventories with exact, renamed, superset and unrelated assets."""
    schema = "asset_id string, name string, fields array<struct<name:string,type:string>>, tables array<struct<connector:string,database:string,name:string>>, calcs array<string>"
    fld = lambda *names: [(n, "REAL" if n.startswith("amt") else "STRING") for n in names]
    left = [
        ("s1", "Sales Orders", fld("Order Ref", "amt_net", "Channel", "Region"), [("sqlserver", "dw", "FactOrders")], ["Margin"]),
        ("s2", "Café Stock", fld("Sku", "amt_stock", "Depot"), [("postgres", "inv", "stock_levels")], []),
        ("s3", "Web Visits", fld("Visit Ref", "Page Url"), [], []),
        ("s4", "Payroll", fld("Employee Ref", "amt_gross"), [("oracle", "hr", "pay")], ["Net"]),
    ]
    right = [
        ("m1", "SalesOrders", fld("Order Ref", "amt_net", "Channel", "Region", "Currency"), [("mssql", "dw", "FactOrders"), ("mssql", "dw", "DimCurrency")], ["Margin"]),
        ("m2", "Cafe stock", fld("SKU", "amt stock", "Depot"), [("postgresql", "inv2", "stock_levels")], []),
        ("m3", "Visits Model", fld("Visit Ref", "Page Url", "Agent"), [], []),
        ("m4", "Fleet", fld("Plate", "Driver Ref"), [("mysql", "cars", "fleet")], []),
    ]
    kinds = {"STRING": "string", "REAL": "double"}
    right = [(a, n, [(x, kinds[t]) for x, t in fs], ts, cs) for a, n, fs, ts, cs in right]
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


@query("cmp_tiers", "SELECT * FROM (VALUES ('s1', 'm1', 'Exact', 'already_exists', 'likely'), ('s2', 'm2', 'Exact', 'already_exists', 'none'), ('s3', 'm3', 'Strong', 'already_exists', 'none'), ('s4', 'm1', 'None', 'rebuild', 'unverified')) t(source, model, tier, bucket, logic_parity)")
def cmp_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cmp.best_matches(cmp.compare(*inventories(spark)))
    return best.select(F.col("l_asset_id").alias("source"), F.col("r_asset_id").alias("model"), "tier", "bucket", "logic_parity")


@query("cmp_scores")
def cmp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cmp.best_matches(cmp.compare(*inventories(spark)))
    return best.select("l_asset_id", "r_asset_id", "name_score", "column_score", "type_score", "source_score", "score", "margin", "reciprocal", "contested", "confidence", cmp.uncertainty().alias("reasons"), cmp.review_category().alias("review"))


@query("cmp_assignment", 'WITH RECURSIVE p AS (SELECT s_suppkey AS l, n_nationkey AS r, round(((s_suppkey * 7919 + n_nationkey * 104729) % 997) / 997.0, 4) AS score FROM supplier, nation), o AS (SELECT l, r, score, row_number() OVER (ORDER BY score DESC, l, r) AS i FROM p WHERE score > 0), g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ls, []::BIGINT[] AS rs UNION ALL SELECT o.i, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM g JOIN o ON o.i = g.i + 1), z AS (SELECT ls, rs FROM g ORDER BY i DESC LIMIT 1) SELECT unnest(ls) AS source, unnest(rs) AS model FROM z')
def cmp_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    score = F.round(((F.col("s_suppkey") * 7919 + F.col("n_nationkey") * 104729) % 997) / 997.0, 4)
    pairs = t("supplier").crossJoin(F.broadcast(t("nation")))  # the nations are 25
    pairs = pairs.select(F.col("s_suppkey").alias("l_asset_id"), F.col("n_nationkey").alias("r_asset_id"), score.alias("score"))
    return cmp.assign(pairs).select(F.col("l_asset_id").alias("source"), F.col("r_asset_id").alias("model"))


@query("cmp_cluster", "SELECT * FROM (VALUES ('s1', 's1', 2), ('s1copy', 's1', 2), ('s2', 's2', 1), ('s3', 's3', 1), ('s4', 's4', 1)) t(asset_id, cluster_id, size)")
def cmp_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = inventories(spark)
    copy = left.where("asset_id = 's1'").withColumns({"asset_id": F.lit("s1copy"), "name": F.lit("Orders (2)")})
    return cmp.cluster(left.unionByName(copy)).select("asset_id", "cluster_id", "size")


@query("cmp_importance", "WITH x AS (SELECT c_custkey AS k, c_nationkey AS w, c_custkey % 3 AS d, floor(abs(c_acctbal)) AS v, c_custkey % 2 = 0 AS e FROM customer), y AS (SELECT k, round((0.45 * (w + 2 * d) / (w + 2 * d + 8.0) + 0.40 * v / (v + 500.0) + 0.15 * CASE WHEN e THEN 1 ELSE 0 END) / 1.0, 4) AS score FROM x) SELECT k, score, CASE WHEN score >= 0.62 THEN 'Critical' WHEN score >= 0.38 THEN 'High' WHEN score >= 0.17 THEN 'Moderate' ELSE 'Low' END AS level FROM y")
def cmp_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.table(spark, sf_dir, "customer")
    score, level = cmp.importance(F.col("c_nationkey"), F.col("c_custkey") % 3, F.floor(F.abs("c_acctbal")), F.col("c_custkey") % 2 == 0)
    return df.select(F.col("c_custkey").alias("k"), score.alias("score"), level.alias("level"))


@query("cmp_dependency", "WITH i AS (SELECT lower(p_name) AS k, count(*) AS n FROM part GROUP BY 1) SELECT p_name AS name, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS state FROM (SELECT DISTINCT p_name FROM part UNION ALL SELECT r_name FROM region) LEFT JOIN i ON lower(p_name) = k")
def cmp_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, region = readers.table(spark, sf_dir, "part"), readers.table(spark, sf_dir, "region")
    names = part.select(F.upper("p_name").alias("u"), "p_name").select(F.col("p_name").alias("name")).distinct().unionByName(region.select(F.col("r_name").alias("name")))
    return cmp.resolve_dependency(names, part.select(F.upper("p_name").alias("name")))


# -- events ------------------------------------------------------------------------------------------


@query("events_tumbling", "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(readers.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


@query("events_sliding", "WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events), w AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS s, event_type, value FROM e) SELECT s AS window_start, s + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2, 3")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(readers.table(spark, sf_dir, "events"), "2 days", "1 day").withColumn("total", F.round("total", 2))


@query("events_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM b GROUP BY user_id, s")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(readers.table(spark, sf_dir, "events"))


@query("events_json", "SELECT CAST(props->>'$.k' AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1")
def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = readers.table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"] % 10)
    m = SemanticModel(spark).add("events", events)
    return run_request(m, {"fields": [f("k"), c("COUNT([event_id])", "n"), c("AVG([value])", "v", 6)]})


# -- smaller operators -------------------------------------------------------------------------------


@query("prj_colour", "SELECT o_orderpriority, count(*) AS n, CASE WHEN count(*) > 3000 THEN '#d62728' ELSE '#1f77b4' END AS colour FROM orders GROUP BY 1")
def prj_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = "IF COUNT([o_orderkey]) > 3000 THEN 'busy' ELSE 'calm' END"
    found = extras.colour_rule(rule)
    out = ask(spark, sf_dir, [f("o_orderpriority"), c("COUNT([o_orderkey])", "n"), c(rule, "label")])
    palette = dict(zip(found["members"], ("#d62728", "#1f77b4")))
    return out.select("o_orderpriority", "n", extras.colour_of(F.col("label"), palette).alias("colour"))


@query("prj_measure_values", "WITH g AS (SELECT l_returnflag, round(sum(l_quantity), 2) AS a, round(avg(l_tax), 6) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, 'quantity' AS measure, a AS value FROM g UNION ALL SELECT l_returnflag, 'tax', b FROM g")
def prj_measure_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ask(spark, sf_dir, [f("l_returnflag"), c("SUM([l_quantity])", "quantity", 2), c("AVG([l_tax])", "tax", 6)])
    return extras.measure_values(wide, ["l_returnflag"], ["quantity", "tax"])


@query("win_previous_value", "WITH RECURSIVE g AS (SELECT year(o_orderdate) AS y, count(*) AS k FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY y) AS i FROM g), r AS (SELECT i, y, CAST(100.0 * 0.5 + k AS DOUBLE) AS v FROM n WHERE i = 1 UNION ALL SELECT n.i, n.y, r.v * 0.5 + n.k FROM r JOIN n ON n.i = r.i + 1) SELECT y, round(v, 4) AS v FROM r")
def win_previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ask(spark, sf_dir, [f("o_orderdate", "YEAR", "y"), c("COUNT([o_orderkey])", "k")])
    out = extras.running_fold(marks, [], ["y"], 100.0, lambda before, now: before * 0.5 + now, "k")
    return out.select("y", F.round("fold", 4).alias("v"))


@query("src_combined", "SELECT 'sales' AS island, round(sum(o_totalprice), 2) AS v FROM orders UNION ALL SELECT 'stock', CAST(sum(p_size) AS DOUBLE) FROM part")
def src_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    both = extras.combine([("sales", SemanticModel(spark).add("facts", t("orders"))), ("stock", SemanticModel(spark).add("facts", t("part")))])
    a = run_request(both, {"fields": [c("SUM([o_totalprice])", "v", 2)]}).withColumn("island", F.lit("sales"))
    b = run_request(both, {"fields": [c("FLOAT(SUM([p_size]))", "v")]}).withColumn("island", F.lit("stock"))
    return a.unionByName(b)


@query("agg_row_counts", "SELECT 'orders' AS relation, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def agg_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.row_counts({n: readers.table(spark, sf_dir, n) for n in ("orders", "nation")})


@query("pro_metric", "WITH g AS (SELECT date_trunc('month', o_orderdate) AS p, count(*) AS k FROM orders GROUP BY 1) SELECT CAST(p AS TIMESTAMP) AS period, sum(k) OVER (PARTITION BY year(p) ORDER BY p ROWS UNBOUNDED PRECEDING) AS value, 1000.0 AS goal, sum(k) OVER (PARTITION BY year(p) ORDER BY p ROWS UNBOUNDED PRECEDING) >= 1000 AS met FROM g")
def pro_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.metric(readers.table(spark, sf_dir, "orders"), F.count(F.lit(1)), "o_orderdate", "month", True, 1000.0)


@query("cmp_name_sets", "WITH a AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size < 20), b AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size > 30) SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'right only' WHEN b.name IS NULL THEN 'left only' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.name = b.name")
def cmp_name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = readers.table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), "p_size")
    return extras.name_sets(names.where("p_size < 20"), names.where("p_size > 30"))


@query("cmp_contested", "SELECT o_orderpriority AS model, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS claimed_by FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING count(*) > 1")
def cmp_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = readers.table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "rebuild").otherwise("already_exists")
    return extras.contested(best.select(F.col("o_orderkey").cast("string").alias("l_asset_id"), F.col("o_orderpriority").alias("r_asset_id"), verdict.alias("bucket")))


@query("cmp_priority", "SELECT n_nationkey, CASE WHEN n_nationkey >= 5 THEN 'P1 - migrate first' WHEN n_nationkey >= 2 THEN 'P2 - migrate' WHEN n_nationkey = 1 THEN 'P3 - deprioritize' ELSE 'P4 - retire candidate' END AS priority FROM nation")
def cmp_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.table(spark, sf_dir, "nation")
    return df.select("n_nationkey", cmp.migration_priority(F.lit("rebuild"), cmp.usage_priority(F.col("n_nationkey"))).alias("priority"))


@query("cmp_date_table", 'SELECT o_orderpriority AS to_table, o_orderstatus AS to_column, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1')
def cmp_date_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "long").when(F.col("o_orderkey") % 3 == 1, "Date").otherwise("datetime")
    edges = readers.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("to_table"), F.col("o_orderstatus").alias("to_column"), kind.alias("to_type"))
    return extras.date_table(edges, spark.createDataFrame([], "to_table string"))


@query("cmp_rebind_downgrade", "SELECT c_custkey AS datasource, CASE WHEN c_custkey % 3 < 2 AND EXISTS (SELECT 1 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority WHERE a.o_custkey = c_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O') THEN 'convert' WHEN c_custkey % 3 = 0 THEN 'existing_model' WHEN c_custkey % 3 = 1 THEN 'published' ELSE 'consolidate' END AS action FROM customer")
def cmp_rebind_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    third = F.col("c_custkey") % 3
    plan = t("customer").select(F.col("c_custkey").alias("datasource"), F.when(third == 0, "existing_model").when(third == 1, "published").otherwise("consolidate").alias("action"))
    objects = lambda status: t("orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("datasource"), F.col("o_orderpriority").alias("object"))
    return extras.downgrade_rebinds(plan, objects("F"), objects("O"))


@query("cmp_reviews", "SELECT o_orderstatus AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'agree' WHEN o_orderkey % 3 = 1 THEN 'disagree' ELSE 'unreviewed' END AS decision, count(*) AS n FROM orders GROUP BY 1, 2")
def cmp_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = readers.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderstatus").alias("verdict"))
    decided = orders.where("asset_id % 3 < 2").select("asset_id", F.when(F.col("asset_id") % 3 == 0, "agree").otherwise("disagree").alias("decision"))
    return extras.review_counts(orders, decided)


@query("rec_rank_candidates", 'WITH g AS (SELECT l_suppkey AS candidate, count(CASE WHEN l_linenumber < 4 THEN 1 END) AS passed, count(CASE WHEN l_linenumber = 7 THEN 1 END) AS failed, count(*) AS n FROM lineitem GROUP BY 1) SELECT candidate, passed, failed, row_number() OVER (ORDER BY CASE WHEN failed > 0 THEN 3 WHEN passed = n THEN 1 ELSE 2 END, passed DESC, candidate) AS rank FROM g')
def rec_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.table(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_linenumber") < 4, "pass").when(F.col("l_linenumber") == 7, "fail").otherwise("inconclusive")
    return extras.rank_candidates(lines.select(F.col("l_suppkey").alias("candidate"), state.alias("state")))


@query("rec_expected", "SELECT * FROM (VALUES ('rows', 25.0, 25.0, 'pass'), ('regions', 5.0, 6.0, 'fail')) t(measure, value, expected, state)")
def rec_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = readers.table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.count_distinct("n_regionkey").cast("double").alias("regions"))
    want = spark.createDataFrame([("rows", 25.0), ("regions", 6.0)], "measure string, value double")
    return reconcile.against_expected(n.unpivot([], ["rows", "regions"], "measure", "value"), want)


@query("join_inferred", "SELECT 'Orders' AS many, 'Id (People)' AS many_key, 'People' AS one, 'Id' AS one_key, 'many_to_one' AS cardinality")
def join_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = readers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"))
    found = extras.infer_relationships({"Orders": ["Id", "Id (People)"], "People": ["Id"]}, lambda t, k: relationships.is_unique(people, k))
    return spark.createDataFrame([(e.many, e.many_key, e.one, e.one_key, e.cardinality) for e in found], "many string, many_key string, one string, one_key string, cardinality string")


@query("par_date_domain", "SELECT count(*) AS n FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem), INTERVAL 1 DAY)))")
def par_date_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    return cal.date_domain([(t("orders"), "o_orderdate"), (t("lineitem"), "l_shipdate")]).agg(F.count(F.lit(1)).alias("n"))


@query("par_list_labels", "SELECT * FROM (VALUES ('q', 'Quantity'), ('p', 'Price')) t(value, label)")
def par_list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SemanticModel(spark).parameter("P", "q", members=[("q", "Quantity"), ("p", "Price")]).parameters["P"].domain(spark)


@query("join_asof", "WITH v AS (SELECT user_id AS vu, ts AS vt, max(event_id) AS ve FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT b.event_id, v.ve AS view_id FROM b ASOF LEFT JOIN v ON b.user_id = v.vu AND b.ts >= v.vt")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = readers.table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select(F.col("ts").alias("view_ts"), F.col("user_id").alias("view_user"), F.col("event_id").alias("view_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relationships.asof_join(bought, views, [("user_id", "view_user")], ("ts", "view_ts")).select("event_id", "view_id")


@query("join_range", "SELECT p.p_partkey AS k, count(*) AS n FROM part p JOIN (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 25 AS high FROM supplier) s ON p.p_retailprice BETWEEN s.low AND s.high GROUP BY 1")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: readers.table(spark, sf_dir, n)
    bands = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return relationships.range_join(t("part"), bands, "p_retailprice", "low", "high", 25.0).groupBy(F.col("p_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("join_composite", "WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2) SELECT flag, round(sum(q), 2) AS q FROM a LEFT JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1")
def join_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.table(spark, sf_dir, "lineitem")
    m = SemanticModel(spark).add("facts", lines.select("l_orderkey", "l_linenumber", "l_quantity"))
    m.add("flags", lines.where("l_linenumber < 4").groupBy(F.col("l_orderkey").alias("f_order"), F.col("l_linenumber").alias("f_line")).agg(F.min("l_returnflag").alias("l_returnflag")))
    m.relate("facts", ("l_orderkey", "l_linenumber"), "flags", ("f_order", "f_line"), measure=True)
    return run_request(m, {"fields": [f("l_returnflag", name="flag"), c("SUM([l_quantity])", "q", 2)]})


_YQ = "WITH g AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(o_totalprice) AS s, count(*) AS k FROM orders GROUP BY 1, 2) "
_YQ_FIELDS = [f("o_orderdate", "YEAR", "y"), f("o_orderdate", "QUARTER", "q")]
register_request(
    "win_ytd_growth",
    [*_YQ_FIELDS, c("SUM([o_totalprice])", "growth", 6, address=["q"], partition=["y"], quickCalc={"family": "YTD_GROWTH", "periods": 4})],
    _YQ + ", t AS (SELECT y, q, sum(s) OVER (PARTITION BY y ORDER BY q ROWS UNBOUNDED PRECEDING) AS ytd FROM g) SELECT y, q, round((ytd - lag(ytd, 4) OVER (ORDER BY y, q)) / lag(ytd, 4) OVER (ORDER BY y, q), 6) AS growth FROM t",
)
register_request(
    "win_framed",
    [*_YQ_FIELDS, c("WINDOW_PERCENTILE(SUM([o_totalprice]), 0.25, -3, 0)", "p", 4), c("WINDOW_CORR(SUM([o_totalprice]), COUNT([o_orderkey]), -5, 0)", "r", 6), c("WINDOW_COVARP(SUM([o_totalprice]), COUNT([o_orderkey]), FIRST(), 0)", "cv", 1), c("WINDOW_MEDIAN(COUNT([o_orderkey]), -2, 2)", "m", 2)],
    _YQ + "SELECT y, q, round(quantile_cont(s, 0.25) OVER (ORDER BY y, q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS p, round(corr(s, k) OVER (ORDER BY y, q ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS r, round(covar_pop(s, k) OVER (ORDER BY y, q ROWS UNBOUNDED PRECEDING), 1) AS cv, round(median(k) OVER (ORDER BY y, q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS m FROM g",
)
_SCOPES = ("Table", "Rows", "Columns", "Pane", "PaneRow", "PaneCol", "Cell", "CellInPane")
_OVER_SCOPE = {
    "Table": "ORDER BY y, q, p, st", "Rows": "PARTITION BY y, q ORDER BY p, st", "Columns": "PARTITION BY p, st ORDER BY y, q", "Pane": "PARTITION BY y, p ORDER BY q, st", "PaneRow": "PARTITION BY y, q, p ORDER BY st", "PaneCol": "PARTITION BY y, p, st ORDER BY q", "Cell": "PARTITION BY y, q, p, st ORDER BY y", "CellInPane": "PARTITION BY q, st ORDER BY y, p",
}
register_request(
    "win_scopes",
    [*_YQ_FIELDS, f("o_orderpriority", name="p"), f("o_orderstatus", name="st"), *[c("RUNNING_SUM(COUNT([o_orderkey]))", s.lower(), scope=s) for s in _SCOPES if s != "Cell"], c("WINDOW_SUM(COUNT([o_orderkey]))", "cell", scope="Cell")],
    "WITH g AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderpriority AS p, o_orderstatus AS st, count(*) AS k FROM orders GROUP BY ALL) SELECT y, q, p, st, " + ", ".join(f"sum(k) OVER ({w} ROWS UNBOUNDED PRECEDING) AS {s.lower()}" for s, w in _OVER_SCOPE.items()) + " FROM g",
    rows=["y", "q"], columns=["p", "st"],
)
register_request(
    "win_previous_formula",
    [f("o_orderdate", "YEAR", "y"), c("PREVIOUS_VALUE(100) * 0.5 + COUNT([o_orderkey])", "v", 4), c("IF COUNT([o_orderkey]) % 2 = 0 THEN PREVIOUS_VALUE(7) ELSE PREVIOUS_VALUE(7) + 1 END", "w")],
    "WITH RECURSIVE g AS (SELECT year(o_orderdate) AS y, count(*) AS k FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY y) AS i FROM g), r AS (SELECT i, y, CAST(100.0 * 0.5 + k AS DOUBLE) AS v, CAST(7 + k % 2 AS DOUBLE) AS w FROM n WHERE i = 1 UNION ALL SELECT n.i, n.y, r.v * 0.5 + n.k, r.w + n.k % 2 FROM r JOIN n ON n.i = r.i + 1) SELECT y, round(v, 4) AS v, w FROM r",
)
register_request(
    "totals_cube",
    [f("l_returnflag"), f("l_linestatus"), c("SUM([l_quantity])", "q", 2), c("COUNTD([l_suppkey])", "s")],
    'SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(DISTINCT l_suppkey) AS s, grouping(l_returnflag, l_linestatus) AS "totalLevel" FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)',
    totals="cube",
)
register_request(
    "totals_table_calc",
    [f("o_orderdate", "YEAR", "y"), f("o_orderpriority", name="p"), c("COUNT([o_orderkey])", "n"), c("RANK(COUNT([o_orderkey]))", "r", address=["p"], partition=["y"]), c("RUNNING_SUM(COUNT([o_orderkey]))", "rs", address=["y"])],
    "WITH g AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) SELECT y, p, n, rank() OVER (PARTITION BY y ORDER BY n DESC) AS r, sum(n) OVER (PARTITION BY p ORDER BY y ROWS UNBOUNDED PRECEDING) AS rs, 0 AS \"totalLevel\" FROM g UNION ALL SELECT NULL, NULL, (SELECT sum(n) FROM g), 1, (SELECT sum(n) FROM g), 3",
    totals="grand",
)


@query("verify_verdicts", "WITH r(a, b, c, d) AS (SELECT CAST(p_size AS DOUBLE), CAST(p_size + p_partkey % 7 AS DOUBLE), CAST(p_partkey % 50 AS DOUBLE), CAST(p_partkey % 50 + 3 AS DOUBLE) FROM part) SELECT CASE WHEN greatest(a, c) > least(b, d) THEN 'disjoint' WHEN abs(a - c) <= 0.01 * greatest(abs(a), abs(c)) + 1e-9 AND abs(b - d) <= 0.01 * greatest(abs(b), abs(d)) + 1e-9 THEN 'equal' WHEN a >= c AND b <= d THEN 'subset' WHEN c >= a AND d <= b THEN 'superset' ELSE 'partial' END AS relationship, count(*) AS n FROM r GROUP BY 1")
def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readers.table(spark, sf_dir, "part")
    ends = [F.col("p_size").cast("double"), (F.col("p_size") + F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 50).cast("double"), (F.col("p_partkey") % 50 + 3).cast("double")]
    return p.groupBy(verify.relationship(*ends, rtol=0.01).alias("relationship")).agg(F.count(F.lit(1)).alias("n"))


@query("reconcile_summary", "WITH s AS (SELECT CASE WHEN l_linenumber < 4 THEN 'pass' WHEN l_linenumber = 7 THEN 'fail' ELSE 'inconclusive' END AS state FROM lineitem) SELECT count(*) AS n, count(CASE WHEN state = 'pass' THEN 1 END) AS pass, count(CASE WHEN state = 'fail' THEN 1 END) AS fail, count(CASE WHEN state = 'inconclusive' THEN 1 END) AS inconclusive, round(count(CASE WHEN state = 'pass' THEN 1 END) / count(CASE WHEN state <> 'inconclusive' THEN 1 END), 4) AS pass_rate FROM s")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_linenumber") < 4, "pass").when(F.col("l_linenumber") == 7, "fail").otherwise("inconclusive")
    return reconcile.summary(readers.table(spark, sf_dir, "lineitem").select(state.alias("state")))


@query("cmp_cluster_chain", "WITH RECURSIVE a AS (SELECT p_partkey // 40 AS g, p_partkey % 40 AS i FROM part), e AS (SELECT x.g, x.i, y.i AS j FROM a x JOIN a y ON x.g = y.g AND abs(x.i - y.i) = 1), r AS (SELECT g, i, i AS top FROM a UNION SELECT e.g, e.i, r.top FROM r JOIN e ON r.g = e.g AND e.j = r.i), m AS (SELECT g, i, min(top) AS top FROM r GROUP BY 1, 2) SELECT lpad(CAST(g * 40 + i AS VARCHAR), 9, '0') AS asset_id, lpad(CAST(g * 40 + top AS VARCHAR), 9, '0') AS cluster_id, count(*) OVER (PARTITION BY g, top) AS size FROM m")
def cmp_cluster_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of assets that each share most columns with the next one."""
    o = readers.table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("g"), (F.col("p_partkey") % 40).alias("i"))
    name = lambda k: F.concat(F.lit("col g"), F.col("g").cast("string"), F.lit(" k"), k.cast("string"))
    fields = F.transform(F.sequence(F.col("i"), F.col("i") + 19), lambda k: F.struct(name(k).alias("name"), F.lit("STRING").alias("type")))
    table = F.array(F.struct(F.lit("sqlserver").alias("connector"), F.concat(F.lit("db"), F.col("g").cast("string")).alias("database"), F.concat(F.lit("facts"), F.col("g").cast("string")).alias("name")))
    rows = o.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("asset_id"), F.concat(F.lit("Sales "), F.col("g").cast("string")).alias("name"), fields.alias("fields"), table.alias("tables"), F.expr("cast(array() as array<string>)").alias("calcs"))
    return cmp.cluster(rows, threshold=0.93).select("asset_id", "cluster_id", "size")


__all__ = ["ORACLE_SQL", "QUERIES", "star_model"]
