"""Relations from files, SQL and other engines, and the sinks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.errors import Unsupported

#: Engines read over JDBC: name to URL prefix.
JDBC_ENGINES = {"sqlserver": "jdbc:sqlserver://", "postgres": "jdbc:postgresql://", "mysql": "jdbc:mysql://", "redshift": "jdbc:redshift://", "oracle": "jdbc:oracle:thin:@//", "snowflake": "jdbc:snowflake://", "databricks": "jdbc:databricks://"}
#: Engines that are recognised but have no reader here.
RECOGNISED = frozenset({"bigquery", "teradata"})
#: How well each way of reading suits: a table in a catalog or lake, a direct query, a file, an extract copy, anything else.
MODE_SCORES = {"direct": 95, "import": 90, "hybrid": 80, "extract": 60, "fallback": 30}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named_relation(name: str) -> tuple[str | None, str | None, str]:
    """(catalog, schema, item) of a bracketed or dotted name of one to three parts."""
    parts = [p.strip("[]") for p in re.findall(r"\[[^\]]+\]|[^.\[\]]+", name)]
    if not 1 <= len(parts) <= 3:
        raise Unsupported("unresolved_reference", f"relation name {name!r}")
    return (*[None] * (3 - len(parts)), *parts)  # type: ignore[return-value]


def custom_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """A custom-SQL relation; << and >> stand for < and >, :name for an argument."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql.replace("<<", "<").replace(">>", ">"), args=args or {})


_LIFT = re.compile(r"(?is)\bwhere\b(.*)$")
_CONJUNCT = re.compile(r"(?is)^\s*([A-Za-z_][\w.]*)\s*=\s*<\[Parameters\]\.\[([^\]]+)\]>\s*$")


def lift_parameters(sql: str, columns: list[str]) -> tuple[str, list[tuple[str, str]], list[str]]:
    """Take `column = <[Parameters].[X]>` conjuncts out of a query's WHERE.

    Gives (sql, lifted (column, parameter) pairs, what stays unresolved). Only a single WHERE
    of AND-ed terms is touched, and only for columns that the query returns: then filtering
    its result is the same.
    """
    used = re.findall(r"<\[Parameters\]\.\[([^\]]+)\]>", sql)
    if not used:
        return sql, [], []
    if len(re.findall(r"(?i)\bwhere\b", sql)) != 1:
        return sql, [], used
    m = _LIFT.search(sql)
    body = m.group(1)  # type: ignore[union-attr]
    tail = re.search(r"(?is)\b(group\s+by|order\s+by|having|limit|union|intersect|except)\b.*$", body)
    rest = tail.group() if tail else ""
    terms = body[: tail.start()] if tail else body
    if re.search(r"(?i)\bor\b|\(|\)", terms) or re.match(r"(?i)group|having", rest):
        return sql, [], used
    lifted, stay = [], []
    known = {c.casefold(): c for c in columns}
    for term in re.split(r"(?i)\band\b", terms):
        c = _CONJUNCT.match(term)
        if c and c[1].split(".")[-1].casefold() in known:
            lifted.append((known[c[1].split(".")[-1].casefold()], c[2]))
        else:
            stay.append(term.strip())
    head = sql[: m.start()].rstrip()  # type: ignore[union-attr]
    out = head + (" WHERE " + " AND ".join(stay) if stay else "") + (" " + rest if rest else "")
    return out, lifted, re.findall(r"<\[Parameters\]\.\[([^\]]+)\]>", out)


def sql_tables(sql: str) -> list[str]:
    """Relations that a query names after FROM and JOIN, in order."""
    plain = re.sub(r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", sql)
    ctes = {c.casefold() for c in re.findall(r"(?i)(?:\bwith\b|,)\s*([A-Za-z_]\w*)\s+as\s*\(", plain)}
    found = re.findall(r'(?i)\b(?:from|join)\s+((?:\[[^\]]+\]|"[^"]+"|`[^`]+`|\w+)(?:\s*\.\s*(?:\[[^\]]+\]|"[^"]+"|`[^`]+`|\w+))*)', plain)
    names = [re.sub(r'[\[\]"`\s]', "", f) for f in found]
    return list(dict.fromkeys(n for n in names if n.casefold() not in ctes))


def read_csv(spark: SparkSession, path: str, rename: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """A landed CSV: a header, values stay text, short rows are padded with NULL, overflow is ignored."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    df = df.withColumnsRenamed(rename or {})
    return df.limit(limit) if limit is not None else df


def decimal_convention(df: DataFrame, columns: list[str]) -> str:
    """dot, comma or unknown: how the numbers of text columns are written; both kinds mean unknown."""
    comma = r"^[+-]?(\d{1,3}(\.\d{3})+|\d+),\d+$"
    dot = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)\.\d+$"
    seen = df.agg(*[F.bool_or(F.col(c).rlike(p)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, p in (("comma", comma), ("dot", dot))]).first()
    commas, dots = (any(seen[f"{k}{i}"] for i in range(len(columns))) for k in ("comma", "dot"))
    return "unknown" if commas == dots else "comma" if commas else "dot"


def parse_number(col: Column, convention: str) -> Column:
    """Text to double by a decimal convention; what isn't a number is NULL."""
    if convention == "comma":
        col = F.replace(F.replace(col, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    else:
        col = F.replace(col, F.lit(","), F.lit(""))
    return col.try_cast("double")


def wildcard_union(spark: SparkSession, folder: str, pattern: str, form: str = "parquet") -> DataFrame:
    """All files of a folder, at any depth, whose name matches the pattern."""
    return spark.read.format(form).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def jdbc(spark: SparkSession, engine: str, place: str, query: str, options: dict[str, str] | None = None) -> DataFrame:
    """A query sent to another engine; what Spark can push down goes there too."""
    if engine in RECOGNISED:
        raise Unsupported("unsupported_other", f"{engine} is recognised but has no reader")
    if engine not in JDBC_ENGINES:
        raise Unsupported("unsupported_other", f"engine {engine}")
    return spark.read.format("jdbc").option("url", JDBC_ENGINES[engine] + place).option("query", query).options(**(options or {})).load()


@dataclass(frozen=True)
class StorageChoice:
    mode: str
    score: int
    reason: str


def storage_mode(kind: str, has_extract: bool = False, sources: int = 1) -> StorageChoice:
    """How a source should be read: queried in place, read and kept, or as a fallback."""
    if kind in JDBC_ENGINES or kind in ("parquet", "catalog"):
        if has_extract:
            return StorageChoice("import", MODE_SCORES["import"], "an extract holds the rows")
        if sources > 1:
            return StorageChoice("hybrid", MODE_SCORES["hybrid"], "several sources meet")
        return StorageChoice("direct", MODE_SCORES["direct"], "the source answers queries")
    if kind in ("csv", "text", "json", "excel"):
        return StorageChoice("import", MODE_SCORES["import"], "files are read whole")
    if has_extract:
        return StorageChoice("extract", MODE_SCORES["extract"], "only the extract can be read")
    return StorageChoice("fallback", MODE_SCORES["fallback"], f"{kind} has no reader")


def clean_names(df: DataFrame) -> DataFrame:
    """Columns renamed so that no name holds a character that table formats refuse; clashes get a number."""
    names: dict[str, str] = {}
    for c in df.columns:
        plain = re.sub(r"[ ,;{}()\n\t=.\[\]`\"']", "_", c).strip("_") or "column"
        n, new = 1, plain
        while new in names.values():
            n, new = n + 1, f"{plain}_{n + 1}"
        names[c] = new
    return df.toDF(*[names[c] for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """An executive CSV: one file with a header that begins with a byte-order mark. For results of bounded size."""
    first = df.columns[0]
    df.coalesce(1).withColumnRenamed(first, "﻿" + first).write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)
