"""Column profiles in one pass, and the schema profile."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.binder import dtype_of
from tessera.plans.model import SemanticModel


def column_stats(df: DataFrame, skip: frozenset[str] = frozenset()) -> DataFrame:
    """One row a column: rows, non_null, null_count, null_rate, cardinality, min, max, avg.

    Everything is one aggregation; min and max are text, dates as ISO days. Columns without
    a static type and those in ``skip`` (bins, groups, sets) have no row.
    """
    usable = [f for f in df.schema.fields if dtype_of(f.dataType) and f.name not in skip]
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(usable):
        c = F.col(f"`{f.name}`")
        shown = F.to_date(c) if dtype_of(f.dataType) == "date" else c
        number = dtype_of(f.dataType) == "number"
        parts += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"), F.min(shown).cast("string").alias(f"a{i}"), F.max(shown).cast("string").alias(f"z{i}"), (F.avg(c) if number else F.lit(None).cast("double")).alias(f"m{i}")]
    one = df.agg(*parts)
    rows = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), F.col(f"n{i}").alias("non_null"), (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            F.round(F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")), 4).alias("null_rate"), F.col(f"d{i}").alias("cardinality"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max"), F.col(f"m{i}").alias("avg"),
        )
        for i, f in enumerate(usable)
    ])
    return one.select(F.inline(rows))


def profile_in_batches(df: DataFrame, batch: int = 50, stats=column_stats) -> tuple[DataFrame, list[str]]:
    """(profile, columns that failed): column_stats over ``batch`` columns at a time; a batch that fails is split in halves down to the columns at fault."""
    columns = [f.name for f in df.schema.fields if dtype_of(f.dataType)]
    todo, done, failed = [columns[i : i + batch] for i in range(0, len(columns), batch)], [], []
    while todo:
        part = todo.pop(0)
        try:
            done += stats(df.select(*[F.col(f"`{c}`") for c in part])).collect()  # one row a column
        except PySparkException:
            half = len(part) // 2
            if half:
                todo[:0] = [part[:half], part[half:]]
            else:
                failed += part
    schema = "column string, type string, rows long, non_null long, null_count long, null_rate double, cardinality long, min string, max string, avg double"
    return df.sparkSession.createDataFrame(done, schema), failed


def schema_profile(model: SemanticModel) -> DataFrame:
    """One row for each field and calculation: relation, name, role, type, formula."""
    rows = []
    for r in model.relations.values():
        for caption, column in r.captions.items():
            kind = r.df.schema[column].dataType
            measure = isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
            rows.append((r.name, caption, "measure" if measure else "dimension", dtype_of(kind), None))
    for c in model.calcs.values():
        rows.append((None, c.name, "dimension" if model.is_row_level(c.name) else "measure", None, c.formula))
    return model.spark.createDataFrame(rows, "relation string, name string, role string, type string, formula string")
