"""Helpers shared by the training-data operators: stage tables, words, Arrow access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words of letters, digits and non-ASCII characters, once A-Z are lower case.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode only; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let no Arrow batch hold more than ``most`` bytes: by rows alone, a batch of long texts could fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    A lost executor then costs a re-read, never a recomputation of what led here. The
    folder is removed by ``discard``, by ``release_tables`` or when the driver's Python ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_at_exit)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    return table


def _remove(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove stage tables that nothing reads any more: what was made from them is written itself."""
    for table in tables:
        if getattr(table, "stage_path", None) in _written:
            _remove(table.stage_path)


def release_tables() -> None:
    """Remove all stage tables of this session. Results that were returned but not yet written need them: write those first."""
    for path in list(_written):
        _remove(path)


def _remove_at_exit() -> None:
    try:
        release_tables()
    except Exception:  # the JVM may have ended first; the cluster's own clean-up then applies
        return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers are told where this package lies, in case only the driver's path has it."""
    bound_batches(spark)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame) -> list[Column]:
    """A table's columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII text takes the byte-wise ``lower``; the rest is translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def plain_words(text: Column) -> Column:
    """Words of a lower-cased text as an array (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NON_WORD), "")


def byte_offsets(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and each row's offsets in them, without a copy."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def utf8_rows(column):
    """Each row of an Arrow string column as bytes (null: empty)."""
    data, at = byte_offsets(column)
    whole, at = data[at[0] : at[-1]].tobytes(), at - at[0]  # a slice's own bytes alone
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield b"" if nulls[i] else whole[at[i] : at[i + 1]]


def small_batches(batches, column: int, most: int = 4 << 20):
    """Arrow batches cut so that a string column has about ``most`` bytes in each, and one row at least."""
    for batch in batches:
        _, at = byte_offsets(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
