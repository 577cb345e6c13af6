"""Helpers shared by the training-data operators: shared storage, sizing and word handling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import new_folder

LAST_ID = np.int64(2**63 - 1)  # stands in for a null id where ids are ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    quern.sources.shared.release() deletes what has been written without a path.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def plan_bytes(df: DataFrame, column: str = "text") -> int:
    """Input bytes by the optimizer's statistics (file sizes); where it has none, the measured size of a column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return size


def pieces(size: int, each: int) -> int:
    return max(1, -(-size // each))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a key look uniform."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column_bytes(column: pa.ChunkedArray | pa.Array) -> list:
    """A string column as UTF-8 bytes objects, nulls as empty."""
    if pa.types.is_large_string(column.type):
        return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
    return [x or b"" for x in column.cast(pa.string()).cast(pa.binary()).to_pylist()]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as int64, nulls as LAST_ID."""
    filled = column.cast(pa.int64()).fill_null(int(LAST_ID))
    return np.asarray(filled.to_numpy(zero_copy_only=False) if isinstance(filled, pa.Array) else filled.to_numpy(), dtype=np.int64)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n consecutive items of h; the last n - 1 places have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + m]
    return mix(out)


def text_length(column: str = "text"):
    return F.length(column).cast("long")
