"""Tables in hash buckets of their key, where a change rewrites only the buckets it touches.

A bucket is a partition folder of a plain Parquet table, and a change is a dynamic
partition overwrite. Rows of one key are in one bucket, so whatever is decided
by key needs no other. A change that is stopped may have replaced some buckets;
made again, it gives the same table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint

BUCKET = "bucket"


def _placed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str, buckets: int) -> None:
    df.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write `df`; choose `buckets` so that one is about a file's worth of rows."""
    _write(_placed(df, keys, buckets), path, buckets)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def change(spark: SparkSession, path: str, keys: list[str], buckets: int, changes: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets of the keys of `changes` by `make(their rows, changes)`; returns these buckets.

    `make` decides by key alone and leaves no bucket without rows.
    """
    changes = checkpoint(changes)
    touched = sorted(r[0] for r in _placed(changes, keys, buckets).select(BUCKET).distinct().collect())  # at most `buckets`
    if touched:
        rows = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        _write(_placed(checkpoint(make(rows, changes)), keys, buckets), path, buckets)
    return touched
