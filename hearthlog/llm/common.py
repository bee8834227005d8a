"""Helpers shared by the operators: whole texts, word splitting, distributed ranks and checked joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint, is_small, stored  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# rows that one window partition of a distributed rank may hold on average
ROWS_PER_BUCKET = 20_000
# heaviest keys of a join that are broadcast; any other has less than 1 / HOT_KEYS of the rows
HOT_KEYS = 1000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def whole(text: Column) -> Column:
    """The text itself; a null one counts as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. `lower` does just that in a text of one-byte characters, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def with_uid(df: DataFrame, bucket: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows numbered by `__uid` and frozen by a checkpoint; `bucket` adds an even hash bucket of that number."""
    df = checkpoint(df.withColumn("__uid", F.monotonically_increasing_id()))
    if bucket is None:
        return df
    buckets = max(1, -(-df.count() // rows_per_bucket))
    return df.withColumn(bucket, F.pmod(F.xxhash64("__uid"), F.lit(buckets)).cast("int"))


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Gapless ranks from 0 within `keys`, without one task for a key.

    Rows are numbered inside (keys, bucket) and shifted by the counts of the
    key's earlier buckets. Keys must not be null and `df` must give the same
    rows when read twice.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return (df.withColumn("__inside", inside).join(offsets, [*keys, bucket])
            .withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__before", "__inside"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join the columns of `right` to rows whose keys may be very uneven; `weight` counts a key's rows on the left.

    `right` is stored and unique by keys that are never null. If it is checked
    small it is broadcast. Otherwise its heaviest keys are, and the rows of
    all others are shuffled, so that no key of the left side fills one task.
    """
    if is_small(right):
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    hot = checkpoint(right.orderBy(F.col(weight).desc()).limit(HOT_KEYS)).drop(weight)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.drop(weight), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(others)


def without(docs: DataFrame, losers: DataFrame, key: str) -> DataFrame:
    """Rows of `docs` whose key is not among `losers`; rows with a null key stay."""
    return docs.join(F.broadcast(losers) if is_small(losers) else losers, key, "left_anti")
