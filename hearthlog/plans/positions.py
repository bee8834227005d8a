"""Where DuckDB 2.0 lays the partitions of a window, for queries whose SQL adds doubles."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import layout, running
from ..session import small_side

# ---- fixed values ----
FIRST_BITS, MORE_BITS = 4, 2
ROWS_PER_GROUP = 122_880
GROUP_BITS_END = 48
FACTOR = 0xD6E8FEB86659FD93
NULL_HASH = 13787848793156543929
# ---- end of fixed values ----


def _bits(rows: int) -> int:
    """Groups of a window are told apart by this many bits of their key's hash."""
    bits = FIRST_BITS
    while rows >> bits > ROWS_PER_GROUP:
        bits += MORE_BITS
    return bits


def with_position(rows: DataFrame, key: str, out: str) -> DataFrame:
    """`rows` and the position of the first row of their `key`, a bigint, among the rows of its group.

    Partitions are dealt out over groups by the hash of their key, and lie in a
    group in the order of their keys, NULL first.
    """
    bits = _bits(rows.count())

    @F.pandas_udf("long")
    def group(keys: pd.Series) -> pd.Series:
        x = keys.to_numpy(np.int64).view(np.uint64)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(FACTOR)
        x = x ^ (x >> np.uint64(32))
        return pd.Series(((x >> np.uint64(GROUP_BITS_END - bits)) & np.uint64(2**bits - 1)).astype(np.int64))

    null_group = (NULL_HASH >> (GROUP_BITS_END - bits)) & (2**bits - 1)
    found = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_group", F.when(F.col("_key").isNull(), F.lit(null_group).cast("long")).otherwise(group(F.coalesce("_key", F.lit(0)))))
    starts = running(layout(found, ["_group"], ["_key"]), F.col("_n"), "sum", out, inclusive=False).done()
    starts = starts.select("_key", F.coalesce(out, F.lit(0)).alias(out))
    return rows.join(small_side(starts), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
