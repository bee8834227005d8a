"""Ordered windows that hold when one key owns a large share of all rows.

A plain `Window.partitionBy(key).orderBy(...)` puts a key into one task. Here a
key with more than `rows_per_block` rows is cut into consecutive blocks along
its order, so that a window partition is (key, block) and stays bounded. What a
block needs from earlier blocks of its key is brought in explicitly:

* running aggregates add the aggregate of all earlier blocks (one row per block);
* look-back frames receive copies of the last rows before the block ("halo").

Block limits come from a sample of the hot keys only, are fixed literals once
drawn, and influence balance but never results.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

ROWS_PER_BLOCK = 2_000_000
_MAX_BLOCKS_PER_KEY = 2_000
_SAMPLES_PER_BLOCK = 8
_STEP = 45  # limits are searched in two levels of about sqrt(_MAX_BLOCKS_PER_KEY)

ALL = "_all"  # constant key of a keyless order
BLOCK = "_block"
HALO = "_halo"


@dataclass
class Layout:
    """A DataFrame with a bounded `_block` column under each key."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    limits: DataFrame | None = field(default=None, repr=False)

    @property
    def hot(self) -> bool:
        return self.limits is not None

    @property
    def parts(self) -> list[str]:
        return [*self.keys, BLOCK] if self.hot else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> "Layout":
        """Same blocks over a changed frame that still has `_block`."""
        return Layout(df, self.keys, self.order, self.limits)

    def apply(self, df: DataFrame) -> "Layout":
        """Cut another frame with the same keys and order columns at the same limits."""
        return Layout(_cut(df, self.keys, self.order, self.limits), self.keys, self.order, self.limits)

    def done(self, df: DataFrame | None = None) -> DataFrame:
        return (self.df if df is None else df).drop(BLOCK, ALL)


def has_hot_keys(df: DataFrame, keys: list[str], rows_per_block: int | None = None) -> bool:
    """Whether some key has more rows than a block; one narrow count."""
    counts = df.groupBy(*keys).count()
    return not counts.where(F.col("count") > (rows_per_block or ROWS_PER_BLOCK)).isEmpty()


def layout(
    df: DataFrame, keys: list[str], order: list[str], rows_per_block: int | None = None, cold: bool = False
) -> Layout:
    """Find hot keys with one narrow count and cut only those.

    `order` must be unique within a key. Without keys the whole frame is one order.
    `cold` skips the count when the caller knows that no key is hot.

    The driver receives at most rows/rows_per_block keys and a few sampled
    order values for each block.
    """
    rows_per_block = rows_per_block or ROWS_PER_BLOCK
    if not keys:
        keys = [ALL]
        df = df.withColumn(ALL, F.lit(0))
    hot_rows = [] if cold else df.groupBy(*keys).count().where(F.col("count") > rows_per_block).collect()
    if not hot_rows:
        return Layout(df.withColumn(BLOCK, F.lit(0)), keys, order)

    spark = df.sparkSession
    blocks = {
        tuple(r[k] for k in keys): min(-(-r["count"] // rows_per_block), _MAX_BLOCKS_PER_KEY)
        for r in hot_rows
    }
    narrow = df.select(*keys, *order)
    hot = spark.createDataFrame([(*k,) for k in blocks], narrow.select(*keys).schema)
    narrow = narrow.join(F.broadcast(hot), keys, "left_semi")  # at most rows/rows_per_block keys
    total = sum(r["count"] for r in hot_rows)
    fraction = min(1.0, 2.0 * _SAMPLES_PER_BLOCK * sum(blocks.values()) / total)
    sampled: dict[tuple, list[tuple]] = defaultdict(list)
    for row in narrow.sample(fraction=fraction, seed=11).collect():
        sampled[tuple(row[k] for k in keys)].append(tuple(row[c] for c in order))

    cut_points = []
    for key, values in sampled.items():
        values.sort(key=lambda v: tuple((x is not None, x) for x in v))
        n = blocks[key]
        picked = sorted(
            {values[i * len(values) // n] for i in range(1, n)} if n > 1 else set(),
            key=lambda v: tuple((x is not None, x) for x in v),
        )
        if picked:
            groups = [picked[i : i + _STEP] for i in range(0, len(picked), _STEP)]
            cut_points.append((*key, groups))
    if not cut_points:
        return Layout(df.withColumn(BLOCK, F.lit(0)), keys, order)
    types = dict(df.select(*keys, *order).dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys),
                     "_limits array<array<struct<" + ", ".join(f"`{c}`: {types[c]}" for c in order) + ">>>"])
    limits = spark.createDataFrame(cut_points, ddl)
    return Layout(_cut(df, keys, order, limits), keys, order, limits)


def _cut(df: DataFrame, keys: list[str], order: list[str], limits: DataFrame | None) -> DataFrame:
    if limits is None:
        return df.withColumn(BLOCK, F.lit(0))
    joined = df.join(F.broadcast(limits), keys, "left")  # one row per hot key
    here = F.struct(*[F.col(c) for c in order])
    group = F.size(F.filter("_limits", lambda g: F.element_at(g, 1) <= here))
    inside = F.size(F.filter(F.get("_limits", F.col("_group") - 1), lambda x: x <= here))
    block = F.when(F.col("_limits").isNull() | (F.col("_group") <= 0), F.lit(0)).otherwise(
        (F.col("_group") - 1) * F.lit(_STEP) + inside
    )
    return joined.withColumn("_group", group).withColumn(BLOCK, block).drop("_limits", "_group")


def _cut_keys(lay: Layout) -> DataFrame:
    """Only the rows of keys that were cut; the others need nothing from other blocks."""
    return lay.df.join(F.broadcast(lay.limits.select(*lay.keys)), lay.keys, "left_semi")


def _agg(how: str) -> Callable[[Column], Column]:
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[how]


def running(lay: Layout, value: Column, how: str, out: str, inclusive: bool = True) -> Layout:
    """Running sum / max / min / count of `value` in order within the key.

    Exclusive running values are NULL on the first row, as in a window frame.
    """
    df = lay.df.withColumn("_value", value)
    frame = lay.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumn(out, _agg(how)(F.col("_value")).over(frame))
    if not lay.hot:
        return lay.with_df(df.drop("_value"))
    totals = (
        _cut_keys(lay)
        .withColumn("_value", value)
        .groupBy(*lay.keys, BLOCK)
        .agg(_agg(how)(F.col("_value")).alias("_part"))
    )
    over_blocks = (
        Window.partitionBy(*lay.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    merge = _agg(how) if how in ("max", "min") else F.sum
    carry = totals.select(*lay.keys, BLOCK, merge("_part").over(over_blocks).alias("_carry"))
    df = df.join(F.broadcast(carry), [*lay.keys, BLOCK], "left")  # one row per block
    if how in ("max", "min"):
        total = (F.greatest if how == "max" else F.least)(F.col(out), F.col("_carry"))
    else:
        total = F.when(
            F.col(out).isNotNull() | F.col("_carry").isNotNull(),
            F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0)),
        )
    return lay.with_df(df.withColumn(out, total).drop("_value", "_carry"))


def with_halo(lay: Layout, rows: int) -> Layout:
    """Copy into each block the `rows` rows that precede it in its key."""
    if not lay.hot:
        return lay.with_df(lay.df.withColumn(HALO, F.lit(False)))
    cut = _cut_keys(lay)
    blocks = cut.groupBy(*lay.keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    by_block = Window.partitionBy(*lay.keys).orderBy(BLOCK)
    blocks = blocks.withColumn("_end", F.sum("_n").over(by_block))
    blocks = blocks.withColumn(
        "_next",
        F.collect_list(F.struct(F.col(BLOCK).alias("b"), (F.col("_end") - F.col("_n")).alias("before"))).over(
            by_block.rowsBetween(1, min(rows, _MAX_BLOCKS_PER_KEY))
        ),
    ).select(*lay.keys, BLOCK, "_end", "_next")
    last_first = Window.partitionBy(*lay.keys, BLOCK).orderBy(*[F.col(c).desc() for c in lay.order])
    tails = (
        cut.withColumn("_back", F.row_number().over(last_first))
        .where(F.col("_back") <= rows)
        .join(F.broadcast(blocks), [*lay.keys, BLOCK])  # one row per block
        .withColumn(
            "_to",
            F.explode(F.filter("_next", lambda x: F.col("_back") - 1 + x["before"] - F.col("_end") < rows)),
        )
        .withColumn(BLOCK, F.col("_to.b"))
        .drop("_back", "_end", "_next", "_to")
        .withColumn(HALO, F.lit(True))
    )
    return lay.with_df(lay.df.withColumn(HALO, F.lit(False)).unionByName(tails))


def with_halo_range(lay: Layout, width: Column | int | float, pos: Column) -> Layout:
    """Copy into each block the earlier rows of its key whose `pos` lies within
    `width` before the block's first `pos` (for range frames)."""
    if not lay.hot:
        return lay.with_df(lay.df.withColumn(HALO, F.lit(False)))
    width = width if isinstance(width, Column) else F.lit(width)
    df = _cut_keys(lay).withColumn("_pos", pos)
    starts = df.groupBy(*lay.keys, BLOCK).agg(F.min("_pos").alias("_start"))
    later = (
        Window.partitionBy(*lay.keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
    )
    starts = starts.withColumn(
        "_later", F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("_start").alias("s"))).over(later)
    ).select(*lay.keys, BLOCK, "_later").where(F.size("_later") > 0)
    copies = (
        df.join(F.broadcast(starts), [*lay.keys, BLOCK])  # one row per block
        .withColumn("_to", F.explode(F.filter("_later", lambda x: F.col("_pos") >= x["s"] - width)))
        .withColumn(BLOCK, F.col("_to.b"))
        .drop("_later", "_to", "_pos")
        .withColumn(HALO, F.lit(True))
    )
    return lay.with_df(lay.df.withColumn(HALO, F.lit(False)).unionByName(copies))


def drop_halo(lay: Layout) -> Layout:
    return lay.with_df(lay.df.where(~F.col(HALO)).drop(HALO))


def sorted_stretches(lay: Layout) -> DataFrame:
    """Rows hash-partitioned by (key, block) and sorted within the partition.

    For folds over a whole partition: many small keys share one pass.
    """
    return lay.df.repartition(*[F.col(c) for c in lay.parts]).sortWithinPartitions(*lay.parts, *lay.order)


def look_back(lay: Layout, rows: int, **columns: Callable[[WindowSpec], Column]) -> Layout:
    """Evaluate expressions whose window frames reach at most `rows` rows back.

    Each value of `columns` is called with the ordered window and returns a Column.
    """
    lay = with_halo(lay, rows)
    window = lay.window()
    df = lay.df
    for name, make in columns.items():
        df = df.withColumn(name, make(window))
    return drop_halo(lay.with_df(df))


def island_start(lay: Layout, is_start: Column, out: str) -> Layout:
    """Label each row with the order values of the last row where `is_start` held."""
    here = F.struct(*[F.col(c) for c in lay.order])
    return running(lay, F.when(is_start, here), "max", out)
