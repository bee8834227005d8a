"""Top rows, exact ranks, budgets, seeded samples and splits."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint
from .ordered import layout, running

SORT_LIMIT_ROWS = 1_000  # largest n answered by a sort-and-limit, which hands n rows of every task to one
GROUP_LIMIT_ROWS = 1_000  # default of spark.sql.optimizer.windowGroupLimitThreshold
_SLICES = 64


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; a per-partition heap, no global sort."""
    return df.orderBy(*order).limit(n)


def seeded(seed: int | str, *columns: str) -> Column:
    """Reproducible pseudo-random order key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def top_per_group(df: DataFrame, groups: list[str], n: int, *order: Column) -> DataFrame:
    """First n rows of each group with `rank`; groups are cut before the shuffle.

    The optimizer cuts groups in the map tasks only for small n. A larger n gets
    a first cut within slices of each group, so that no task sorts a whole group.
    """
    if n > GROUP_LIMIT_ROWS:
        sliced = Window.partitionBy(*groups, "_slice").orderBy(*order)
        df = df.withColumn("_slice", F.spark_partition_id() % _SLICES).withColumn("_in", F.row_number().over(sliced))
        df = df.where(F.col("_in") <= n).drop("_slice", "_in")
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_wins(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order. Copies are dropped inside each
    map task before the shuffle, so a key with many copies stays cheap."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def numbered(df: DataFrame, order: list[str], out: str, rows_per_block: int | None = None) -> DataFrame:
    """Position from 1 in a global order, without sorting everything in one task."""
    lay = running(layout(df, [], order, rows_per_block), F.lit(1).cast("long"), "sum", out)
    return lay.done()


def seeded_sample(df: DataFrame, n: int, seed: int | str, ids: list[str]) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by the seeded order of `ids`.

    A large sample is cut by a threshold: counts by the leading hex digits of
    the order key find the digits in which row n lies, digit by digit, and a
    filter takes what is below. Only rows that share those digits are sorted.
    """
    ordered = df.withColumn("_pick", seeded(seed, *ids))
    order = [F.col("_pick"), *[F.col(c) for c in ids]]
    if n <= SORT_LIMIT_ROWS:
        return top_rows(ordered, n, *order).drop("_pick")
    digits, left, inside = "", n, None
    while len(digits) < 32 and (inside is None or inside > SORT_LIMIT_ROWS):
        width = len(digits) + 3
        cells = ordered.where(F.startswith("_pick", F.lit(digits))).groupBy(F.left("_pick", F.lit(width)).alias("cell")).count().collect()  # at most 4096
        for cell, inside in sorted(map(tuple, cells)):
            if inside > left:
                break
            left -= inside
        else:  # no more rows than asked for
            return df
        digits = cell
    rest = top_rows(ordered.where(F.startswith("_pick", F.lit(digits))), left, *order)
    return ordered.where(F.col("_pick") < digits).unionByName(rest).drop("_pick")


def within_budget(
    df: DataFrame, order: list[str], cost: Column, budget: int, min_cost: int
) -> DataFrame:
    """Rows in order while the running cost stays within the budget.

    Every row costs at least `min_cost` > 0, so the answer lies in the first
    budget // min_cost rows. If those are few only they are sorted; otherwise
    the order is cut into blocks whose costs carry over.
    """
    priced = df.withColumn("cost", cost)
    if budget // min_cost > SORT_LIMIT_ROWS:
        lay = running(layout(priced, [], order), F.col("cost"), "sum", "used")
        return lay.done(lay.df.where(F.col("used") <= budget))
    head = top_rows(priced, budget // min_cost, *[F.col(c) for c in order])
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def until_cap(
    df: DataFrame, order: list[str], size: Column, cap: int | float, rows_per_block: int | None = None
) -> DataFrame:
    """Rows in order that start while the sizes before them sum to less than `cap`."""
    lay = layout(df, [], order, rows_per_block)
    lay = running(lay, size, "sum", "before", inclusive=False)
    return lay.done(lay.df.withColumn("before", F.coalesce("before", F.lit(0))).where(F.col("before") < cap))


def exact_rank(
    df: DataFrame,
    key: str,
    value: str,
    rank_of: Callable[[Column], Column],
    min_rows: int = 1,
    widths: tuple[int, ...] = (86_400_000_000, 1_000_000, 1),
) -> DataFrame:
    """(key, value): the exact element at 0-based rank `rank_of(n)` of each key's values.

    Histograms from coarse to fine: each level counts bucket sizes with a
    partial aggregate and follows only the bucket that holds the rank. No key's
    values are gathered, whatever their number.
    """

    def level(rows: DataFrame, width: int, keys: list[str], target: Callable[[DataFrame], DataFrame]) -> DataFrame:
        bucket = F.floor(F.col(value) / F.lit(width)).cast("long") if width > 1 else F.col(value)
        hist = rows.groupBy(*keys, bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")
        )
        by_key = Window.partitionBy(key)
        hist = target(hist.withColumn("_total", F.sum("_n").over(by_key)))
        upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_upto", F.sum("_n").over(upto))
        return hist.where(
            (F.col("_upto") - F.col("_n") <= F.col("_target")) & (F.col("_target") < F.col("_upto"))
        ).withColumn("_left", F.col("_target") - (F.col("_upto") - F.col("_n")))

    rows = df.select(key, value)
    picked = checkpoint(level(
        rows, widths[0], [key],
        lambda h: h.where(F.col("_total") >= min_rows).withColumn("_target", rank_of(F.col("_total")).cast("long")),
    ))  # one row for each key
    answers = picked.where(F.col("_min") == F.col("_max")).select(key, F.col("_min").alias("value"))
    for coarse, fine in zip(widths, widths[1:]):
        open_ = picked.where(F.col("_min") < F.col("_max")).select(key, F.col("_b").alias("_in"), F.col("_left"))
        if open_.isEmpty():
            break
        inside = rows.withColumn("_in", F.floor(F.col(value) / F.lit(coarse)).cast("long")).join(open_, [key, "_in"])
        picked = checkpoint(
            level(inside, fine, [key, "_left"], lambda h: h.withColumn("_target", F.col("_left")).drop("_left"))
        )
        answers = answers.unionByName(
            picked.where(F.col("_min") == F.col("_max")).select(key, F.col("_min").alias("value"))
        )
    return answers


def split_by_group(
    examples: DataFrame, group: str, fraction: float = 0.05, seed: int | str = 17,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add `split`: whole groups go to eval until it holds `fraction` of the rows.

    A group larger than the eval target never enters eval.
    """
    sizes = examples.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    target = total * fraction
    eligible = sizes.where(F.col("_size") <= target).withColumn("_order", seeded(seed, group))
    chosen = until_cap(eligible, ["_order", group], F.col("_size"), target, rows_per_block).select(
        group, F.lit("eval").alias("split")
    )
    return examples.join(chosen, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def new_and_replay(
    examples: DataFrame, since: str, ids: list[str], ratio: float = 0.3, seed: int | str = 17
) -> DataFrame:
    """Examples from `since` on, plus a seeded sample of older ones; empty when none is new."""
    is_new = F.coalesce(F.col("last_ts") >= F.lit(since), F.lit(False))
    n_new = examples.where(is_new).count()
    n_replay = int(n_new * ratio / max(1e-9, 1 - ratio))
    new = examples.where(is_new).withColumn("replayed", F.lit(False))
    if n_replay == 0:
        return new
    replay = seeded_sample(examples.where(~is_new), n_replay, seed, ids)
    return new.unionByName(replay.withColumn("replayed", F.lit(True)))


def balanced_sample(
    messages: DataFrame, group: str, ids: list[str], n: int = 400, share: float = 0.15, seed: int | str = 7
) -> DataFrame:
    """Round-robin over the groups, at most max(5, share*n) rows of each, n in all."""
    cap = max(5, int(n * share))
    keyed = messages.withColumn("_pick", seeded(seed, *ids))
    ranked = top_per_group(keyed, [group], cap, F.col("_pick"), *[F.col(c) for c in ids])
    out = top_rows(ranked.withColumn("_turn", seeded(seed, group)), n, F.col("rank"), F.col("_turn"), F.col(group))
    return out.drop("_pick", "_turn")


def coverage_first(
    df: DataFrame, combos: list[tuple], columns: list[str], ids: list[str], seed: int | str = 0,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add `position`: the first row of each required combination in the required
    order, then all other rows in seeded order."""
    spark = df.sparkSession
    types = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns)
    wanted = spark.createDataFrame([(*c, i) for i, c in enumerate(combos)], types + ", _rank int")
    heads = (
        df.join(F.broadcast(wanted), columns)  # the caller's fixed list of combinations
        .groupBy("_rank").agg(F.min(F.struct(*ids)).alias("_head"))
        .select(*[F.col(f"_head.{c}").alias(c) for c in ids], "_rank")
    )
    marked = df.join(F.broadcast(heads), ids, "left").withColumn("_rank", F.coalesce("_rank", F.lit(len(combos))))
    mixed = marked.withColumn("_pick", F.when(F.col("_rank") < len(combos), F.lit("")).otherwise(seeded(seed, *ids)))
    return numbered(mixed, ["_rank", "_pick", *ids], "position", rows_per_block).drop("_rank", "_pick")
