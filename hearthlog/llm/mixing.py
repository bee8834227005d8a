"""Mixing sources to target weights: repetition rates by source, copies by a hash-seeded draw."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint
from .common import lookup, word_count

# Fixed values of the mix: weights by the order of the sources, the share of
# all sizes to emit, and the most often that a source may be repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix"
# Draws tried for each source. Each is a Bernoulli draw by document; the one
# whose total comes nearest to the target is used.
DRAWS = 25


def _source_key(source: Column) -> list[Column]:
    return [source.isNull().alias("__none"), F.coalesce(source, F.lit("")).alias("__source")]


def _ordered(sources: DataFrame) -> DataFrame:
    """The sources with their place in code point order (null last), by a range-partitioned sort."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = checkpoint(sources.orderBy("__none", "__source").withColumn("__part", F.spark_partition_id()).withColumn("__place", place))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each sorted partition
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(parts, "__part").withColumn("place", F.col("__place") + F.col("__before"))


def draw(key: Column, k: Column, seed: str = SEED) -> Column:
    """The k-th of DRAWS numbers in [0, 1) that seed and key decide: eight hex digits of one MD5."""
    digits = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digits, k + 1, F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def _copies(k: Column, seed: str) -> Column:
    """floor(rate), and one copy more with a probability of the rest."""
    return F.col("base") + F.when(draw(F.col("key"), k, seed) < F.col("part"), 1).otherwise(0)


def rates(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """One stored row per source of a stored (key, __none, __source, size): size, target, rate and the draw to use.

    Targets are weight shares of `share` times all sizes; a target above `most`
    times its source is cut to that and the excess shared again by weight
    until none is above. Only sums pass through the driver.
    """
    by_source = _ordered(sizes.groupBy("__none", "__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    table = checkpoint(by_source.select("__none", "__source", "source_size", "n_rows", F.get(pattern, F.pmod("place", F.lit(len(weights)))).alias("weight")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(float(most)) <= F.lit(level) * F.col("weight")
        sums = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if sums[0] == capped or not sums[2]:
            break
        capped, level = sums[0], (share * total - float(sums[1] or 0)) / sums[2]
    target = F.when(full, F.col("source_size") * F.lit(float(most))).otherwise(F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = table.withColumn("target", target).withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    table = checkpoint(table)
    tried = lookup(sizes, table.select("__none", "__source", "base", "part", "n_rows"), ["__none", "__source"], "n_rows", "inner").groupBy("__none", "__source").agg(
        *[F.sum(F.col("size") * _copies(F.lit(k), seed)).alias(f"t{k}") for k in range(DRAWS)])
    off = F.least(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])["k"]
    return checkpoint(table.join(tried, ["__none", "__source"]).select(*table.columns, off.alias("draw")))


def _with_copies(keyed: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    return lookup(keyed, table, ["__none", "__source"], "n_rows", "inner").withColumn("copies", _copies(F.col("draw"), seed))


def _sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return checkpoint(docs.select(F.col(key).alias("key"), *_source_key(F.col(source)), word_count(F.col(text)).alias("size")))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, copies.

    A document is emitted floor(rate) times and once more with a probability
    equal to the rest, so never more than twice. Rows with equal keys draw
    alike; a null key draws like an empty one; a null source is a source of
    its own, last in order. Null texts have size 0. A source of size 0 takes
    nothing. No rows give no rows.
    """
    sizes = _sizes(docs, key, text, source)
    return _with_copies(sizes, rates(sizes, seed=seed), seed).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix with all their columns, each as often as `plan` takes it."""
    table = rates(_sizes(docs, key, text, source), seed=seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(key).alias("key"), *_source_key(F.col(source)))
    return (_with_copies(packed, table, seed).where("copies > 0")
            .select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*"))
