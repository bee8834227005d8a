"""Sharding by balanced label propagation under row quotas.

Documents of equal text are linked. All start dealt evenly over the shards; in
each round every group of linked documents pulls its members towards the shard
where most of them are, as far as that shard's quota has room beside the groups
settled there. Propagation works on (group, shard) counts, so a group that
holds a third of all rows is one row of 24 counts. Unlinked documents cost no cut edge wherever they are: they fill up what
the quotas leave, which makes the counts exact.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint
from .common import ranked, stored, whole, with_uid

SHARDS = 24
# Proposals to a shard are admitted in the order of these classes: larger
# groups first, equal ones in hash order.
SLICES = 64


def quotas(spark: SparkSession, rows: int, shards: int = SHARDS) -> DataFrame:
    """(shard, quota): counts at most one apart that add up to `rows`."""
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(rows // shards) + F.when(F.col("id") < rows % shards, 1).otherwise(0)).cast("long").alias("quota"))


def propagated(counts: DataFrame, quota: DataFrame) -> DataFrame:
    """(group, shard, n) after label propagation; `counts` has the same columns and fits the quotas.

    Room is the quota less the groups settled there, so groups not settled yet
    give way to each other. A group larger than any quota fills whole shards
    first. Then a round proposes, for each open group, the shard with most of
    its members among those with room for all of it, or else any with room, by
    hash. Proposals are admitted up to the room, and the first always is, so
    every round settles some. Rounds end when no open group fits a shard: those
    are fewer than the shards and are cut over the largest rooms.
    """
    room = {r.shard: r.quota for r in quota.collect()}  # one entry a shard
    member = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")
    state = stored(counts.groupBy("group").agg(F.sum("n").alias("size"), F.collect_list(member).alias("members")))
    placed: list[tuple[str, int, int]] = []

    def fill(group: str, size: int, members: list, least: int = 0) -> int:
        """Puts members into the largest rooms, near most of them, while more than `least` or the largest room are left."""
        near = {m.shard: m.n for m in members}
        while size > 0 and (size >= max(room.values()) or not least):
            shard = max(room, key=lambda s: (room[s], near.get(s, 0), -s))
            taken = min(size, room[shard])
            room[shard] -= taken
            size -= taken
            placed.append((group, shard, taken))
        return size

    over = state.where(F.col("size") > max(room.values(), default=0)).collect()  # fewer than the shards
    size = F.col("size")
    for g in sorted(over, key=lambda g: (-g["size"], g.group)):
        size = F.when(F.col("group") == g.group, F.lit(fill(g.group, g["size"], g.members, 1))).otherwise(size)
    state = state.withColumn("size", size.cast("long")).where("size > 0")
    parts = []
    while True:
        rooms = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(n).cast("long").alias("room")) for s, n in sorted(room.items())])
        fits = F.transform(F.filter(rooms, lambda r: r["room"] >= F.col("size")), lambda r: r["shard"])
        state = state.withColumn("fits", fits)
        best = F.array_max(F.filter("members", lambda m: F.array_contains("fits", m["shard"])))["shard"]
        other = F.when(F.size("fits") > 0, F.element_at("fits", (F.pmod(F.xxhash64("group"), F.greatest(F.size("fits"), F.lit(1))) + 1).cast("int")))
        asks = state.withColumn("target", F.coalesce(best, other)).withColumn(
            "slice", (63 - F.least(F.floor(F.log2("size")), F.lit(63))) * SLICES + F.pmod(F.xxhash64("group"), F.lit(SLICES)))
        asks = stored(asks.select("group", "size", "members", "target", "slice"))
        moving = asks.where("target IS NOT NULL")
        if moving.isEmpty():
            break
        sums = moving.groupBy("target", "slice").agg(F.sum("size").alias("m"))  # at most 64 * SLICES rows a shard
        before = Window.partitionBy("target").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("target", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("earlier"))
        inside = Window.partitionBy("target", "slice").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("earlier") + F.sum("size").over(inside)
        decided = moving.join(F.broadcast(sums), ["target", "slice"]).withColumn("settles", upto <= F.element_at(rooms, F.col("target") + 1)["room"])
        decided = stored(decided.select("group", "size", "members", "target", "settles"))
        parts.append(decided.where("settles").select("group", F.col("target").alias("shard"), F.col("size").alias("n")))
        for r in parts[-1].groupBy("shard").agg(F.sum("n").alias("n")).collect():
            room[r.shard] -= r.n
        state = decided.where("NOT settles").select("group", "size", "members").unionByName(asks.where("target IS NULL").select("group", "size", "members"))
    for g in sorted(asks.collect(), key=lambda g: (-g["size"], g.group)):  # each larger than any room, so fewer than the shards
        fill(g.group, g["size"], g.members)
    if placed:
        cut = [F.struct(F.lit(g).alias("group"), F.lit(s).alias("shard"), F.lit(n).cast("long").alias("n")) for g, s, n in placed]
        parts.append(counts.sparkSession.range(1).select(F.explode(F.array(*cut)).alias("p")).select("p.*"))
    every = counts.select("group", "shard", "n").limit(0)
    for part in parts:
        every = every.unionByName(part)
    return stored(every.groupBy("group", "shard").agg(F.sum("n").alias("n")))


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of `docs`: key, size, text_crc32, law, shard, slot, grown_shard, linked.

    Counts by shard are at most one apart (law `rows`); slots are gapless from
    0 in a shard. size is the text's UTF-8 bytes plus 8, a null text has none
    and equals the empty one. Null and repeated keys are rows like any other.
    Fewer rows than shards leave shards empty; no rows give no rows.
    """
    content = whole(F.col(text))
    docs = docs.select(F.col(key).alias("key"), (F.octet_length(content) + 8).cast("long").alias("size"),
                       F.crc32(content.cast("binary")).alias("crc"), F.sha2(content, 256).alias("digest"))
    base = with_uid(docs, "bucket")
    spark, rows = docs.sparkSession, base.count()
    base = ranked(base.withColumn("all", F.lit(0)), ["all"], "bucket", ["__uid"], "deal").withColumn("start", F.pmod("deal", F.lit(shards)).cast("int"))
    base = checkpoint(base.select("__uid", "bucket", "key", "size", "crc", "digest", "start"))

    # counts by (digest, bucket) tell which rows are linked, no digest meeting in one task
    blocks = base.groupBy("digest", "bucket").agg(F.count("*").alias("n"))
    linked = F.sum("n").over(Window.partitionBy("digest")) > 1
    blocks = checkpoint(blocks.withColumn("group", F.when(linked, F.col("digest")).otherwise("")))
    grouped = base.groupBy("digest", "start").agg(F.count("*").alias("n"))
    grouped = grouped.withColumn("total", F.sum("n").over(Window.partitionBy("digest"))).where("total > 1")
    quota = checkpoint(quotas(spark, rows, shards))
    settled = propagated(grouped.select(F.col("digest").alias("group"), F.col("start").alias("shard"), "n"), quota)
    loads = settled.groupBy("shard").agg(F.sum("n").alias("load"))
    free = quota.join(loads, "shard", "left").select(F.lit("").alias("group"), "shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("n"))

    # places of a group: [low, high) of its members for each shard, and the first place of each of its blocks
    upto = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = settled.unionByName(free).withColumn("high", F.sum("n").over(upto)).withColumn("low", F.col("high") - F.col("n")).where("n > 0")
    sums = blocks.groupBy("group", "bucket").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    parts = (firsts.join(ranges.drop("n"), "group").where("low < first + n AND high > first")
             .select("group", "bucket", "first", "low", "high", "shard"))
    rank = F.row_number().over(Window.partitionBy("group", "bucket").orderBy("__uid")) - 1
    placed = (base.join(blocks.select("digest", "bucket", "group"), ["digest", "bucket"]).withColumn("rank", rank)
              .join(parts, ["group", "bucket"]).where("first + rank >= low AND first + rank < high"))
    placed = checkpoint(placed.select("__uid", "bucket", "key", "size", "crc", "shard", (F.col("group") != "").alias("linked")))
    return ranked(placed, ["shard"], "bucket", ["__uid"], "slot").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "linked")
