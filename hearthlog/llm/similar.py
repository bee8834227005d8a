"""Near-duplicates by the share of word runs in common, exact at any threshold.

Two texts link if their sets of runs of WORDS words have a Jaccard similarity
of at least SHARE. SimHash comes first: texts whose fingerprints are equal or
differ in few bits, as `simhash` finds them, are compared by their whole sets and
linked. Fingerprints of two linked texts may differ in more bits than can be
searched for, so what they leave is found exactly, and pairs in one group are
not compared again. Put in any one order, the first |x| - ceil(SHARE * |x|) + 1
runs of two linked sets have one in common (prefix filter), so only texts that
meet at such a run are compared, by their whole sets. The order decides the
work, never the result: runs of a fixed part of the hash space come first, rare
ones before others; then the rest; then runs common in a sample. A run that no
other text has cannot meet any and goes nowhere.

Where two texts first meet, what is left of both sets after their places in the
order bounds what they can share (positional filter). The smaller of two linked
sets has the meeting within its first |y| - 2 * SHARE / (1 + SHARE) * |y| runs: it is at
home there. A run where no text is at home links nothing, so texts that share
boilerplate and too little else cost no comparison. The others carry a parity
bitmap of their sets: two sets differ in at least as many runs as their bitmaps
do in bits (bitmap filter), so most pairs that are too different are not made.

Texts that meet at a run are compared with a few leaders first, and again only
if links have not connected them yet, so a large group of near copies costs
about its size and not its pairs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import checkpoint, small_side
from . import simhash
from .common import lookup, stored, whole, without
from .simhash import components

WORDS = 5
SHARE = (4, 5)
SEED = 42
# part of the hash space, in eighths, whose runs are counted over all texts
COUNTED = 2
# texts sampled for common runs, texts of the sample a run must be in, and most common runs
SAMPLE, OFTEN, MOST_COMMON = 20_000, 6, 100_000
# words of 64 bits of a set's parity bitmap
BITMAP = 8
# leaders of a run in the first round, and how many times more in each later one
LEADERS, MORE = 1, 8


def runs(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; a shorter text is one run."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts, stops = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist(), (ends[words - 1:] - 1).tolist()
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64).view(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of the runs hash to i."""
    odd = np.bincount((found.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_length(size: int, share: tuple[int, int] = SHARE) -> int:
    return size - -(-share[0] * size // share[1]) + 1


def alike(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    """Whether two sorted sets have at least `share` of their union in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int64)))


def _of_texts(texts: DataFrame, make: Callable[[str], tuple], schema: str) -> DataFrame:
    """node and what `make` gives for each text: numbers or arrays; a few texts in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                columns = [list(c) for c in zip(*(make(some.column(1)[i].as_py()) for i in range(some.num_rows)))]
                yield pa.RecordBatch.from_arrays([some.column(0), *(_lists(c) if isinstance(c[0], np.ndarray) else pa.array(c, pa.int32()) for c in columns)], names=["node", *names])

    return texts.select("node", "text").mapInArrow(run, f"node long, {schema}")


def sets_of(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, runs) of a frame of (node, text)."""
    return _of_texts(texts, lambda text: (runs(text, words),), "runs array<long>")


def common_runs(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes of the runs in many of the sampled texts of (node, text), rarest first."""
    rows = texts.select("node").count()
    some = texts.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < F.lit(min(1 << 20, (SAMPLE << 20) // max(rows, 1) + 1)))
    found = sets_of(some, words).select(F.explode("runs").alias("run")).groupBy("run").count().where(F.col("count") >= OFTEN)
    return found.orderBy(F.col("count").desc(), "run").limit(MOST_COMMON).toPandas()["run"].to_numpy(np.int64)[::-1]


def heads(texts: DataFrame, words: int, share: tuple[int, int], common: np.ndarray) -> DataFrame:
    """(node, size, counted, tail, bits): the runs of the counted part, as many of the others, in order, as a prefix may need, and the parity bitmap."""
    order = np.argsort(common)
    ordered = common[order]

    def make(text: str) -> tuple:
        found = runs(text, words)
        at = np.minimum(np.searchsorted(ordered, found), max(len(ordered) - 1, 0))
        often = ordered[at] == found if len(ordered) else np.zeros(len(found), bool)
        counted = ~often & ((found & 7) < COUNTED)
        tail = np.concatenate((found[~often & ~counted], common[np.sort(order[at[often]])] if often.any() else found[:0]))
        need = max(0, prefix_length(len(found), share) - int(counted.sum()))  # the counted runs come before it
        return len(found), found[counted], tail[:need], parities(found)

    return _of_texts(texts, make, "size int, counted array<long>, tail array<long>, bits array<long>")


def meetings(texts: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(run, node, size, bits, pos, home) where texts of a frame of distinct (node, text) can meet; each run has two rows or more, one of them at home.

    `pos` is the place of the run in the text's order.
    """
    found = checkpoint(heads(texts, words, share, common_runs(texts, words)))
    each = found.select("node", F.explode("counted").alias("run")).withColumn("texts", F.count("*").over(Window.partitionBy("run")))
    shared = each.where("texts > 1").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("texts", "run"))).alias("shared"))
    open_ones = found.select("node", "size", "tail", "bits", F.size("counted").alias("counted")).join(shared, "node", "left")
    seen = F.when(F.col("shared").isNull(), F.lit(0)).otherwise(F.size("shared"))
    length = F.col("size") - F.ceil(F.lit(share[0]) * F.col("size") / F.lit(share[1])).cast("int") + 1
    alone = F.col("counted") - seen  # the first runs in the order are those of this text alone
    in_order = F.concat(F.coalesce(F.col("shared.run"), F.array().cast("array<long>")), "tail")
    rows = open_ones.where(length > alone).select("node", "size", "bits", alone.alias("alone"), F.posexplode(F.slice(in_order, F.lit(1), F.greatest(length - alone, F.lit(1)))).alias("place", "run"))
    rows = rows.select("run", "node", "size", "bits", (F.col("alone") + F.col("place")).alias("pos"))
    rows = rows.withColumn("home", F.lit(sum(share)) * (F.col("size") - F.col("pos")) >= F.lit(2 * share[0]) * F.col("size"))
    met = rows.groupBy("run").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home").select("run")
    return checkpoint(rows.join(met, "run").select("run", "node", "size", "bits", "pos", "home"))


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of (node, text): equal fingerprints with one of their nodes, and enough to connect those that differ in few bits."""
    prints = checkpoint(simhash.fingerprints(texts, "node"))
    firsts = checkpoint(prints.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    equal = lookup(prints, firsts, ["fingerprint"], "n").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    node = lambda end: firsts.select(F.col("fingerprint").alias(end), F.col("first").alias(f"node_{end}"))
    near = simhash.links(firsts.select("fingerprint")).join(node("a"), "a").join(node("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return equal.unionByName(near)


def links(texts: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """Pairs (a, b) of nodes that are alike, enough to connect all that are; `texts` has one row (node, text) a node and gives the same rows when read twice."""
    state = meetings(texts, words, share)
    sets = checkpoint(sets_of(texts.join(small_side(checkpoint(state.select("node").distinct())), "node", "left_semi"), words))

    @pandas_udf(T.BooleanType())
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, share) for x, y in zip(a, b)], dtype=bool)

    differing = reduce(lambda x, y: x + y, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_a", F.lit(i)))) for i in range(BITMAP)])
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def alike_ones(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("runs_a")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("runs").alias("runs_b")), "b"))
        return both.where(verified("runs_a", "runs_b"))

    def joined(new: DataFrame) -> DataFrame:
        ends = stored(new.select(F.explode(F.array("a", "b")).alias("label")).distinct().select(F.col("label").alias("node"), F.col("label").alias("rank")))
        return components(ends, new).select(F.col("node").alias("label"), F.col("label").alias("joined"))

    found, leaders = stored(alike_ones(fingerprint_pairs(texts)).select("a", "b")), LEADERS
    state = state.join(small_side(joined(found)), state["node"] == F.col("label"), "left").select(
        "run", "node", "size", "bits", "pos", "home", F.coalesce("joined", "node").alias("label"))
    while True:
        of_run = Window.partitionBy("run")
        ends = [F.min("label").over(of_run).alias("low"), F.max("label").over(of_run).alias("high"), F.max("home").over(of_run).alias("any_home")]
        live = state.select("*", *ends).where("low <> high AND any_home")
        live = live.withColumn("same", F.count("*").over(Window.partitionBy("run", "label")))
        turn = F.row_number().over(of_run.orderBy(F.col("home").desc(), "same", "label", F.xxhash64("node")))  # one leader for many runs
        live = checkpoint(live.select("run", "node", "size", "bits", "pos", "home", "label", turn.alias("turn")))
        if live.isEmpty():
            return stored(found.repartition(parts))
        first = live.where((F.col("turn") <= leaders) & F.col("home")).select("run", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"), F.col("pos").alias("pos_a"), F.col("label").alias("label_a"), F.col("turn").alias("turn_a"))
        pairs = first.join(live, "run").where((F.col("label") != F.col("label_a")) & (F.col("turn") > F.col("turn_a"))
                                              & (share[1] * F.least("size", "size_a") >= share[0] * F.greatest("size", "size_a"))
                                              & (sum(share) * F.least(F.col("size") - F.col("pos"), F.col("size_a") - F.col("pos_a")) >= share[0] * (F.col("size") + F.col("size_a")))
                                              & (sum(share) * differing <= (share[1] - share[0]) * (F.col("size") + F.col("size_a"))))
        low = F.col("a") < F.col("node")
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.when(low, F.col("label_a")).otherwise(F.col("label")).alias("label_a"),
                             F.when(low, F.col("label")).otherwise(F.col("label_a")).alias("label_b")).distinct()
        # a label is a node of its group, so links of labels connect the same groups
        new = alike_ones(pairs).select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()
        new = stored(new)
        state = stored(live.where(F.col("turn") > leaders).join(joined(new), "label", "left")
                        .select("run", "node", "size", "bits", "pos", "home", F.coalesce("joined", "label").alias("label")))
        found = found.unionByName(new)
        leaders *= MORE


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of `docs`, with all their columns, that have the smallest key of their group of linked texts.

    Rows with a null key stay, as nothing names them, and do not name a group.
    Rows that share the smallest key stay together. Null texts equal the empty
    text. No rows give no rows.
    """
    seed = 0
    while True:  # until no two texts share a number
        named = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")).withColumn("node", F.xxhash64("text", F.lit(seed)))
        marked = checkpoint(named.select("key", "node", F.xxhash64("text", F.lit(seed), F.lit("other")).alias("other")))
        nodes = checkpoint(marked.groupBy("node").agg(F.min("key").alias("rank"), F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b")))
        if nodes.where("a <> b").isEmpty():
            break
        seed += 1
    marked, nodes = marked.drop("other"), nodes.drop("a", "b")
    texts = named.select("node", "text")
    found = links(texts if nodes.where("n > 1").isEmpty() else texts.dropDuplicates(["node"]), words, share)
    last = F.lit((1 << 63) - 1)  # a null rank must not win: it sorts first in a struct
    reached = components(nodes.select("node", F.coalesce("rank", last).alias("rank")), found)
    group = checkpoint(nodes.join(reached, "node", "left").select("node", F.coalesce(F.nullif("label", last), "rank").alias("first"), "n"))
    losers = checkpoint(lookup(marked, group, ["node"], "n").where("key <> first").select(F.col("key").alias(key)).distinct())
    return without(docs, losers, key).select(*[F.col(f"`{c}`") for c in docs.columns])
