"""Near-duplicates by 64-bit SimHash, met at the anchor points of a covering code.

The anchors are the words of the [63, 57] Hamming code with the 64th bit free:
every fingerprint has an anchor within R = 1 bit. Two fingerprints at most t
bits apart have a point between them at most ceil(t / 2) bits from either, so
both lie within R + ceil(t / 2) of that point's anchor. Fingerprints are
replicated to every anchor in that reach, 33 of 2 ** 58 for t = 2, and compared
anchor by anchor. Reaching out to R + t would find the same links with 683
replicas. An anchor sees at most 2081 different fingerprints however often
each occurs, so no anchor is hot.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import checkpoint
from .common import lookup, without

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
# hashes whose bits are counted at a time, whatever the length of the text
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one whole text; a bit is 1 if set in over half the shingle hashes. No words: 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    n, ones, hashed = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # byte sums that cannot overflow
            ones += np.add.reduce(bits[part:part + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("id"), _fingerprints(F.col(text)).alias("fingerprint"))


_SYNDROME = [sum(1 << (i - 1) for i in range(1, 64) if i >> b & 1) for b in range(6)]  # bit i - 1 is place i of the code
_PAIRS = [[(i, i ^ s) for i in range(1, 64) if i < i ^ s] for s in range(64)]
_FLIPS = np.array([[(1 << (i - 1)) | (1 << (j - 1)) for i, j in _PAIRS[s]][:31] if s else [0] * 31 for s in range(64)], np.uint64)


def anchors_of(prints: np.ndarray) -> list[np.ndarray]:
    """All anchors within R + ceil(MOST_BITS / 2) = 2 bits of each fingerprint."""
    syndrome = np.zeros(len(prints), np.uint64)
    for b, places in enumerate(_SYNDROME):
        syndrome |= (np.bitwise_count(prints & np.uint64(places)).astype(np.uint64) & np.uint64(1)) << np.uint64(b)
    off = syndrome > 0
    nearest = np.where(off, prints ^ (np.uint64(1) << np.where(off, syndrome - np.uint64(1), np.uint64(0))), prints)
    around = prints[:, None] ^ _FLIPS[syndrome.astype(np.int64)]
    free = np.uint64(1 << 63)
    return [np.concatenate(([c, c ^ free], more)) if o else np.array([c, c ^ free]) for c, more, o in zip(nearest, around, off)]


@pandas_udf(T.ArrayType(T.LongType()))
def _anchors(prints: pd.Series) -> pd.Series:
    return pd.Series([a.view(np.int64) for a in anchors_of(prints.to_numpy(np.int64).view(np.uint64))])


def spanning_links(members: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that connect what `most` differing bits connect among the fingerprints of one anchor."""
    values = members.view(np.uint64)
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(1, len(values)):
        for j in np.nonzero(np.bitwise_count(values[:i] ^ values[i]) <= most)[0].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(members[i]), int(members[j])))
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def _links(groups: pd.Series) -> pd.Series:
    return pd.Series([spanning_links(np.asarray(g, np.int64)) for g in groups])


def links(prints: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a frame of distinct fingerprints, enough to connect all that link."""
    # dealt out anew, as each small row becomes many
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_anchor = prints.repartition(parts, "fingerprint").select("fingerprint", F.explode(_anchors("fingerprint")).alias("anchor")).groupBy("anchor").agg(F.collect_list("fingerprint").alias("members"))
    found = at_anchor.where(F.size("members") > 1).select(F.explode(_links("members")).alias("l"))
    return found.select(F.least("l.a", "l.b").alias("a"), F.greatest("l.a", "l.b").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of stored `nodes` that `edges` (a, b) touch: the smallest `rank` reachable.

    `nodes` has node and rank. Each round takes the least label of the
    neighbours and then the label of the label, so paths halve. Labels are
    stored every round.
    """
    both = checkpoint(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    state = checkpoint(nodes.join(both.select("node").distinct(), "node").select("node", F.struct("rank", "node").alias("label")))
    while True:
        near = both.join(state.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        hooked = state.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        of_label = state.select(F.col("node").alias("at"), F.col("label").alias("above"))
        jumped = hooked.join(of_label, F.col("label.node") == F.col("at")).select("node", "old", F.least("label", "above").alias("label"))
        jumped = checkpoint(jumped)
        if jumped.where("old <> label").isEmpty():
            return jumped.select("node", F.col("label.rank").alias("label"))
        state = jumped.select("node", "label")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, fingerprint (long), component_id.

    component_id is the smallest key reachable over links of at most MOST_BITS
    bits, itself included; null keys are passed over and a component of null
    keys only has null. Null and empty texts have fingerprint zero and link
    like any other. Equal fingerprints are one node. No rows give no rows.
    """
    marked = checkpoint(fingerprints(docs, key, text))
    nodes = checkpoint(marked.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("rank"), F.count("*").alias("n")))
    # a null rank must not win: it sorts first in a struct
    ranked = nodes.select("node", F.coalesce("rank", F.lit((1 << 63) - 1)).alias("rank"))
    found = checkpoint(links(nodes.select(F.col("node").alias("fingerprint"))))
    reached = components(ranked, found)
    label = F.coalesce(F.nullif("label", F.lit((1 << 63) - 1)), "rank")
    named = checkpoint(nodes.join(reached, "node", "left").select(F.col("node").alias("fingerprint"), label.alias("component_id"), "n"))
    return lookup(marked, named, ["fingerprint"], "n").select(F.col("id").alias(key), "fingerprint", "component_id")


def hex_print(fingerprint: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their component: those with its smallest key.

    Rows with a null key stay, as nothing names them. Rows that share the
    smallest key stay together: to this operator they are one document.
    """
    losers = checkpoint(classes(docs, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct())
    return without(docs, losers, key).select(*[F.col(f"`{c}`") for c in docs.columns])
