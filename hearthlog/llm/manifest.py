"""Merkle manifest of a dataset by time-forward processing, and its membership proofs.

A tree's nodes are labelled by level and index, so a label is larger than those
of all nodes below it. Digests travel as messages to the label of the parent,
which reads them in label order: forward in time. The queue is external: bands of
HEIGHT levels wait in Spark's sorted shuffle, which spills, and a heap of at most
2 ** (HEIGHT + 1) messages orders the labels of one block inside a task. A second
sweep goes through the labels in reverse and delivers to every node the steps of
the proof above it, down to the leaves. No task holds a tree or a level.

The leaves of each value of `part` are one tree; the roots of these trees, in
order of the value, are the leaves of one more.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint, small_side

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# levels that one pass goes up or down, and rows of a task of a pass over few nodes
HEIGHT, ROWS_PER_TASK = 6, 4096
NODE = "tree string, n long, pos long, digest string"


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value is `-` if null, else its UTF-8 byte count, a colon and itself."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def forward(leaves: list[str], levels: int) -> list[list[str]]:
    """Digests by level, the leaves' first: messages to labels (level, index), taken in label order."""
    queue = [((1, i // 2), i, d) for i, d in enumerate(leaves)] if levels else []
    heapify(queue)
    out = [list(leaves)] + [[] for _ in range(levels)]
    while queue:
        label, _, text = heappop(queue)
        while queue and queue[0][0] == label:
            text += heappop(queue)[2]
        level, index = label
        digest = _hash(text)
        out[level].append(digest)
        if level < levels:
            heappush(queue, ((level + 1, index // 2), index, digest))
    return out


def backward(digests: list[list[str]], above: list[str]) -> list[list[str]]:
    """The steps from each leaf up: `L` or `R` and the digest of the sibling on that side, `.` where there is none, then `above`."""
    top = len(digests) - 1
    queue = [((-top, 0), above)]  # labels in reverse
    out: list[list[str]] = [[] for _ in digests[0]]
    while queue:
        (level, index), steps = heappop(queue)
        level, index = -level, -index
        if not level:
            out[index] = steps
            continue
        pair = range(2 * index, min(2 * index + 2, len(digests[level - 1])))
        for child in pair:
            own = "." if len(pair) == 1 else ("L" if child % 2 else "R") + digests[level - 1][child ^ 1]
            heappush(queue, ((1 - level, -child), [own, *steps]))
    return out


def levels_of(n: int, height: int) -> int:
    """Levels that a pass goes up in a tree that has `n` nodes where it starts."""
    return min(height, max(n - 1, 0).bit_length())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (tree, block) after another, from batches in their order."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for row in batch.slice(at, 512).to_pylist():
                if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _queued(nodes: DataFrame, rows: int) -> DataFrame:
    """Messages in the order of their labels, those of a block together."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(min(parts, rows // ROWS_PER_TASK + 1), "tree", "block").sortWithinPartitions("tree", "block", "slot")


def _placed(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height)).withColumn("slot", F.col("pos").bitwiseAND(F.lit((1 << height) - 1)))


def _rise(nodes: DataFrame, height: int, rows: int) -> DataFrame:
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for block in _blocks(batches):
                first = block[0]
                top = forward([r["digest"] for r in block], levels_of(first["n"], height))[-1]
                yield {"tree": first["tree"], "n": (first["n"] + (1 << height) - 1) >> height, "pos": first["block"], "digest": top[0]}

        yield from _batched(rows(), schema)

    placed = _placed(nodes.select("tree", "n", "pos", "digest"), height)
    return checkpoint(_queued(placed, rows).mapInArrow(run, NODE))


def _fall(nodes: DataFrame, above: DataFrame, height: int, rows: int) -> DataFrame:
    """Nodes (with `carried`) and their steps; `above` has the steps of the roots of their blocks."""
    carried = nodes.schema["carried"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("carried").type
        schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("carried", kind), ("steps", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def rows() -> Iterator[dict]:
            for head, *block in _blocks(again()):
                for row, steps in zip(block, backward(forward([r["digest"] for r in block], levels_of(block[0]["n"], height)), head["steps"])):
                    yield {"tree": row["tree"], "pos": row["pos"], "digest": row["digest"], "carried": row["carried"], "steps": steps, "subroot": head["subroot"], "root": head["root"]}

        yield from _batched(rows(), schema)

    no_text = F.lit(None).cast("string")
    children = _placed(nodes, height).select("tree", "block", "slot", "n", "pos", "digest", "carried", F.lit(None).cast("array<string>").alias("steps"), no_text.alias("subroot"), no_text.alias("root"))
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("pos"),
                         no_text.alias("digest"), F.lit(None).cast(nodes.schema["carried"].dataType).alias("carried"), "steps", "subroot", "root")
    out = f"tree string, pos long, digest string, carried {carried}, steps array<string>, subroot string, root string"
    return _queued(children.withColumn("slot", F.col("slot").cast("long")).unionByName(heads), rows).mapInArrow(run, out)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows with pos, their place from 0 within `tree` in the order of `order`, and n, the tree's rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = checkpoint(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    counts = checkpoint(dealt.groupBy("tree", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")))
    of_tree = Window.partitionBy("tree")
    before = F.sum("__n").over(of_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("tree", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(of_tree).alias("n"))
    joined = dealt.join(small_side(checkpoint(shifts)), ["tree", "__part"])
    return joined.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def sweep(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored nodes of each band of a forest of stored `leaves` (tree, n, pos, digest), and the roots (tree, digest)."""
    most, rows = leaves.agg(F.max("n"), F.count("*")).first()
    bands, most = [leaves], most or 0
    while most > 1:
        bands.append(_rise(bands[-1], height, rows))
        most, rows = (most + (1 << height) - 1) >> height, rows >> height
    return bands[:-1] or bands, bands[-1].select("tree", "digest")


def _descend(bands: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    for depth, nodes in enumerate(reversed(bands)):
        if "carried" not in nodes.columns:
            nodes = nodes.withColumn("carried", F.lit(None).cast("int"))
        below = _fall(nodes, above, height, nodes.count())
        above = below if depth == len(bands) - 1 else checkpoint(below)
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", part: str = "lang", height: int = HEIGHT, extra: Column | None = None) -> DataFrame:
    """One row per row of `docs`: key, leaf, subroot, root, proof and, if given, extra.

    `proof` lists the steps from the leaf to the root: `L` or `R` and the
    sibling's digest, or `.` where a node has none. Leaves of a part ascend by
    key, a null key first; rows that share a key, by digest. Rows of a null part
    are a tree of their own, the first. A tree of one leaf is that leaf. No
    rows give no rows. Columns other than `fields` are not read.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit(""))  # null sorts first
    carried = F.struct(F.col(key).alias("key"), *([extra.alias("extra")] if extra is not None else []))
    rows = checkpoint(docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), carried.alias("carried")))
    leaves = checkpoint(numbered(rows, ["key", "digest"]).drop("key"))
    bands, subroots = sweep(leaves, height)
    parts = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest")
    tops = checkpoint(numbered(checkpoint(parts), ["part"]).withColumn("carried", F.col("part")).drop("part"))
    top_bands, root = sweep(tops, height)
    start = root.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = checkpoint(_descend(top_bands, start, height)).select(F.col("carried").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot"), "root")
    found = _descend(bands, above, height)
    return found.select(F.col("carried.key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.col("steps").alias("proof"), *([F.col("carried.extra").alias("extra")] if extra is not None else []))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    sibling = lambda s: F.substring(s, 2, 64)
    text = lambda d, s: F.when(F.startswith(s, F.lit("L")), F.concat(sibling(s), d)).otherwise(F.concat(d, sibling(s)))
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(text(d, s), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, joined."""
    return F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), "")


def tampered(docs: DataFrame) -> Column:
    """The digest of a row that tells one more character, where 7 divides the CRC of its number; else null."""
    told = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(told))


def audited(docs: DataFrame) -> DataFrame:
    """`manifest` with each proof folded from the tampered leaf, where there is one; see `tampered`."""
    rows = manifest(docs, extra=tampered(docs)).withColumn("folded_root", folded(F.coalesce("extra", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
