"""Grouping vectors: similarity components, leader clusters, owner voice."""
from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import vectors as vx
from ..session import checkpoint, scratch_dir, stored
from .select import numbered, seeded, top_rows

# ---- fixed values ----
SAME_PERSON, SAME_SPEAKER = 0.42, 0.55
OWNER_COVERAGE, OWNER_CANDIDATES = 0.5, 5
EM_ROUNDS, EM_AGREEMENT = 12, 0.9999
MIN_OWNER_SIMILARITY = 0.35
# ---- end of fixed values ----

PIVOTS = 256
CHUNK_ROWS = 2_048
# Rows of a block of the exact comparison, rows of it multiplied at a time, and blocks met before labels are known.
BLOCK_ROWS, STRIPE_ROWS, NEAR_BLOCKS = 8_192, 1_024, 3
# A product of unit vectors in single precision is nearer than this to the true one.
SINGLE_ERROR = 1e-4
# Links that one task joins at a time.
LINKS_PER_TASK = 1_000_000
# Rows settled in order, and so leaders broadcast, at a time; the groups do not depend on it.
LEADERS_PER_PASS = 1_024


def constant_vector(values) -> Column:
    """A vector literal that the optimizer folds once."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def mean_unit_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Normalise, average, normalise again; vector sums are combined in the map tasks."""
    v = array_to_vector(vx.unit(F.col(vector)))
    return (
        rows.groupBy(*keys)
        .agg(Summarizer.mean(v).alias("_mean"), F.count(F.lit(1)).alias("n"))
        .withColumn("vector", vx.unit(vector_to_array("_mean")))
        .drop("_mean")
    )


# ---- components of the similarity graph -------------------------------------------


def _close_rows(v: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where rows of two sets of unit vectors have a cosine, rounded to 9 digits, of the threshold or more.

    Single precision finds them; those too near the threshold for it are computed again.
    """
    sims = v.astype(np.float32) @ w.astype(np.float32).T
    i, j = np.nonzero(sims >= np.float32(threshold - SINGLE_ERROR))
    ok = sims[i, j] >= np.float32(threshold + SINGLE_ERROR)
    unsure = np.flatnonzero(~ok)
    for at in range(0, len(unsure), 1 << 16):
        some = unsure[at:at + (1 << 16)]
        ok[some] = np.round(np.einsum("ij,ij->i", v[i[some]], w[j[some]]), 9) >= threshold
    return i[ok], j[ok]


class _Forest:
    """Groups of a task's rows, which start from given labels, and the links that joined them."""

    def __init__(self, labels: np.ndarray):
        values, self.group = np.unique(labels, return_inverse=True)
        self.parent, self.links = np.arange(len(values)), []

    def root(self, rows: np.ndarray) -> np.ndarray:
        return self.parent[self.group[rows]]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.root(a), self.root(b)
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            by = np.full(len(self.parent), -1)
            by[np.maximum(p, q)] = np.arange(len(a))  # one link for each group that hangs on a smaller one
            used = by[by >= 0]
            self.parent[np.maximum(p, q)[used]] = np.minimum(p, q)[used]
            self.links.append(np.stack([a[used], b[used]]))
            while not np.array_equal(above := self.parent[self.parent], self.parent):
                self.parent = above

    def of(self, ids: np.ndarray) -> pd.DataFrame:
        src, dst = np.concatenate([*self.links, np.empty((2, 0), np.int64)], axis=1).astype(np.int64)
        return pd.DataFrame({"src": ids[src], "dst": ids[dst]})


def similar_links(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst) links whose components are those of the graph of all pairs with
    cosine >= threshold. `vectors`: id (long), vector.

    Equal vectors are linked to one of them first. The rest meet only inside
    cells: a row lives in the cell of its nearest pivot and visits each later
    cell that the triangle inequality cannot rule out. A cell lies in blocks in
    the shared folder, and tasks read the blocks of each pair there, so no row is
    copied for a pair and no task holds more than two blocks and a stripe of
    their product. Each block meets the next few first; what that connects is
    not linked again when it meets the others. A pair of blocks returns links
    that connect its groups, never its close pairs.
    """
    spark = vectors.sparkSession
    same = stored(vectors.groupBy("vector").agg(F.min("id").alias("_rep")), "vectors")
    copies = vectors.join(same, "vector").where(F.col("id") != F.col("_rep")).select(
        F.col("_rep").alias("src"), F.col("id").alias("dst")
    )
    items = same.select(F.col("_rep").alias("id"), "vector")
    chosen = top_rows(items.withColumn("_pick", seeded(3, "id")), 4 * pivots, F.col("_pick"))
    sample = np.array([r[0] for r in chosen.select("vector").collect()], dtype=np.float64)  # 4 * pivots rows
    if not len(sample):
        return copies
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    shared = spark.sparkContext.broadcast(_pivot_table(sample, angle, items.count(), pivots))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            v = _unit_rows(pdf["vector"])
            to = np.arccos(np.clip(v @ p.T, -1.0, 1.0))
            home = to.argmin(axis=1)
            near = to <= (to.min(axis=1) + 2 * angle + 1e-9)[:, None]
            near &= np.arange(len(p))[None, :] > home[:, None]
            row, cell = np.nonzero(near)
            rows = np.concatenate([np.arange(len(v)), row])
            yield pd.DataFrame({
                "cell": np.concatenate([home, cell]).astype(np.int32), "id": pdf["id"].to_numpy()[rows], "vector": [x.tobytes() for x in v[rows]],
            })

    placed = stored(items.mapInPandas(place, "cell int, id long, vector binary"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks"))
    cut = placed.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))  # one row per pivot
    each = F.sequence(F.lit(0), F.col("_chunks") - 1)
    pairs = sizes.withColumn("a", F.explode(each)).withColumn("b", F.explode(each)).where("a <= b").select("cell", "a", "b")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, labelled = copies, cut.withColumn("label", F.col("id"))
    for far in (False, True):
        met = stored(pairs.where((F.col("b") - F.col("a") >= NEAR_BLOCKS) == F.lit(far)), "pairs")
        n = met.count()
        if not n:
            break
        if far:
            labels = connected_components(items.select("id"), found).withColumnRenamed("component", "label")
            labelled = cut.join(labels, "id")
        folder = scratch_dir(spark, "blocks")
        labelled.select("cell", "chunk", "id", "label", "vector").repartition("cell", "chunk").write.partitionBy("cell", "chunk").parquet(folder)
        dealt = met.repartition(min(n, 4 * parts), F.rand(1)).sortWithinPartitions("cell", "a", "b")
        found = found.unionByName(stored(dealt.mapInPandas(_met_blocks(folder, threshold), "src long, dst long"), "links"))
    return found


def _met_blocks(folder: str, threshold: float):
    """Links between the rows of each pair (cell, a, b) of blocks of the folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}

        def block(cell: int, chunk: int) -> tuple:
            if (cell, chunk) not in held:
                rows = _stored_rows(f"{folder}/cell={cell}/chunk={chunk}")
                v = np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
                held[cell, chunk] = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), v
            return held[cell, chunk]

        for pdf in frames:
            for cell, a, b in zip(pdf["cell"].tolist(), pdf["a"].tolist(), pdf["b"].tolist()):
                held = {k: x for k, x in held.items() if k in ((cell, a), (cell, b))}
                ids, labels, v = block(cell, a)
                others, theirs, w = block(cell, b)
                if not len(ids) or not len(others):
                    continue
                forest = _Forest(np.concatenate([labels, theirs]))
                for at in range(0, len(ids), STRIPE_ROWS):
                    i, j = _close_rows(v[at:at + STRIPE_ROWS], w, threshold)
                    forest.add(i + at, j + len(ids))
                yield forest.of(np.concatenate([ids, others]))

    return run


def _pivot_table(sample: np.ndarray, angle: float, rows: int, most: int) -> np.ndarray:
    """The first pivots of the sample, as many as make the cells cheapest to compare.

    At wide angles every row visits every cell and one cell is best; at narrow
    ones many cells rule most pairs out. The choice never changes the links.
    """
    best, best_cost = 1, math.inf
    scale = rows / len(sample)
    n = 1
    while n <= min(most, len(sample)):
        to = np.arccos(np.clip(sample @ sample[:n].T, -1.0, 1.0))
        home = to.argmin(axis=1)
        visits = (to <= (to.min(axis=1) + 2 * angle)[:, None]) & (np.arange(n)[None, :] > home[:, None])
        homes = np.bincount(home, minlength=n) * scale
        guests = visits.sum(axis=0) * scale
        cost = float((homes * (homes + guests)).sum() + 1_000 * guests.sum())  # a moved row costs about 1000 pairs
        if cost < best_cost:
            best, best_cost = n, cost
        n *= 4
    return sample[:best]


SIGNATURES, SIGNATURE_BITS, PER_ROUND = 24, 62, 6


def signature_links(vectors: DataFrame, threshold: float, signatures: int = SIGNATURES, chunk_rows: int = CHUNK_ROWS, per_round: int = PER_ROUND) -> DataFrame:
    """(src, dst) links of pairs with cosine >= threshold, nearly enough to connect what all such pairs connect.

    For wide angles, where `similar_links` must let every cell meet every other.
    Each of `signatures` rounds of random hyperplanes gives a row a bit string;
    rows sorted by it lie near rows at small angles, and stretches of `chunk_rows`
    rows, half overlapping, are compared. So a round moves and compares a row a
    fixed number of times, whatever the table's size, and equal strings fill no
    single task. After every `per_round` signatures what is connected is
    contracted, and rows of one group are not compared again. Every link is
    verified; a pair whose signatures keep apart in all rounds may be missed, and
    a table of at most `chunk_rows` rows misses none.
    """
    spark = vectors.sparkSession
    same = stored(vectors.groupBy("vector").agg(F.min("id").alias("_rep")), "vectors")
    copies = vectors.join(same, "vector").where(F.col("id") != F.col("_rep")).select(F.col("_rep").alias("src"), F.col("id").alias("dst"))
    items = same.select(F.col("_rep").alias("id"), "vector")
    first = items.select(F.size("vector").alias("n")).first()
    if first is None:
        return copies
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("src", "dst")])
    state, found = items.withColumn("label", F.col("id")), copies
    for begin in range(0, signatures, per_round):
        planes = np.random.default_rng(begin).normal(size=(per_round, first["n"], SIGNATURE_BITS))

        def placed(frames: Iterator[pd.DataFrame], planes=planes) -> Iterator[pd.DataFrame]:
            weights = 1 << np.arange(SIGNATURE_BITS, dtype=np.int64)
            for pdf in frames:
                if len(pdf):
                    v = _unit_rows(pdf["vector"])
                    for number, plane in enumerate(planes):
                        yield pd.DataFrame({"number": number, "signature": ((v @ plane > 0) @ weights), "id": pdf["id"], "label": pdf["label"], "vector": list(v)})

        def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for pdf in frames:
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                while len(held) >= 2 * chunk_rows:
                    yield _spanning(held[:chunk_rows], threshold)
                    held = held[chunk_rows // 2:]
            while held is not None and len(held):
                yield _spanning(held[:chunk_rows], threshold)
                held = held[chunk_rows // 2:] if len(held) > chunk_rows else None

        rows = state.mapInPandas(placed, "number int, signature long, id long, label long, vector array<double>")
        dealt = rows.repartitionByRange(parts if state.count() * per_round > parts * chunk_rows else per_round, "number", "signature", "id").sortWithinPartitions("number", "signature", "id")
        new = stored(dealt.mapInPandas(compared, kind).distinct(), "links")
        found = found.unionByName(new)
        if begin + per_round < signatures:
            labels = connected_components(items.select("id"), found)
            state = stored(items.join(labels.withColumnRenamed("component", "label"), "id"))
    return found


def _spanning(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between rows of one signature that connect their groups as all close pairs would."""
    out: list[pd.DataFrame] = []
    for _, pdf in rows.groupby("number"):
        ids, labels = pdf["id"].to_numpy(), pdf["label"].to_numpy()
        if (labels == labels[0]).all():
            continue
        v, forest = np.stack(pdf["vector"].to_numpy()), _Forest(labels)
        forest.add(*_close_rows(v, v, threshold))
        out.append(forest.of(ids))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"src": [], "dst": []}, dtype=np.int64)


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(smallest id, id) for each group that the links of a task connect."""
    held = [pdf for pdf in frames if len(pdf)]
    if held:
        ids, ends = np.unique(pd.concat(held)[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
        ends = ends.reshape(-1, 2)
        forest = _Forest(np.arange(len(ids)))
        forest.add(ends[:, 0], ends[:, 1])
        least = ids[forest.parent]  # a root is the smallest of its group
        yield pd.DataFrame({"src": least, "dst": ids})[least != ids]


def connected_components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links.

    Tasks of at most LINKS_PER_TASK links first replace them by stars around the
    smallest ids; with one task that settles all. Each round takes the smallest
    label among neighbours and then the label of that label; labels are stored
    every round.
    """
    links = stored(links.select("src", "dst"), "links")
    tasks = max(1, -(-links.count() // LINKS_PER_TASK))
    links = stored(links.repartition(tasks).mapInPandas(_stars, "src long, dst long"), "stars")
    if tasks == 1:
        settled = links.select(F.col("dst").alias("id"), F.col("src").alias("component"))
        return ids.select("id").join(settled, "id", "left").withColumn("component", F.coalesce("component", "id"))
    both = stored(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    touched = both.select(F.col("src").alias("id")).distinct()
    labels = stored(touched.withColumn("component", F.col("id")))
    while True:
        offered = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.min("component").alias("_near")
        )
        lower = labels.join(offered, "id", "left").select(
            "id", F.least("component", F.coalesce("_near", "component")).alias("component"), F.col("component").alias("_old")
        )
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("_root"))
        nxt = stored(
            lower.join(jump, "component", "left").select(
                "id", F.least("component", F.coalesce("_root", "component")).alias("component"), "_old"
            )
        )
        done = nxt.where(F.col("component") != F.col("_old")).isEmpty()
        labels = nxt.drop("_old")
        if done:
            break
    return ids.select("id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


# ---- leader clusters ---------------------------------------------------------------


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _close(sims: np.ndarray, threshold: float, strict: bool) -> np.ndarray:
    sims = np.round(sims, 9)
    return (sims > threshold if strict else sims >= threshold) & (sims > 0)


def _first_leaders(rows: pd.DataFrame, threshold: float, strict: bool) -> pd.DataFrame:
    """The leaders among rows in id order: those close to no leader before them."""
    v = _unit_rows(rows["vector"])
    near = _close(v @ v.T, threshold, strict)
    taken = np.zeros(len(v), bool)
    picked = []
    for i in range(len(v)):
        if not taken[i]:
            picked.append(i)
            taken |= near[i]
    return rows.iloc[picked]


def _stored_rows(path: str) -> pd.DataFrame:
    """The rows of a Parquet folder of the shared store, empty if there is none, read where a task runs."""
    from pyarrow import fs, parquet

    uri = path if re.match("[a-z0-9]+:/", path) else f"file://{os.path.abspath(path)}"
    system, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet"))
    read = [parquet.ParquetFile(system.open_input_file(f)).read().to_pandas() for f in files]  # no columns from the folders' names
    return pd.concat(read, ignore_index=True) if read else pd.DataFrame({c: [] for c in ("id", "label", "vector")})


def _stored_leaders(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids, which ascend, and unit vectors of the leaders that one pass stored."""
    found = _stored_rows(path).sort_values("id")
    return found["id"].to_numpy(np.int64), _unit_rows(found["vector"])


def leader_clusters(
    vectors: DataFrame, threshold: float = SAME_PERSON, strict: bool = False, leaders_per_pass: int = LEADERS_PER_PASS
) -> DataFrame:
    """(id, leader): in id order a row leads a group if its cosine to every leader
    before it stays below the threshold; every row joins its nearest leader, ties
    to the smaller id. `strict` asks for more than the threshold.

    The first `leaders_per_pass` rows that no leader covers are settled in order
    by one task, which stores their leaders in the shared folder; a map pass over
    the uncovered rows reads them there and drops what they cover. As no later
    leader changes what an earlier one decided, the groups are those of one
    ordered pass for any pass size and partitioning. Rows are then compared with
    the stored leaders, one pass of them at a time, where they lie; only (id,
    leader, cosine) is shuffled, and no vector goes through the driver. Null and
    zero vectors are groups of their own.
    """
    spark = vectors.sparkSession
    rows = checkpoint(vectors.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector")))
    folder, passes, open_rows = scratch_dir(spark, "leaders"), [], rows

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in frames if len(pdf)]  # at most leaders_per_pass rows
        if held:
            yield _first_leaders(pd.concat(held, ignore_index=True).sort_values("id"), threshold, strict)

    def uncovered(path: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, v = _stored_leaders(path)
            for pdf in frames:
                if len(pdf):
                    covered = _close(_unit_rows(pdf["vector"]) @ v.T, threshold, strict).any(axis=1)
                    yield pdf[~(covered | pdf["id"].isin(ids).to_numpy())]
        return run

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            unit, leader, top = _unit_rows(pdf["vector"]), np.full(len(pdf), -1, np.int64), np.full(len(pdf), -np.inf)
            for path in passes:  # ids ascend, so the first of equals has the smallest
                ids, v = _stored_leaders(path)
                sims = np.round(unit @ v.T, 9)
                best = sims.argmax(axis=1)
                found = sims[np.arange(len(pdf)), best]
                better = found > top
                leader[better], top[better] = ids[best[better]], found[better]
            ok = _close(top, threshold, strict)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "leader": leader[ok], "similarity": top[ok]})

    while True:
        path = f"{folder}/{len(passes)}"
        top_rows(open_rows, leaders_per_pass, F.col("id")).repartition(1).mapInPandas(settled, rows.schema).write.parquet(path)
        if spark.read.schema(rows.schema).parquet(path).isEmpty():
            break
        passes.append(path)
        open_rows = checkpoint(open_rows.mapInPandas(uncovered(path), open_rows.schema))
    members = vectors.select("id", F.col("id").alias("_self"))
    found = rows.mapInPandas(nearest, "id long, leader long, similarity double")
    best = found.groupBy("id").agg(F.max_by("leader", F.struct("similarity", -F.col("leader"))).alias("leader"))
    return members.join(best, "id", "left").select("id", F.coalesce("leader", "_self").alias("leader"))


def ranked_groups(members: DataFrame, size: Column | None = None) -> DataFrame:
    """Add `person`: 0 for the largest group, ties to the smaller leader id.

    Group sizes are partial counts; the numbering runs over groups, not rows.
    """
    sizes = members.groupBy("leader").agg((size if size is not None else F.count(F.lit(1))).alias("size"))
    order = sizes.withColumn("_neg", -F.col("size"))
    ranks = numbered(order, ["_neg", "leader"], "_rank").select("leader", "size", (F.col("_rank") - 1).alias("person"))
    return members.join(ranks, "leader")


# ---- the owner's voice ---------------------------------------------------------------


def pick_owner(clusters: DataFrame, n_calls: int, profile: list[float] | None = None) -> DataFrame:
    """One row (leader, vector, coverage): the cluster in most calls when it covers
    half of them or there is no profile, else the closest of the five widest. Of
    several in equally many calls the closest is taken."""
    widest = top_rows(clusters, OWNER_CANDIDATES, F.col("calls").desc(), F.col("leader"))
    coverage = F.col("calls") / F.lit(n_calls)
    if profile is None:
        return top_rows(widest, 1, F.col("calls").desc(), F.col("leader")).withColumn("coverage", coverage)
    near = vx.dot(F.col("vector"), constant_vector(profile))
    wide = F.max(F.col("calls")).over(Window.partitionBy(F.lit(0))) >= OWNER_COVERAGE * n_calls  # five rows
    scored = widest.withColumn("_wide", wide).withColumn("_near", near)
    best = top_rows(
        scored, 1, F.when(F.col("_wide"), F.col("calls")).desc_nulls_last(), F.round("_near", 9).desc_nulls_last(),
        F.col("calls").desc(), F.col("leader"),
    )
    return best.drop("_wide", "_near").withColumn("coverage", coverage)


def owner_picks(speakers: DataFrame, centroid: Column) -> DataFrame:
    """Per call the label whose unit vector lies closest to the centroid."""
    scored = speakers.select("audio_ref", "label", vx.unit(F.col("vector")).alias("vector")).withColumn(
        "similarity", vx.dot(F.col("vector"), centroid)
    )
    return scored.groupBy("audio_ref").agg(
        F.min_by(F.struct("label", "similarity", "vector"), F.struct(-F.round("similarity", 9), "label")).alias("_p")
    ).select("audio_ref", "_p.label", "_p.similarity", "_p.vector")


def refine_owner(speakers: DataFrame, start: list[float], rounds: int = EM_ROUNDS) -> list[float]:
    """Pick each call's closest speaker, average the picks, repeat until stable.

    Only the centroid (one vector) passes through the driver.
    """
    centroid = np.asarray(start, np.float64)
    centroid = centroid / (np.linalg.norm(centroid) or 1.0)
    for _ in range(rounds):
        row = mean_unit_vector(owner_picks(speakers, constant_vector(centroid)), [], "vector").first()
        if row is None or not row["n"]:
            break
        new = np.asarray(row["vector"])
        settled = float(new @ centroid) > EM_AGREEMENT
        centroid = new
        if settled:
            break
    return centroid.tolist()


def match_report(picks: DataFrame, threshold: float = MIN_OWNER_SIMILARITY) -> DataFrame:
    return picks.agg(
        F.count(F.lit(1)).alias("calls"), F.avg("similarity").alias("mean_similarity"),
        F.avg((F.col("similarity") >= threshold).cast("double")).alias("share_above"),
    )


def label_owner(
    segments: DataFrame, turns: DataFrame, picks: DataFrame, threshold: float = MIN_OWNER_SIMILARITY
) -> DataFrame:
    """Segments with speaker me/other: me where the overlapping label is the call's
    owner label and that label is similar enough. Segments and turns without length count."""
    from .joins import assign_speakers

    owner = picks.where(F.col("similarity") >= threshold).select("audio_ref", F.col("label").alias("_owner"))
    labelled = assign_speakers(segments.drop("speaker"), turns, instants=True).join(owner, "audio_ref", "left")
    return labelled.withColumn(
        "speaker", F.when(F.col("label") == F.col("_owner"), "me").otherwise("other")
    ).drop("_owner", "overlap_ms")


def promote_calls(labelled: DataFrame, files: DataFrame, clean: bool = True) -> DataFrame:
    """Labelled segments as messages: merged utterances, cleaned unless told otherwise, dated by file time + start.

    `files`: audio_ref, file_ts, lang.
    """
    from ..functions import paths, text as tx
    from .sequence import merge_utterances

    ref = F.col("audio_ref")
    spoken = merge_utterances(labelled)
    if clean:
        spoken = spoken.withColumn("text", tx.clean_transcript(F.col("text"))).where(F.col("text") != "")
    return spoken.join(files, "audio_ref").select(
        F.when(F.contains(ref, F.lit("video_audio")), "video").otherwise("call").alias("source"),
        F.concat(F.lit("call:"), paths.stem(ref)).alias("conversation_id"),
        F.timestamp_micros(F.unix_micros("file_ts") + F.col("start_ms") * 1000).alias("ts"),
        F.col("segment_id").alias("seq"), "speaker", F.lit(None).cast("string").alias("speaker_name"), "text",
        ref.alias("audio_ref"), "lang", F.lit(False).alias("is_media"),
    )
