"""A stored term table for keyword search: postings in blocks, frequencies that grow by appends.

A batch of memories is read once. Its postings lie in folders by a hash of the
term; the postings of a term are cut into blocks by memory number, so a common
term is many rows. Memories travel once, to the task of their block, which counts.
Document frequencies and totals are kept by batch and summed by a search, so an
append reads nothing but its own rows.

A search takes a batch of queries at a time. The postings of their terms come
together by block of memory numbers, a block is scored for all queries in one
product of matrices, and a task hands on the best rows of each query alone. So
what is shuffled is the postings of the terms asked for, once for a batch, and
never a row for each query and memory that share a term.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint
from .select import top_per_group

# ---- fixed values ----
# keyword scoring is an engine default in the source system; these are ours
BM25_K1, BM25_B = 1.2, 0.75
# ---- end of fixed values ----

FOLDERS = 32  # folders by hash of the term
BLOCK_BITS = 10  # a block spans 2 ** BLOCK_BITS memory numbers
ROWS_PER_FILE = 2_000_000
ROWS_PER_BATCH = 10_000
BYTES_PER_BLOCK = 64 << 20  # text whose postings are made at a time
TERMS_PER_PRODUCT = 512  # terms that a block is scored for at a time
RARE = 32  # a term is added pair by pair if fewer than 1 / RARE of a block's (row, question) pairs share it
PAIRS_AT_A_TIME = 1 << 20
SEED_ROWS = 8  # not read any more; tests set it


def term_text(text: Column) -> Column:
    """Lower-cased words of a text, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{Nd}\p{Pc}]+", " "))


def terms(text: Column) -> Column:
    return F.filter(F.split(term_text(text), " "), lambda w: w != "")


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _gain(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term adds to a score but for its rarity."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * ((1 - BM25_B) + BM25_B * length / mean))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each block of memories, which come block by block; a block of much text is several rows for a term."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def rows() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        some = pa.concat_batches(held)
        held.clear()
        words = pc.split_pattern(some.column("text").cast(pa.string()), " ")
        found = words.flatten().dictionary_encode()
        n = some.num_rows
        of = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        pairs, tf = np.unique(found.indices.to_numpy().astype(np.int64) * n + of, return_counts=True)
        starts = np.flatnonzero(np.diff(pairs // n, prepend=-1))  # every word occurs
        offsets, row = np.append(starts, len(pairs)).astype(np.int32), pairs % n
        ids, length = (some.column(c).to_numpy(zero_copy_only=False)[row] for c in ("memory_id", "length"))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for v, kind in ((ids, pa.int64()), (tf, pa.int32()), (length, pa.int32()))]
        out = pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.full(len(starts), last), pa.int64()), pa.array(np.diff(offsets), pa.int64()), *lists],
                                         names=["term", "block", "n", "ids", "tf", "length"])
        for at in range(0, len(starts), ROWS_PER_BATCH):
            yield out.slice(at, ROWS_PER_BATCH)

    for batch in batches:
        block = batch.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for p, q in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            if block[p] != last or size > BYTES_PER_BLOCK:
                yield from rows()
                size, last = 0, int(block[p])
            held.append(batch.slice(p, q - p))
            size += int(pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0)
    yield from rows()


def _products(place: np.ndarray, term: np.ndarray, gain: np.ndarray, rows: int, weights: np.ndarray, asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows x questions: the sum of gain * weight over the postings (row, term, gain) of a block.

    Terms that many pairs share make a product of matrices, all others are added
    pair by pair. `asked`: the questions of each term, term after term, and where a term's begin.
    """
    question, begin = asked
    questions, of = weights.shape[1], np.diff(begin)
    order = np.argsort(term, kind="stable")
    place, term, gain = place[order], term[order], gain[order]
    shared = np.bincount(term, minlength=len(of)) * of * RARE >= rows * questions
    often = shared[term]
    scores = np.zeros((rows, questions))
    used, at = np.unique(term[often], return_inverse=True)
    p, g = place[often], gain[often]
    for lo in range(0, len(used), TERMS_PER_PRODUCT):
        a, b = np.searchsorted(at, (lo, lo + TERMS_PER_PRODUCT))
        matrix = np.zeros((rows, min(TERMS_PER_PRODUCT, len(used) - lo)))
        matrix[p[a:b], at[a:b] - lo] = g[a:b]
        scores += matrix @ weights[used[lo:lo + TERMS_PER_PRODUCT]]
    place, term, gain = place[~often], term[~often], gain[~often]
    ends = np.cumsum(of[term])
    a = 0
    while a < len(term):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + PAIRS_AT_A_TIME, "right")))
        n = of[term[a:b]]
        src = np.repeat(np.arange(a, b), n)
        q = question[np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + begin[term[src]]]
        scores += np.bincount(place[src] * questions + q, gain[src] * weights[term[src], q], rows * questions).reshape(rows, questions)
        a = b
    return scores


class TermTable:
    """The term table of a folder; appends make batches, a search sees all of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str) -> DataFrame | None:
        """The rows of `kind` of the batches that are complete."""
        if not self._batches():
            return None
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/batch={b}" for b in self._batches()])

    def _batches(self) -> list[str]:
        fs = self.spark._jvm.org.apache.hadoop.fs
        done = fs.Path(f"{self.path}/totals")
        system = done.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(done):
            return []
        return sorted(s.getPath().getName().removeprefix("batch=") for s in system.listStatus(done) if s.isDirectory() and system.exists(fs.Path(s.getPath(), "_SUCCESS")))

    def append(self, memories: DataFrame) -> None:
        """Add the memories (memory_id, text) that the table does not have; rows that repeat an id in one batch count once."""
        new = memories.select("memory_id", term_text(F.coalesce("text", F.lit(""))).alias("text")).dropDuplicates(["memory_id"])
        if (held := self._read("lengths")) is not None:
            new = new.join(held.select("memory_id"), "memory_id", "left_anti")
        batch = uuid.uuid4().hex
        length = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
        new = checkpoint(new.select("memory_id", "text", length.alias("length"), F.shiftright("memory_id", BLOCK_BITS).alias("block")))
        new.select("memory_id", "length").write.parquet(f"{self.path}/lengths/batch={batch}")
        numbers = new.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        files = max(1, numbers["words"] // ROWS_PER_FILE // FOLDERS)
        blocks = new.where("length > 0").repartition("block").sortWithinPartitions("block").mapInArrow(
            _blocks, "term string, block long, n long, ids array<long>, tf array<int>, length array<int>")
        placed = blocks.withColumn("folder", _folder(F.col("term"))).repartition(FOLDERS * files, "folder", F.pmod(F.xxhash64("term", "block"), F.lit(files)))
        placed.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{self.path}/blocks/batch={batch}")
        stored = self.spark.read.parquet(f"{self.path}/blocks/batch={batch}") if numbers["words"] else placed
        (stored.groupBy("folder", "term").agg(F.sum("n").alias("df"))
         .repartition(FOLDERS, "folder").sortWithinPartitions("term").write.parquet(f"{self.path}/terms/batch={batch}"))
        # a batch counts from here on
        new.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).write.parquet(f"{self.path}/totals/batch={batch}")

    def totals(self) -> tuple[int, int]:
        """Memories and words of all batches."""
        found = self._read("totals")
        return tuple(found.agg(F.sum("rows"), F.sum("words")).first()) if found is not None else (0, 0)

    def _within(self, kind: str, folders: list[int]) -> DataFrame:
        return self._read(kind).where(F.col("folder").isin(folders))

    def top(self, queries: DataFrame, eligible: DataFrame, fetch: int, per_pass: int | None = None) -> DataFrame:
        """query_id, memory_id, score, rank (from 0): best BM25 matches with a score above 0 among `eligible`.

        `queries`: query_id, text and optional lo, hi, kinds; `eligible`: memory_id,
        ts, kind. Frequencies describe the whole table, whatever is eligible.
        """
        from .retrieval import QUERIES_PER_PASS, _chunks, _union, _with_limits

        rows, words = self.totals()
        asked = _with_limits(queries).withColumn("_words", F.array_distinct(terms(F.coalesce("text", F.lit("")))))
        parts = []
        if words:
            for chunk in _chunks(asked, ["query_id", "_words", "_lo", "_hi", "kinds"], per_pass or QUERIES_PER_PASS):
                parts.append(self._scored(chunk, eligible, fetch, rows, words / rows))
        best = top_per_group(_union(parts, self.spark), ["query_id"], fetch, F.col("score").desc(), F.col("memory_id"))
        return best.select("query_id", "memory_id", "score", (F.col("rank") - 1).alias("rank"))

    def _scored(self, chunk: list, eligible: DataFrame, fetch: int, rows: int, mean: float) -> DataFrame:
        """query_id, memory_id, score: the `fetch` best of each task for the queries of one batch."""
        from .retrieval import _PARTIAL, _eligible, _Keeper

        spark = self.spark
        column = {w: i for i, w in enumerate(sorted({w for r in chunk for w in r["_words"]}))}
        names = spark.createDataFrame(list(column.items()), "term string, column int").withColumn("folder", _folder(F.col("term")))
        folders = [r[0] for r in names.select("folder").distinct().collect()]  # at most FOLDERS
        known = self._within("terms", folders).join(F.broadcast(names), ["folder", "term"]).groupBy("column").agg(F.sum("df").alias("df")).collect()  # terms of the batch
        rarity = {r["column"]: math.log(1.0 + (rows - r["df"] + 0.5) / (r["df"] + 0.5)) for r in known}
        questions: dict[frozenset, int] = {}  # queries that differ in their limits alone are one
        number = np.array([questions.setdefault(frozenset(r["_words"]), len(questions)) for r in chunk], np.int64)
        weights, has = np.zeros((len(column), len(questions))), np.zeros((len(column), len(questions)), bool)
        for words, q in questions.items():
            for w in words:
                weights[column[w], q], has[column[w], q] = rarity.get(column[w], 0.0), True
        asked = np.nonzero(has)[1], np.append(0, np.cumsum(has.sum(axis=1)))
        batch = spark.sparkContext.broadcast(([r["query_id"] for r in chunk], weights, [(r["_lo"], r["_hi"], r["kinds"]) for r in chunk], number, asked))
        postings = self._within("blocks", folders).join(F.broadcast(names), ["folder", "term"]).select(
            "block", "column", "ids", "tf", "length")
        ts = F.unix_micros("ts") if "ts" in eligible.columns else F.lit(None).cast("long")
        kind = F.col("kind") if "kind" in eligible.columns else F.lit(None).cast("string")
        present = eligible.select("memory_id", ts.alias("ts"), kind.alias("kind")).groupBy(F.shiftright("memory_id", BLOCK_BITS).alias("block")).agg(F.collect_list(F.struct("memory_id", "ts", "kind")).alias("m"))
        present = present.select("block", F.lit(-1).alias("column"), F.col("m.memory_id").alias("ids"), F.col("m.ts").alias("ts"), F.col("m.kind").alias("kind"))

        def block_scores(of: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray] | None:
            """Scores of a block's eligible rows (rows x queries, -inf where there is none) and their ids."""
            _, weights, limits, number, asked = batch.value
            pdf = pd.concat(of, ignore_index=True)
            own, found = pdf[pdf["column"] < 0], pdf[pdf["column"] >= 0]
            if not len(own) or not len(found):
                return None
            ids, first = np.unique(np.concatenate(own["ids"].to_list()), return_index=True)
            about = pd.DataFrame({"_ts": np.concatenate(own["ts"].to_list())[first], "kind": np.concatenate(own["kind"].to_list())[first]})
            held = np.concatenate(found["ids"].to_list())
            place = np.minimum(np.searchsorted(ids, held), len(ids) - 1)
            here = ids[place] == held
            term = np.repeat(found["column"].to_numpy(), found["ids"].map(len))[here]
            gain = _gain(np.concatenate(found["tf"].to_list())[here].astype(np.float64), np.concatenate(found["length"].to_list())[here], mean)
            scores = _products(place[here], term, gain, len(ids), weights, asked)[:, number]
            scores[(scores <= 0) | ~_eligible(about, limits)] = -np.inf
            return scores, ids

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = batch.value[0]
            keeper, of, last = _Keeper(len(asked), fetch), [], None
            for pdf in frames:
                for block, some in pdf.groupby("block"):
                    if of and block != last:
                        if (scored := block_scores(of)) is not None:
                            keeper.add(*scored)
                        of = []
                    last = block
                    of.append(some)
            if of and (scored := block_scores(of)) is not None:
                keeper.add(*scored)
            yield keeper.frame(asked)

        return postings.unionByName(present, allowMissingColumns=True).repartition("block").sortWithinPartitions("block").mapInPandas(run, _PARTIAL)
