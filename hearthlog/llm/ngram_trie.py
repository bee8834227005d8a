"""Language-model scores from n-gram tries in Elias-Fano levels.

The model interpolates three levels with absolute discounting:

    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p2(w | u) = max(c(u, w) - D, 0) / c(u) + D t(u) / c(u) p1(w)
    p3(w | v u) = max(c(v, u, w) - D, 0) / c(v, u) + D t(v, u) / c(v, u) p2(w | u)

with t the different words seen after a context; a context never seen leaves the
lower level as it is. The tokens after a word u that is seen often are dealt out in
parts of about SPLIT_TOKENS tokens, told apart by a digest of the word before it
(of the document at its start). So no shard grows with the corpus, and all tokens
after v u meet in one. What follows u alone is counted over all texts first, and a
part gets these counts with its tokens. So parts move work, never scores, and a
shard of all n-grams with parts of its own knows all but p1.

Tokens travel once, to the shard of their context, as compressed columns. A shard
builds its trie from the training tokens: words, contexts, the words after them,
the words before them, and below those the words after both, told by their place
among the successors of the context alone. Pointers and values are ascending and
kept as Elias-Fano sequences, discounted probabilities and weights as 16-bit
steps of their logarithm. The levels lie in one file of the shared folder, which
is mapped where the file system allows, and the shard's tokens are searched in
them. A token's score needs p1; the counts of the most frequent words, at most FREQUENT, are
with every worker, and what is left of rare words' tokens meets the vocabulary
in a join.
"""
from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import checkpoint, scratch_dir, small_side
from .common import stored, whole
from .elias_fano import EliasFano, encode
from .perfect_hash import mixed

DISCOUNT = 0.75
# training tokens of a part of a context; steps of a factor of ten
SPLIT_TOKENS, STEPS = 200_000, 4096
# another model, which no query asks for: contexts of more training tokens become several, each with its own counts alone
CLASS_TOKENS: int | None = None
# most words whose counts every worker has, and tokens of a shard
FREQUENT, SHARD_TOKENS = 1 << 19, 1_300_000
# bytes of text taken at a time, and distinct words counted before they are handed on
CHUNK_BYTES, COUNTED = 8 << 20, 400_000
# a block has at most 2 ** DOC_BITS documents
DOC_BITS = 14
# rows that Spark reads, and hands to Python, at a time: texts of whole documents, or a block's columns for a shard
ROWS_AT_A_TIME, BATCH_ROWS = 1000, ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
END, BEGIN = b"", b" "  # no word is empty or has a blank


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))  # A-Z and ASCII blanks only
    words, n = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not some.all():  # blanks at either end leave empty ones
        words, n = words.filter(pa.array(some)), np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
    return words, n


def _each(words: pa.Array) -> list[bytes]:
    _, offsets, data = words.buffers()
    at, data = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).tolist() if len(words) else [0], data.to_pybytes() if data else b""
    return [data[p:q] for p, q in zip(at, at[1:])]


def _chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, dealt out anew by the bytes of a column: a little over `most`, and at most 2 ** DOC_BITS rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            begin = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, begin + most - size, "right")) + 1, at + (1 << DOC_BITS) - rows, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size, rows, at = size + int(ends[to - 1]) - begin, rows + to - at, to
            if size > most or rows == 1 << DOC_BITS:
                yield pa.concat_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.concat_batches(held)
    held.clear()
    pa.default_memory_pool().release_unused()  # a worker lives on, and the next task is another stage's


def number(word: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, mark (CRC-32 of the key's decimal digits, null for a null key), held_out."""
    mark = F.crc32(F.col(key).cast("string"))
    return docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"), mark.alias("mark"), F.coalesce(mark % 5 == 1, F.lit(False)).alias("held_out"))


def vocabulary(rows: DataFrame) -> tuple[int, DataFrame]:
    """The seed and the stored (word, n, total) by 64-bit word number: occurrences in training and in all texts, ends included.

    Counts travel as compressed columns to the slice of their words, which adds
    them up. Another 16 bits of a word tell whether two share a number; then
    another seed is taken.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(seed: int):
        def fold(held: list[tuple]) -> tuple:
            words, other, n, rest = map(np.concatenate, zip(*held))
            order = np.lexsort((other, words))
            words, other = words[order], other[order]
            starts = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (other[1:] != other[:-1])))
            return words[starts], other[starts], np.add.reduceat(n[order], starts), np.add.reduceat(rest[order], starts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                words, other, n, rest = held.pop()
                of = words % np.uint64(slices)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(slices + 1, dtype=np.uint64)).tolist()
                parts = [(i, order[p:q]) for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if q > p]
                return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([_squeezed([np.diff(words[o], prepend=np.uint64(0)), other[o], n[o], rest[o]]) for _, o in parts], pa.binary())], names=["slice", "counts"])

            for chunk in _chunks(batches, "text", CHUNK_BYTES):
                known, tokens, starts = _flat(chunk.column("text"))
                left_out = np.repeat(chunk.column("held_out").to_numpy(zero_copy_only=False), np.diff(starts, append=len(tokens)))
                n, rest = (np.bincount(tokens[of], minlength=len(known)) for of in (~left_out, left_out))
                used = np.flatnonzero(n + rest)
                known = [known[i] for i in used.tolist()]
                held.append((np.fromiter((number(w, seed) for w in known), np.uint64, len(known)), np.fromiter((number(w, seed + 1) & 0xFFFF for w in known), np.int64, len(known)), n[used], rest[used]))
                size += len(known)
                if size > 2 * COUNTED:
                    held[:] = [fold(held)]
                    if (size := len(held[0][0])) > COUNTED:
                        yield flush()
                        size = 0
            if held:
                held[:] = [fold(held)]
                yield flush()

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def fold() -> tuple:
            words, least, most, n, total = map(np.concatenate, zip(*held))
            order = np.argsort(words)
            words = words[order]
            starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            return words[starts], np.minimum.reduceat(least[order], starts), np.maximum.reduceat(most[order], starts), np.add.reduceat(n[order], starts), np.add.reduceat(total[order], starts)

        size = 0
        for batch in batches:
            for raw in batch.column("counts"):
                gaps, other, n, rest = (x.astype(np.uint64) if i == 0 else x.astype(np.int64) for i, x in enumerate(_spread(raw.as_py())))
                held.append((np.cumsum(gaps, dtype=np.uint64), other, other, n, n + rest))
                size += len(gaps)
                if size > 4 * COUNTED + 2 * len(held[0][0]):  # what is added up stays a fixed part of it
                    held = [fold()]
                    size = len(held[0][0])
        if held:
            words, least, most, n, total = fold()
            for at in range(0, len(words), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(n[some]), pa.array(total[some]), pa.array(least[some] != most[some])], names=["word", "n", "total", "shared"])

    seed = 0
    while True:
        parts = rows.select("text", "held_out").mapInArrow(counted(seed), "slice int, counts binary").repartitionById(slices, F.col("slice"))
        found = stored(parts.mapInArrow(added, "word long, n long, total long, shared boolean"), "words")
        if found.where("shared").isEmpty():
            return seed, found.select("word", "n", "total")
        seed += 2


class Frequent:
    """The counts that every worker has; contexts are the places of words, and one more for the start of a text."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, begun: int, start: int):
        order = np.argsort(words.view(np.uint64))
        self.context_words, self.context_counts = np.append(words.view(np.uint64)[order], np.uint64(start)), np.append(counts[order], begun)
        self.words, self.counts = self.context_words[:-1], self.context_counts[:-1]
        self.parts = np.maximum(1, -(-self.context_counts // (CLASS_TOKENS or SPLIT_TOKENS))).astype(np.int32)

    def __getstate__(self) -> tuple:
        """What travels with every task: counts in few bytes, and parts of the few contexts that have several."""
        split = np.flatnonzero(self.parts > 1)
        width = np.uint32 if self.context_counts.max() < 1 << 32 else np.int64
        return self.context_words, self.context_counts.astype(width), split, self.parts[split]

    def __setstate__(self, state: tuple) -> None:
        self.context_words, counts, split, parts = state
        self.context_counts = counts.astype(np.int64)
        self.words, self.counts = self.context_words[:-1], self.context_counts[:-1]
        self.parts = np.ones(len(counts), np.int32)
        self.parts[split] = parts

    def place(self, words: np.ndarray) -> np.ndarray:
        """Places of word numbers, -1 for rare words."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def context_keys(word: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A number for each context: a word and its class."""
    return np.where(part > 0, mixed(word ^ (part.astype(np.uint64) << np.uint64(40)), 7), word) if part.any() else word


def _squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns of non-negative numbers: byte planes, compressed."""
    parts = []
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if not len(c) or w == 8 or int(c.max()) < 1 << 8 * w)
        parts += [np.array([len(c), width], "<i8").tobytes(), c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def _spread(raw: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.decompress(raw), [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        planes = np.frombuffer(data[at + 16:at + 16 + n * width], np.uint8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 16 + n * width
    return out


def _flat(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a block with END and BEGIN first, all its tokens as places in them, and where its texts start."""
    words, n = _cut(texts)
    encoded = words.dictionary_encode()
    ends = np.cumsum(n + 1) - 1
    tokens = np.zeros(len(words) + len(n), np.int32)  # END
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = encoded.indices.to_numpy() + 2
    return [END, BEGIN, *_each(encoded.dictionary)], tokens, ends - n


def successors(rows: DataFrame, seed: int, frequent: Frequent) -> DataFrame:
    """Stored (context, kinds, words) for each context of `frequent` with several parts: the words after it in training with their counts, in one or more rows."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = -(-frequent.context_counts // (50 * SPLIT_TOKENS)).astype(np.uint64)  # slices that the words after a context go to

    def fold(held: list[tuple]) -> tuple:
        context, word, n = map(np.concatenate, zip(*held))
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        starts = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
        return context[starts], word[starts], np.add.reduceat(n[order], starts)

    def pairs(texts: pa.Array) -> tuple:
        known, tokens, starts = _flat(texts)
        words = np.fromiter((number(w, seed) for w in known), np.uint64, len(known))
        context = frequent.place(words)
        context[(context >= 0) & (frequent.parts[context] == 1)] = -1
        before = np.concatenate(([-1], context[tokens[:-1]]))
        before[starts] = len(frequent.words) if frequent.parts[-1] > 1 else -1
        often = before >= 0
        found, n = np.unique(before[often] * len(words) + tokens[often], return_counts=True)
        return found // len(words), words[found % len(words)], n

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []

        def flush() -> pa.RecordBatch:
            context, word, n = fold(found)
            of = mixed(context.astype(np.uint64) << np.uint64(32) | word % np.maximum(buckets[context], np.uint64(1)), 5) % np.uint64(slices)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(slices + 1, dtype=np.uint64)).tolist()
            parts = [(i, order[p:q]) for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if q > p]
            found.clear()
            at = frequent.place(word)
            usual = [(o[at[o] >= 0], o[at[o] < 0]) for _, o in parts]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([_squeezed([context[u], at[u], n[u], context[r], word[r], n[r]]) for u, r in usual], pa.binary())], names=["slice", "counts"])

        for chunk in _chunks(batches, "text", CHUNK_BYTES // 2):
            found.append(pairs(chunk.column("text")))
            if sum(len(f[0]) for f in found) > 2 * COUNTED:
                found[:] = [fold(found)]
                if len(found[0][0]) > COUNTED:
                    yield flush()
        if found:
            yield flush()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for raw in batch.column("counts"):
                context, at, n, *rare = _spread(raw.as_py())
                words = frequent.words[at.astype(np.int64)] if len(at) else np.zeros(0, np.uint64)
                found.append(tuple(np.concatenate((x, y)).astype(kind) for x, y, kind in zip((context, words, n), rare, (np.int64, np.uint64, np.int64))))
                size += len(found[-1][0])
                if size > 2 * COUNTED + 2 * len(found[0][0]):  # what is added up stays a fixed part of it
                    found = [fold(found)]
                    size = len(found[0][0])
        if not found:
            return
        context, word, n = fold(found)
        starts = np.flatnonzero(np.diff(context, prepend=-1))
        for p, q in zip(starts.tolist(), [*starts[1:].tolist(), len(context)]):
            at = frequent.place(word[p:q])
            usual, rare = at >= 0, at < 0
            words = _squeezed([np.diff(at[usual], prepend=0), np.diff(word[p:q][rare], prepend=np.uint64(0)), np.concatenate((n[p:q][usual], n[p:q][rare]))])
            yield pa.RecordBatch.from_arrays([pa.array([int(context[p])], pa.int32()), pa.array([q - p], pa.int64()), pa.array([words], pa.binary())], names=["context", "kinds", "words"])

    parts = rows.where("NOT held_out").select("text").mapInArrow(counted, "slice int, counts binary").repartitionById(slices, F.col("slice"))
    return stored(parts.mapInArrow(added, "context int, kinds long, words binary"), "successors")


NOTHING = {"keys": None, "held_out": None, "n_tokens": None, "known": None, "base": None, "payload": None}


ROUTED = "shard int, block long, keys array<{key}>, held_out array<boolean>, n_tokens array<long>, known array<long>, base array<double>, payload binary"


def _shard_of(words: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return mixed(context_keys(words, part), 3) % np.uint64(shards)


def _routed_schema(key_type: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.list_(key_type)), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
                      ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("payload", pa.binary())])


def _dealt(frequent: Frequent, shards: int, key_type: pa.DataType):
    """The rows of `successors` for the shard of each part of their context, as block -1."""
    schema = _routed_schema(key_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, raw in zip(batch.column("context").to_pylist(), batch.column("words")):
                part = np.arange(frequent.parts[context])
                word = np.repeat(frequent.context_words[context:context + 1], len(part))
                for key, shard in zip(context_keys(word, part).tolist(), _shard_of(word, part, shards).tolist()):
                    head = _squeezed([np.array([key], np.uint64), np.array([context])])
                    yield pa.RecordBatch.from_pylist([{**NOTHING, "shard": shard, "block": -1, "payload": len(head).to_bytes(4, "little") + head + raw.as_py()}], schema)

    return run


def _routed(frequent: Frequent, seed: int, shards: int, total: float, key_type: pa.DataType):
    schema = _routed_schema(key_type)

    def block(number_of: int, rows: pa.RecordBatch) -> Iterator[dict]:
        keys, held, marks = (rows.column(c).to_pylist() for c in ("key", "held_out", "mark"))
        known, w3, starts = _flat(rows.column("text"))
        begin, n = known.index(BEGIN), np.diff(starts, append=len(w3))
        w2 = np.concatenate((np.array([begin], np.int32), w3[:-1]))
        w2[starts] = begin
        w1 = np.concatenate((np.array([begin], np.int32), w2[:-1]))
        w1[starts] = begin
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        words = np.fromiter((number(w, seed) for w in known), np.uint64, len(known))
        often = frequent.place(words)
        rank = np.lexsort((words, often, often < 0))  # frequent words by place, then rare ones by number
        back = np.empty(len(rank), np.int32)
        back[rank] = np.arange(len(rank))
        words, often, known, begin = words[rank], often[rank], [known[i] for i in rank.tolist()], int(back[begin])
        w1, w2, w3 = back[w1], back[w2], back[w3]
        usual = int((often >= 0).sum())
        counts = np.where(often >= 0, frequent.counts[np.maximum(often, 0)] if len(frequent.counts) else 0, 0)
        classes = np.where(often >= 0, frequent.parts[often], 1)
        classes[begin] = frequent.parts[-1]
        part = np.zeros(len(w3), np.int32)
        split = np.flatnonzero((classes > 1)[w2])
        if len(split):
            before, at = np.unique(w1[split], return_inverse=True)
            digests = np.array([int(hashlib.md5(known[w]).hexdigest()[:8], 16) for w in before.tolist()], np.int64)
            part[split] = digests[at] % classes[w2[split]]
        if classes[begin] > 1:
            part[starts] = np.array([m or 0 for m in marks], np.int64) % classes[begin]
        del split
        # what the frequent words give is summed here
        log = np.where(often >= 0, np.log10((counts + 0.5) / total), 0.0)
        yield {**NOTHING, "shard": number_of % shards, "block": number_of, "keys": keys, "held_out": held, "n_tokens": n, "known": np.add.reduceat((counts > 0)[w3], starts, dtype=np.int64),
               "base": np.add.reduceat(log[w3], starts)}
        del log, known
        shard = _shard_of(words[w2], part, shards).astype(np.uint16 if shards < 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable").astype(np.int32)
        cuts = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
        del shard
        trained, local = ~np.array(held, bool), np.empty(len(words), np.int64)
        for s, (p, q) in enumerate(zip(cuts, cuts[1:])):
            if p == q:
                continue
            at = order[p:q]
            here = [w[at] for w in (w1, w2, w3)]
            used = np.zeros(len(words), bool)
            for w in here:
                used[w] = True
            used = np.flatnonzero(used)
            local[used] = np.arange(len(used))
            split = int(np.searchsorted(used, usual))
            docs = doc[at]
            yield {**NOTHING, "shard": s, "block": number_of, "payload": _squeezed([
                np.diff(often[used[:split]], prepend=0), words[used[split:]], np.diff(docs, prepend=0), trained[docs].astype(np.uint8), part[at], *(local[w] for w in here)])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, rows in enumerate(_chunks(batches, "text", CHUNK_BYTES)):
            out = []
            for row in block((TaskContext.get().partitionId() << 20) + blocks, rows):
                out.append(row)
                if len(out) == 64:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def quantised(p: np.ndarray) -> np.ndarray:
    return np.floor(-np.log10(p) * STEPS + 0.5).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -STEPS)


class Whole(NamedTuple):
    """Contexts with several parts: where they are, their tokens and different words over all texts, whether they are the start of a
    text, before which `begin` stands alone; then the words after them that a shard knows, with their counts."""

    at: np.ndarray
    tokens: np.ndarray
    kinds: np.ndarray
    started: np.ndarray
    begin: int
    c: np.ndarray
    w3: np.ndarray
    n: np.ndarray


class Trie:
    """Levels of one shard; see the module."""

    SEQUENCES = ("words", "contexts", "after", "after_from", "before", "below", "below_from")
    VALUES = ("p2", "weight2", "p3", "weight3")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.SEQUENCES:
            setattr(self, name, EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")}))
        for name in self.VALUES:
            setattr(self, name, arrays[name])

    @staticmethod
    def arrays(contexts: np.ndarray, words: np.ndarray, c: np.ndarray, w1: np.ndarray, w3: np.ndarray, n: np.ndarray, whole: Whole | None = None) -> dict[str, np.ndarray]:
        """Levels from distinct n-grams in the order of (context, word before, word after), seen `n` times.

        `c`, `w1` and `w3` are places in the ascending 64-bit numbers `contexts` and `words`; those without n-grams are left out.
        `whole` has the counts of contexts of which the n-grams are a part.
        """
        def kept(values: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
            used = np.zeros(len(values), bool)
            for p in places:
                used[p] = True
            to = np.cumsum(used) - 1
            return [values[used], *(to[p] for p in places)]

        def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct values of an ascending array, and for each element which it is."""
            new = np.ones(len(values), bool)
            new[1:] = values[1:] != values[:-1]
            return values[new], np.cumsum(new) - 1

        whole = whole or Whole(*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool), 0, *[np.zeros(0, np.int64)] * 3)
        first = whole.at[whole.started]
        if len(first):  # one word alone comes before these: its pair is whole as well
            mine, theirs = ~np.isin(c, first), np.isin(whole.c, first)
            begun = np.full(int(theirs.sum()), whole.begin)
            c, w1, w3, n = (np.concatenate((x[mine], y)) for x, y in ((c, whole.c[theirs]), (w1, begun), (w3, whole.w3[theirs]), (n, whole.n[theirs])))
            order = np.lexsort((w3, w1, c))
            c, w1, w3, n = c[order], w1[order], w3[order], n[order]
        contexts, c, at, whole_c, first = kept(contexts, c, whole.at, whole.c, first)
        words, w1, w3, whole_w3, begin = kept(words, w1, w3, whole.w3, np.full(len(first), whole.begin))
        size = max(len(words), 1)
        given = whole_c * size + whole_w3
        after, b = np.unique(np.concatenate((c * size + w3, given)) if len(given) else c * size + w3, return_inverse=True)
        b, given = b[:len(c)], b[len(c):]
        n2 = np.bincount(b, weights=n, minlength=len(after))
        n2[given] = whole.n
        of = after // size
        c2, t2 = np.bincount(of, weights=n2, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        after_from = np.concatenate(([0], np.cumsum(t2)))
        before, j = runs(c * size + w1)
        started = first * size + begin
        if len(started) and len(more := np.setdiff1d(started, before)):
            local, before = before, np.union1d(before, more)
            j = np.searchsorted(before, local)[j]
        started = np.searchsorted(before, started)
        of_pair = before // size
        c3, t3 = np.bincount(j, weights=n, minlength=len(before)), np.bincount(j, minlength=len(before))
        below_from = np.concatenate(([0], np.cumsum(t3)))
        here = t2.copy()
        c2[at], t2[at] = whole.tokens, whole.kinds
        c3[started], t3[started] = c2[of_pair[started]], t2[of_pair[started]]
        base = np.cumsum(here[of_pair]) - here[of_pair]  # places among the successors of the context alone, one pair after another
        sequences = {"words": words, "contexts": contexts, "after": after, "after_from": after_from, "before": before, "below": base[j] + b - after_from[c], "below_from": below_from}
        out = {f"{name}.{k}": v for name, values in sequences.items() for k, v in encode(values).items()}
        return out | {"p2": quantised((n2 - DISCOUNT) / c2[of]), "weight2": quantised(DISCOUNT * t2 / c2), "p3": quantised((n - DISCOUNT) / c3[j]), "weight3": quantised(DISCOUNT * t3 / c3)}

    def parts(self, contexts: np.ndarray, words: np.ndarray, c: np.ndarray, w1: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, g) of n-grams given as to `arrays`, so that the probability of each is a + g p1(its last word)."""
        a, g = np.zeros(len(c)), np.ones(len(c))
        if not len(self.contexts):
            return a, g

        def find(level: EliasFano, values: np.ndarray, where: np.ndarray) -> np.ndarray:
            """Places in a level of ascending values, -1 where `where` does not hold."""
            out = np.full(len(values), -1, np.int64)
            some = values[where]
            new = np.ones(len(some), bool)
            new[1:] = some[1:] != some[:-1]
            out[where] = level.find(some[new])[np.cumsum(new) - 1]
            return out

        size = len(self.words)
        c, known = self.contexts.find(contexts)[c], self.words.find(words)
        i1, i3 = known[w1], known[w3]
        j = find(self.before, c * size + i1, (c >= 0) & (i1 >= 0))
        b = np.full(len(c), -1, np.int64)
        where = (c >= 0) & (i3 >= 0)
        distinct, at = np.unique((c * size + i3)[where], return_inverse=True)
        b[where] = self.after.find(distinct)[at]
        a[b >= 0] = restored(self.p2[b[b >= 0]])
        g[c >= 0] = restored(self.weight2[c[c >= 0]])
        after_from = self.after_from.all().astype(np.int64)
        of_pair = self.before.all().astype(np.int64) // size
        sizes = np.diff(after_from)[of_pair]
        base = np.cumsum(sizes) - sizes
        both = (b >= 0) & (j >= 0)
        k = find(self.below, np.where(both, base[np.maximum(j, 0)] + b - after_from[np.maximum(c, 0)], 0), both)
        weight = np.where(j >= 0, restored(self.weight3[np.maximum(j, 0)]), 1.0)
        a, g = a * weight, g * weight
        a[k >= 0] += restored(self.p3[k[k >= 0]])
        return a, g


def write(arrays: dict[str, np.ndarray], system, path: str) -> None:
    """Arrays one after another, each at a multiple of 8 bytes, and their list."""
    lines, at = [], 0
    with system.open_output_stream(path, compression=None) as out:
        for name, array in arrays.items():
            raw = array.tobytes()
            lines.append(f"{name} {array.dtype.str} {len(array)} {at}")
            out.write(raw + bytes(-len(raw) % 8))
            at += len(raw) + -len(raw) % 8
        tail = "\n".join(lines).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))


def mapped(system, path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, in mapped memory if it is a local one."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        system = fs.LocalFileSystem(use_mmap=True)
    with system.open_input_file(path) as file:
        data = file.read_buffer(file.size())
    n = int.from_bytes(data[len(data) - 8:].to_pybytes(), "little")
    lines = data[len(data) - 8 - n: len(data) - 8].to_pybytes().decode().splitlines()
    return {name: np.frombuffer(data, kind, int(size), int(at)) for name, kind, size, at in (line.split(" ") for line in lines)}


RESULT = "block long, keys array<{key}>, held_out array<boolean>, n_tokens array<long>, known array<long>, base array<double>, docs array<int>, scores array<double>, rare_docs array<int>, rare array<long>, ratios array<double>"


def _whole(frequent: Frequent, kinds: dict[int, int], tables: list[bytes], contexts: np.ndarray, words: np.ndarray) -> Whole:
    """What the rows of `_dealt` tell of a shard's ascending `contexts` and `words`."""
    at, found = {}, ([], [], [])
    for raw in tables:
        head, size = int.from_bytes(raw[:4], "little"), len(contexts)
        (key,), (context,) = _spread(raw[4:4 + head])
        c = min(int(np.searchsorted(contexts, key)), size - 1)
        if contexts[c] != key:
            continue
        at[c] = int(context)
        usual, rare, n = _spread(raw[4 + head:])
        after = np.concatenate((frequent.words[np.cumsum(usual, dtype=np.int64)] if len(usual) else np.zeros(0, np.uint64), np.cumsum(rare, dtype=np.uint64)))
        place = np.minimum(np.searchsorted(words, after), len(words) - 1)
        here = words[place] == after
        for x, y in zip(found, (np.full(int(here.sum()), c), place[here], n[here].astype(np.int64))):
            x.append(y)
    of = np.array(list(at.values()), np.int64)
    begin = int(np.searchsorted(words, frequent.context_words[-1]))
    return Whole(np.array(list(at), np.int64), frequent.context_counts[of], np.array([kinds[x] for x in of.tolist()], np.int64), of == len(frequent.words), begin,
                 *(np.concatenate([np.zeros(0, np.int64), *x]) for x in found))


def _scored(frequent: Frequent, kinds: dict[int, int], total: float, folder: str, keep: bool, key_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(key_type)), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())),
                        ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("rare_docs", pa.list_(pa.int32())), ("rare", pa.list_(pa.int64())), ("ratios", pa.list_(pa.float64()))])
    none = dict.fromkeys(schema.names)

    def shard(system, base: str, name: int, rows: list[tuple[int, bytes]]) -> Iterator[dict]:
        columns, blocks, dictionaries, begin = [], [], [], 0
        tables, rows = [payload for block, payload in rows if block < 0], [r for r in rows if r[0] >= 0]
        if not rows:
            return
        for block, payload in rows:
            usual, rare, docs, trained, part, *local = _spread(payload)
            dictionaries.append(np.concatenate((frequent.words[np.cumsum(usual.astype(np.int64))] if len(usual) else np.zeros(0, np.uint64), rare.astype(np.uint64))))
            columns.append((*((begin + w.astype(np.int64)).astype(np.int32) for w in local), part.astype(np.int32), trained.astype(bool), np.cumsum(docs, dtype=np.int64).astype(np.int32)))
            begin += len(dictionaries[-1])
            blocks.append((block, len(docs)))
        w1, w2, w3, part, trained, doc = map(np.concatenate, zip(*columns))
        del columns, rows
        words, place = np.unique(np.concatenate(dictionaries), return_inverse=True)
        del dictionaries
        size = len(words)
        parts = int(part.max()) + 1
        code, c = np.unique(place[w2] * parts + part, return_inverse=True)
        del w2, part
        contexts = context_keys(words[code // parts], code % parts)
        order = np.argsort(contexts)
        contexts, to = contexts[order], np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        # distinct n-grams in the order of context, word before, word after
        pairs, j = np.unique(to[c] * size + place[w1], return_inverse=True)
        del w1, c
        grams, where = np.unique(j * size + place[w3], return_inverse=True)
        del w3, j
        pair, w3 = pairs[grams // size], grams % size
        c, w1 = pair // size, pair % size
        n = np.bincount(where, weights=trained, minlength=len(grams))
        seen = n > 0
        path = f"{base}/trie-{name:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        whole = _whole(frequent, kinds, tables, contexts, words)
        del tables
        write(Trie.arrays(contexts, words, c[seen], w1[seen], w3[seen], n[seen], whole), system, path)
        a, g = Trie(mapped(system, path)).parts(contexts, words, c, w1, w3)
        if not keep:
            system.delete_file(path)
        w3 = words[w3]
        often = frequent.place(w3)
        p1 = ((frequent.counts[np.maximum(often, 0)] if len(frequent.counts) else np.zeros(len(often))) + 0.5) / total
        # log(a + g p1) = log(g) + log(a / g + p1), of which a rare word leaves the second part open
        log, ratio = np.where(often >= 0, np.log10(a + g * p1), np.log10(g)), a / g
        begin = 0
        for block, size in blocks:
            of, gram = doc[begin:begin + size], where[begin:begin + size]
            docs, at = np.unique(of, return_inverse=True)
            rare = often[gram] < 0
            yield {**none, "block": block, "docs": docs.astype(np.int32), "scores": np.bincount(at, weights=log[gram], minlength=len(docs)), "rare_docs": of[rare].astype(np.int32), "rare": _signed(w3[gram[rare]]), "ratios": ratio[gram[rare]]}
            begin += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        held, last = [], None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["payload"] is None:
                    yield pa.RecordBatch.from_pylist([{**none, **{k: row[k] for k in ("block", "keys", "held_out", "n_tokens", "known", "base")}}], schema)
                    continue
                if held and row["shard"] != last:
                    for out in shard(system, base, last, held):
                        yield pa.RecordBatch.from_pylist([out], schema)
                    held = []
                    pa.default_memory_pool().release_unused()
                last = row["shard"]
                held.append((row["block"], row["payload"]))
        if held:
            for out in shard(system, base, last, held):
                yield pa.RecordBatch.from_pylist([out], schema)

    return run


@pandas_udf(T.ArrayType(T.DoubleType()))
def _summed(sizes: pd.Series, parts: pd.Series) -> pd.Series:
    """The scores of a block's documents from those of its shards."""
    out = []
    for size, rows in zip(sizes, parts):
        total = np.zeros(size)
        for r in rows:
            np.add.at(total, np.asarray(r["docs"], np.int64), np.asarray(r["scores"], np.float64))
        out.append(total)
    return pd.Series(out)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, shard_tokens: int = SHARD_TOKENS, frequent_words: int = FREQUENT) -> DataFrame:
    """One row per row of `docs`: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose key's CRC-32 leaves 1 by 5 are held out, all others teach; a null
    key teaches. A text's tokens are its words with A-Z lower-cased and one end;
    a null or empty text has the end alone. Rows that repeat teach and are
    scored each. Scores are base-10 logarithms. `folder` (a URI that executors
    share) takes the tries; without it a trie is removed when its shard is scored. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    before = {name: spark.conf.get(name) for name in BATCH_ROWS}
    for name, rows in before.items():
        spark.conf.set(name, str(min(int(rows), ROWS_AT_A_TIME) if int(rows) > 0 else ROWS_AT_A_TIME))
    try:
        return _scores(docs, key, text, folder, shard_tokens, frequent_words)
    finally:
        for name, rows in before.items():
            spark.conf.set(name, rows)


def _scores(docs: DataFrame, key: str, text: str, folder: str | None, shard_tokens: int, frequent_words: int) -> DataFrame:
    spark = docs.sparkSession
    rows = rows_of(docs, key, text)
    seed, vocab = vocabulary(rows)
    n, v, tokens = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    total = n + 0.5 * (v + 1)
    # words seen at least so often that no more than `frequent_words` are: a power of two
    sizes = dict(vocab.groupBy(F.floor(F.log2(F.greatest("total", F.lit(1)))).cast("int").alias("power")).count().collect())
    power = next(p for p in range(65) if sum(m for q, m in sizes.items() if q >= p) <= frequent_words)
    top = vocab.where(F.col("total") >= F.lit(1 << power if power < 63 else (1 << 63) - 1)).toPandas()
    end = vocab.where(F.col("word") == int(np.uint64(number(END, seed)).view(np.int64))).first()
    frequent = Frequent(top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64), end["n"] if end else 0, number(BEGIN, seed))
    after, kinds = None, {}
    if CLASS_TOKENS is None and frequent.parts.max() > 1:
        after = successors(rows, seed, frequent)
        kinds = dict(after.groupBy("context").agg(F.sum("kinds")).collect())  # at most one for SPLIT_TOKENS training tokens
        of = np.array(list(kinds), np.int64)
        part = np.maximum(SPLIT_TOKENS, 2 * np.array(list(kinds.values()), np.int64))  # so the tables that parts get are no more than half of their tokens
        frequent.parts[of] = -(-frequent.context_counts[of] // part)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // shard_tokens))
    keep = folder is not None
    folder = folder or scratch_dir(spark, "tries")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{os.path.abspath(folder)}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    kind = docs.schema[key].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    if not isinstance(kind, (T.LongType, T.IntegerType)):
        rows = rows.withColumn("key", F.col("key").cast("string"))
    name = rows.schema["key"].dataType.simpleString()
    routed = rows.mapInArrow(_routed(frequent, seed, shards, total, arrow), ROUTED.format(key=name))
    if after is not None:
        routed = routed.unionByName(after.mapInArrow(_dealt(frequent, shards, arrow), ROUTED.format(key=name)))
    placed = routed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    found = checkpoint(placed.mapInArrow(_scored(frequent, kinds, total, folder, keep, arrow), RESULT.format(key=name)))
    p1 = (F.col("n") + 0.5) / F.lit(total)
    place = lambda doc: F.shiftleft("block", DOC_BITS).bitwiseOR(F.col(doc).cast("long")).alias("place")
    rare = found.where(F.size("rare") > 0).select("block", F.explode(F.arrays_zip("rare_docs", "rare", "ratios")).alias("r")).select(place("r.rare_docs"), F.col("r.rare").alias("word"), F.col("r.ratios").alias("ratio"))
    late = rare.join(small_side(vocab.select("word", "n")), "word").groupBy("place").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("known_rare"), F.sum(F.log10(p1)).alias("base_rare"), F.sum(F.log10(F.col("ratio") + p1)).alias("score_rare"))
    sums = found.where(F.col("docs").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("docs", "scores")).alias("parts"))
    heads = found.where(F.col("keys").isNotNull()).select("block", "keys", "held_out", "n_tokens", "known", "base").join(sums, "block")
    each = heads.withColumn("scores", _summed(F.size("keys"), "parts")).select("block", F.posexplode(F.arrays_zip("keys", "held_out", "n_tokens", "known", "base", "scores")).alias("doc", "d"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return each.withColumn("place", place("doc")).join(late, "place", "left").select(
        F.col("d.keys").cast(kind).alias(key), F.col("d.held_out").alias("held_out"), F.col("d.n_tokens").alias("n_tokens"), (F.col("d.known") + none("known_rare")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.round(F.col("d.base") + none("base_rare"), 6).alias("base_score"), F.round(F.col("d.scores") + none("score_rare"), 6).alias("score"))
