"""Alignment of two tokenizers over a corpus, with corpus counts of their linked ids.

Token ends that both tokenizers share cut a text into groups; every pair of an A
token and a B token of a group is a link. Both tokenizers treat what stands
between two blanks alike wherever it is, so workers align such units once and
remember them.

The first pass gives the documents of each distinct id pair, counted inside the
tasks. Pairs are dealt into SLICES by a hash. A slice's distinct pairs get a
minimal perfect hash; its counts are dense vectors indexed by that hash, summed
as a tree of FAN rows a node. The table of a slice is a file in the shared folder
with the pairs themselves, which look-ups compare. The second pass aligns the
documents again and looks the counts up, slice by slice for the new units of a
chunk, with at most HELD_BYTES of slices in memory. A slice holds at most
1 / SLICES of all possible pairs, whatever the corpus.
"""
from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import checkpoint, scratch_dir
from .perfect_hash import PerfectHash, mixed
from .tokens import _byte_letters

SLICES, FAN = 256, 32
# text of a chunk that is aligned at a time, units that a worker remembers, pairs it counts before it hands them on
CHUNK_CHARS, REMEMBERED, COUNTED = 2 << 20, 400_000, 1_000_000
HELD_BYTES = 64 << 20
# how the byte-level tokenizer cuts a text before it merges
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# a blank begins a unit unless another blank, or the character that stands for one, is before it
_UNITS, _IRREGULAR, _BEGIN = re.compile("[ \n][^ \n]*"), re.compile("[\\s▁][ \n]"), re.compile("(?<=[^\\s▁])(?=[ \n])")


def units_of(text: str) -> list[str]:
    """A blank and `text`, cut where neither tokenizer has a token across."""
    text = " " + text
    return _BEGIN.split(text) if _IRREGULAR.search(text) else _UNITS.findall(text)


class Tokenizers:
    """Ids and token bytes of a byte-level (A) and a piece (B) tokenizer.

    A's pieces are merged by the ranks of its own file, in the library that is
    faster at it; ids are those of the file.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = {c: i for i, c in enumerate(_byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranked = [*byte_of, *(a + b for a, b in merges)]
        self.a = Encoding("units", pat_str=PATTERN, mergeable_ranks={raw(t): i for i, t in enumerate(ranked)}, special_tokens={})
        self.ids = np.array([model["vocab"][t] for t in ranked], np.int64)
        self.b = SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = int(max(model["vocab"].values())) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in zip(ranked, self.ids.tolist()):
            self.bytes_a[i] = raw(token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.size_b))]
        self.blank = self.b.piece_to_id("▁")
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # an id as text with what may follow it
        self.shown = [f"{i}{end}" for size, ends in ((self.size_a, ",|"), (self.size_b, ",;\n")) for end in ends for i in range(size)]

    def ids_a(self, units: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and how many each has; `ends` are the ends of their bytes one after another.

        Units are cut where the tokenizer cuts, also with one another as neighbours, unless they end in a blank.
        """
        odd = [i for i, u in enumerate(units) if u[-1].isspace()]
        if not odd:
            ids = self.ids[np.array(self.a.encode_ordinary("".join(units)), np.int64)]
            return ids, np.diff(np.searchsorted(np.cumsum(self.length_a[ids]), ends), prepend=-1)
        own = {i: self.ids[self.a.encode_ordinary(units[i])] for i in odd}
        rest = [i for i in range(len(units)) if i not in own]
        sizes = np.diff(ends, prepend=0)
        ids, n = self.ids_a([units[i] for i in rest], np.cumsum(sizes[rest])) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts = dict(zip(rest, np.split(ids, np.cumsum(n)[:-1]))) | own
        return np.concatenate([parts[i] for i in range(len(units))]), np.array([len(parts[i]) for i in range(len(units))])

    def ids_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer puts a blank before a text: that of a unit, or one to be taken off again."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        found = [ids[1:] if u[0] != " " else ids or [self.blank] for u, ids in zip(units, found)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n


class Aligned:
    """Alignments of units: ids, numbers of groups and links, and distinct linked pairs with how often each is linked."""

    def __init__(self, tokenizers: Tokenizers, units: list[str]):
        t = self.tokenizers = tokenizers
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        (ids_a, self.n_a), (ids_b, self.n_b) = t.ids_a(units, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))), t.ids_b(units)
        self.same = np.ones(len(units), bool)
        whole = b"".join(raw)
        if b"".join(map(t.bytes_a.__getitem__, ids_a.tolist())) != whole or b"".join(map(t.bytes_b.__getitem__, ids_b.tolist())) != whole:
            split = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b))]
            for i, (x, y, r) in enumerate(zip(*split, raw)):
                self.same[i] = b"".join(map(t.bytes_a.__getitem__, x.tolist())) == r == b"".join(map(t.bytes_b.__getitem__, y.tolist()))
            ids_a, ids_b = ids_a[np.repeat(self.same, self.n_a)], ids_b[np.repeat(self.same, self.n_b)]
            self.n_a, self.n_b = self.n_a * self.same, self.n_b * self.same
        ends_a, ends_b = np.cumsum(t.length_a[ids_a]), np.cumsum(t.length_b[ids_b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        per_a, per_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        unit_of_a = np.repeat(np.arange(len(units)), self.n_a)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        unit_of = unit_of_a[first_a] if len(ends) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(unit_of, minlength=len(units))
        self.n_links = np.bincount(unit_of, weights=per_a * per_b, minlength=len(units)).astype(np.int64)
        # each A token meets the B tokens of its group; pairs repeated in a unit are counted
        times = per_b[group_a]
        at = np.repeat(first_b[group_a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        linked, unit = np.repeat(ids_a, times) * t.size_b + ids_b[at], np.repeat(unit_of_a, times)
        order = np.lexsort((linked, unit))
        linked, unit = linked[order], unit[order]
        new = np.ones(len(linked), bool)
        new[1:] = (linked[1:] != linked[:-1]) | (unit[1:] != unit[:-1])
        starts = np.flatnonzero(new)
        self.pairs, self.times = linked[starts], np.diff(np.append(starts, len(linked)))
        self.n_pairs = np.bincount(unit[starts], minlength=len(units))
        self._tokens = ids_a, ids_b, group_a, group_b, unit_of

    def shown(self) -> list[str]:
        """The groups of each unit as text."""
        t, (ids_a, ids_b, group_a, group_b, unit_of) = self.tokenizers, self._tokens
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        last_of_unit = np.append(unit_of[1:] != unit_of[:-1], True)[group_b] & last_b if len(group_b) else last_b[:0]
        codes = np.concatenate((ids_a + t.size_a * last_a[:len(ids_a)], 2 * t.size_a + ids_b + t.size_b * (last_b[:len(ids_b)].astype(np.int64) + last_of_unit)))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        found = iter("".join(map(t.shown.__getitem__, codes[order].tolist())).split("\n"))
        return [next(found) if n else "" for n in self.n_groups.tolist()]


class Remembered:
    """Alignments of the units met lately; texts of a chunk are lists of places in them."""

    def __init__(self, tokenizers: Tokenizers, shown: bool, most: int = REMEMBERED):
        self.tokenizers, self.keep_shown, self.most = tokenizers, shown, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)
        none = np.zeros(0, np.int64)
        self.same = np.zeros(0, bool)
        self.numbers = np.zeros((4, 0), np.int64)  # n_a, n_b, n_groups, n_links
        self.first, self.pairs, self.times, self.shown = np.zeros(1, np.int64), none, none, []

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Units of each text, the places of all their units, and where the units that are new begin."""
        if len(self.place) > self.most:
            self._clear()
        old, place = len(self.place), self.place
        cut = [units_of(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if len(place) > old:
            new = Aligned(self.tokenizers, list(islice(place, old, None)))
            self.same = np.concatenate((self.same, new.same))
            self.numbers = np.concatenate((self.numbers, [new.n_a, new.n_b, new.n_groups, new.n_links]), axis=1)
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(new.n_pairs)))
            self.pairs, self.times = np.concatenate((self.pairs, new.pairs)), np.concatenate((self.times, new.times))
            if self.keep_shown:
                self.shown += new.shown()
        return sizes, at, old


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            keys.append(batch.column(0)[at].as_py())
            texts.append(batch.column(1)[at].as_py() or "")
            size += len(texts[-1])
            if size >= most or len(texts) == 4096:
                yield keys, texts
                keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def _without_tokens(memory: Remembered, texts: list[str], sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a text is empty or its tokens do not give it back."""
    starts = np.cumsum(sizes) - sizes
    return np.array([not t for t in texts], bool) | ~np.logical_and.reduceat(memory.same[at], starts)


def _slice_of(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, 1 << 16) % np.uint64(SLICES)).astype(np.int64)


def counted(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(slice, pairs, counts): sorted distinct id pairs of a task's documents and how many of them hold each, as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held, size = Remembered(Tokenizers(path_a, path_b), shown=False), [], 0

        def flush(held: list) -> tuple[np.ndarray, np.ndarray]:
            pairs, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return pairs, np.bincount(where, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

        def rows(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            of = _slice_of(pairs)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(SLICES + 1))
            parts = [(i, order[p:q]) for i, (p, q) in enumerate(zip(cuts[:-1], cuts[1:])) if q > p]
            return pa.RecordBatch.from_pydict({"slice": pa.array([i for i, _ in parts], pa.int32()), "pairs": pa.array([pairs[o].astype("<i8").tobytes() for _, o in parts], pa.binary()),
                                               "counts": pa.array([counts[o].astype("<i8").tobytes() for _, o in parts], pa.binary())})

        for _, texts in _chunks(batches):
            sizes, at, _ = memory.chunk(texts)
            empty = _without_tokens(memory, texts, sizes, at)
            seen = np.unique(np.repeat(np.arange(len(texts)), sizes) << 32 | at)
            doc, unit = seen >> 32, seen & ((1 << 32) - 1)
            doc, unit = doc[~empty[doc]], unit[~empty[doc]]
            times = memory.first[unit + 1] - memory.first[unit]
            where = np.repeat(memory.first[unit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            linked, doc = memory.pairs[where], np.repeat(doc, times)
            order = np.lexsort((doc, linked))
            linked, doc = linked[order], doc[order]
            new = np.ones(len(linked), bool)
            new[1:] = (linked[1:] != linked[:-1]) | (doc[1:] != doc[:-1])
            held.append(np.unique(linked[new], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * COUNTED:
                held = [flush(held)]
                size = len(held[0][0])
                if size > COUNTED:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*flush(held))

    return docs.select(F.lit(0).alias("key"), F.col(text).alias("text")).mapInArrow(run, "slice int, pairs binary, counts binary")


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


@pandas_udf(T.BinaryType())
def _union(groups: pd.Series) -> pd.Series:
    return pd.Series([np.unique(np.concatenate([_numbers(x) for x in g])).astype("<i8").tobytes() for g in groups])


@pandas_udf(T.BinaryType())
def _sum(groups: pd.Series) -> pd.Series:
    return pd.Series([np.add.reduce([_numbers(x) for x in g]).astype("<i8").tobytes() for g in groups])


def tree(rows: DataFrame, value: str, fold, fan: int = FAN) -> DataFrame:
    """(slice, value): the values of a slice folded `fan` at a time, level by level, to one."""
    while True:
        rows = rows.select("slice", value).withColumn("node", F.row_number().over(Window.partitionBy("slice").orderBy(F.xxhash64(value))))
        rows = checkpoint(rows.groupBy("slice", F.ceil(F.col("node") / fan).alias("node")).agg(F.collect_list(value).alias(value)).select("slice", "node", fold(value).alias(value)))
        if rows.where("node > 1").isEmpty():
            return rows.drop("node")


@pandas_udf(T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("sizes", "bits", "keys")]]))
def _hashed(pairs: pd.Series) -> pd.DataFrame:
    out = []
    for raw in pairs:
        keys = _numbers(raw)
        hashed = PerfectHash.of(keys)
        ordered = np.empty(len(keys), "<i8")
        ordered[hashed.index(keys)] = keys
        out.append((len(keys), hashed.sizes.astype("<i8").tobytes(), hashed.bits.astype("<u8").tobytes(), ordered.tobytes()))
    return pd.DataFrame(out, columns=["n", "sizes", "bits", "keys"])


@pandas_udf(T.BinaryType())
def _dense(n: pd.Series, sizes: pd.Series, bits: pd.Series, keys: pd.Series, parts: pd.Series) -> pd.Series:
    """Counts of some parts of a slice as a vector indexed by its hash."""
    out = []
    for m, s, b, k, part in zip(n, sizes, bits, keys, parts):
        hashed, known, vector = PerfectHash(_numbers(s), np.frombuffer(b, "<u8")), _numbers(k), np.zeros(m, "<i8")
        for p in part:
            pairs = _numbers(p["pairs"])
            at = hashed.index(pairs)
            if (at < 0).any() or (known[at] != pairs).any():
                raise ValueError("a counted pair is not among the hashed ones")
            vector[at] += _numbers(p["counts"])
        out.append(vector.tobytes())
    return pd.Series(out)


def table(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """Stored (slice, n, sizes, bits, keys, counts) from stored rows of `counted`."""
    keys = tree(parts, "pairs", _union, fan).select("slice", _hashed("pairs").alias("h")).select("slice", "h.*")
    keys = checkpoint(keys)
    groups = parts.withColumn("node", F.ceil(F.row_number().over(Window.partitionBy("slice").orderBy(F.xxhash64("pairs", "counts"))) / fan))
    groups = groups.groupBy("slice", "node").agg(F.collect_list(F.struct("pairs", "counts")).alias("parts")).join(keys, "slice")
    vectors = checkpoint(groups.select("slice", _dense("n", "sizes", "bits", "keys", "parts").alias("counts")))
    return checkpoint(keys.join(tree(vectors, "counts", _sum, fan), "slice"))


def highest(found: DataFrame, size_a: int, size_b: int) -> np.ndarray:
    """The highest count of each A id in the corpus, 0 for ids without a link: one number for an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(size_a, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                np.maximum.at(best, _numbers(keys) // size_b, _numbers(counts))
        at = np.flatnonzero(best)
        yield pa.RecordBatch.from_pydict({"a": pa.array(at, pa.int32()), "best": pa.array(best[at], pa.int64())})

    best = np.zeros(size_a, np.int64)
    for row in found.select("keys", "counts").mapInArrow(run, "a int, best long").groupBy("a").agg(F.max("best").alias("best")).collect():
        best[row["a"]] = row["best"]
    return best


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def written(found: DataFrame, folder: str) -> dict[int, str]:
    """The file of each slice under `folder`, a URI that executors share; only those of the attempts that end are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                counts = _numbers(row["counts"])
                small = {"keys": _numbers(row["keys"]), "counts": counts}
                small = {k: v.astype("<u4" if not len(v) or v.max() < 1 << 32 else "<u8") for k, v in small.items()}
                np.savez(out := io.BytesIO(), sizes=_numbers(row["sizes"]), bits=np.frombuffer(row["bits"], "<u8"), **small)
                path = f"{base}/slice-{row['slice']:04d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.npz"
                with system.open_output_stream(path, compression=None) as stream:
                    stream.write(out.getvalue())
                done.append((row["slice"], path))
        yield pa.RecordBatch.from_pydict({"slice": pa.array([d[0] for d in done], pa.int32()), "path": pa.array([d[1] for d in done], pa.string())})

    return {r["slice"]: r["path"] for r in found.mapInArrow(run, "slice int, path string").collect()}  # at most SLICES


class Counts:
    """Counts of pairs from the slices' files, at most `most` bytes of them in memory."""

    def __init__(self, folder: str, paths: dict[int, str], most: int = HELD_BYTES):
        self.system, self.paths, self.most = _system(folder)[0], paths, most
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.size = 0

    def _slice(self, number: int) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        with self.system.open_input_stream(self.paths[number], compression=None) as stream:
            got = np.load(io.BytesIO(stream.read()))
        one = (PerfectHash(got["sizes"], got["bits"]), got["keys"], got["counts"])
        self.held[number] = one
        self.size += one[1].nbytes + one[2].nbytes + 2 * one[0].bits.nbytes
        while self.size > self.most and len(self.held) > 1:
            _, (h, k, c) = self.held.popitem(last=False)
            self.size -= k.nbytes + c.nbytes + 2 * h.bits.nbytes
        return one

    def of(self, pairs: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(pairs, return_inverse=True)
        out, slices = np.zeros(len(distinct), np.int64), _slice_of(distinct)
        order = np.argsort(slices, kind="stable")
        cuts = np.flatnonzero(np.diff(slices[order], prepend=-1))
        for at in np.split(order, cuts[1:]) if len(order) else []:
            hashed, keys, counts = self._slice(int(slices[at[0]]))
            index = hashed.index(distinct[at])
            if (index < 0).any() or (keys[index] != distinct[at]).any():
                raise ValueError("a document holds a pair that the first pass did not count")
            out[at] = counts[index]
        return out[where]


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """One row per row of `docs`: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer file, B a piece model. A pair's count is the
    number of rows that hold it linked; rows that repeat a text count each. A
    text that is null or empty, or that its tokens do not give back, has no
    tokens: zeros and an empty string. Null keys stay. No rows give no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    parts = checkpoint(counted(docs, path_a, path_b, text))
    found = table(parts, fan)
    tokenizers = Tokenizers(path_a, path_b)
    best = highest(found, tokenizers.size_a, tokenizers.size_b)
    size_b = tokenizers.size_b
    folder = scratch_dir(spark, "pairs")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{os.path.abspath(folder)}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    paths = written(found, folder)
    del tokenizers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("key").type
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        memory, counts = Remembered(Tokenizers(path_a, path_b), shown=True), Counts(folder, paths)
        of_unit, known = np.zeros((2, 0), np.int64), np.zeros(0, bool)  # n_best, count_sum; whether they are looked up

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for keys, texts in _chunks(again()):
            sizes, at, old = memory.chunk(texts)
            empty = _without_tokens(memory, texts, sizes, at)
            of_unit, known = np.pad(of_unit[:, :old], ((0, 0), (0, len(memory.same) - old))), np.pad(known[:old], (0, len(memory.same) - old))
            # units of texts without tokens may be unknown to the first pass
            used = np.zeros(len(memory.same), bool)
            used[at[~np.repeat(empty, sizes)]] = True
            units = np.flatnonzero(used & ~known)
            known[units] = True
            many = memory.first[units + 1] - memory.first[units]
            where = np.repeat(memory.first[units], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs, times, unit = memory.pairs[where], memory.times[where], np.repeat(np.arange(len(units)), many)
            n = counts.of(pairs)
            for row, weights in enumerate((times * (n == best[pairs // size_b]), times * n)):
                of_unit[row, units] = np.bincount(unit, weights=weights, minlength=len(units))
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(np.concatenate((memory.numbers, of_unit))[:, at], starts, axis=1)
            sums[:, empty] = 0
            shown = [memory.shown[i] for i in at.tolist()]
            digests = ["" if e else hashlib.sha256(";".join(shown[s:s + m]).encode()).hexdigest() for e, s, m in zip(empty.tolist(), starts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *map(pa.array, sums), pa.array(digests, pa.string())], names=["key", *names])

    schema = f"key {docs.schema[key].dataType.simpleString()}, {RESULT}"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
