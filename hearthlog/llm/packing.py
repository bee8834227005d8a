"""Best-fit packing by bin completion over the histogram of lengths.

Pieces of one length are alike, so the search works on counts by length: at
most `capacity` rows whatever the corpus. Its answer is a list of fillings, each
used a number of times. A distributed rank of the pieces within their length
then says for every piece which sequence and place is its own.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import ranked, with_uid
from .tokens import WordIds

CAPACITY = 2048
# Branch and bound: fillings looked at for one largest piece, nodes before the
# incumbent is taken as it stands.
FILLINGS, NODES = 24, 4_000
# Rows of a bucket of the rank within a length: the offsets are a table of lengths and buckets.
ROWS_PER_BUCKET = 50_000
# Characters of text that a worker takes at a time.
CHUNK_CHARS = 1 << 20

Filling = tuple[tuple[int, ...], int]  # lengths from largest to smallest, times used


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids: key, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is the tokenizer's ids and then `closing`; only longer ones are
    cut. A null text is empty, one closing id. Repeated rows give their pieces
    each. Other columns are not read.
    """
    schema = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        end, width = np.array([closing], "<u4").tobytes(), 4 * capacity

        def rows(kind: pa.DataType, held: list[tuple]) -> pa.RecordBatch:
            out = pa.schema([("key", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
            pieces = [(k, first // width, first // 4, len(part := ids[first:first + width]) // 4, part)
                      for (k, _), ids in zip(held, (i + end for i in words.of_all([t for _, t in held]))) for first in range(0, len(ids), width)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), out)], schema=out)

        for batch in batches:
            kind, held, size = batch.schema.field("key").type, [], 0
            for at in range(batch.num_rows):
                held.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py()))
                size += len(held[-1][1] or "")
                if size > CHUNK_CHARS:
                    yield rows(kind, held)
                    held, size = [], 0
            if held:
                yield rows(kind, held)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on counts: each piece goes to the fullest sequence that still takes it."""
    room_of: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # those in use, ascending

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in room_of:
            room_of[room] = {}
            rooms.insert(bisect_left(rooms, room), room)
        room_of[room][filling] = room_of[room].get(filling, 0) + times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                if left >= per:
                    put(capacity - per * length, (length,) * per, left // per)
                if left % per:
                    put(capacity - left % per * length, (length,) * (left % per), 1)
                break
            room = rooms[at]
            filling, times = room_of[room].popitem()
            if not room_of[room]:
                del room_of[room], rooms[at]
            used = min(times, left)
            if used < times:
                put(room, filling, times - used)
            put(room - length, (*filling, length), used)
            left -= used
    return [(filling, times) for by in room_of.values() for filling, times in by.items()]


def fillings(counts: list[int], there: list[int], room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill `room` from the lengths `there` (ascending), least waste first.

    A filling is dominated when a piece left out could take the place of one
    or two of its pieces, or of none, and waste less.
    """
    if room <= 0 or not there or there[0] > room:
        return [()]
    if room < len(counts) and counts[room]:
        return [(room,)]  # one piece that fits exactly dominates all others
    found: set[tuple[int, ...]] = set()
    tops = there[:bisect_right(there, room)]
    for first in reversed(tops):  # two pieces that fit exactly
        second = room - first
        if second > first or len(found) >= most:
            break
        if counts[second] - (second == first) > 0:
            found.add((first, second))

    def largest(limit: int, taken: list[int]) -> int:
        at = bisect_right(there, limit)
        while at and counts[there[at - 1]] <= taken.count(there[at - 1]):
            at -= 1
        return there[at - 1] if at else 0

    def complete(taken: list[int], left: int) -> tuple[int, ...]:
        taken = list(taken)
        while left and (best := largest(left, taken)):
            times = min(left // best, counts[best] - taken.count(best))
            taken += [best] * times
            left -= best * times
        return tuple(sorted(taken, reverse=True))

    for i, first in enumerate(reversed(tops)):
        if i >= 8 or len(found) >= most:
            break
        found.add(complete([first], room - first))
        below = there[:bisect_right(there, min(first, room - first))]
        for second in below[-1:-4:-1]:
            if counts[second] > (second == first):
                found.add(complete([first, second], room - first - second))

    def dominated(filling: tuple[int, ...]) -> bool:
        slack = room - sum(filling)
        if not slack:
            return False
        sums = {0, *filling, *(a + b for i, a in enumerate(filling[:6]) for b in filling[i + 1:6])}
        for s in sums:
            for at in range(bisect_right(there, s), bisect_right(there, s + slack)):
                if counts[there[at]] > filling.count(there[at]):
                    return True
        return False

    kept = [f for f in found if not dominated(f)] or list(found)
    return sorted(kept, key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))


def solve(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """Few sequences for the counted lengths: bin completion, bounded by waste, with best-fit as first incumbent.

    The largest piece left is completed by one of its undominated fillings,
    as many times as the counts allow. A branch is cut when its waste already
    exceeds what one sequence less than the incumbent may waste. The search
    ends at the lower bound or after `nodes` nodes.
    """
    total = sum(length * n for length, n in histogram.items())
    best = best_fit(histogram, capacity)
    least = -(-total // capacity)

    def size(packing: list[Filling]) -> int:
        return sum(times for _, times in packing)

    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    there = sorted(histogram)
    path: list[tuple[Filling, int]] = []  # a filling in use, the waste before it
    choices: list[list[tuple[int, ...]]] = []
    waste, spent = 0, 0

    def take(filling: tuple[int, ...], sign: int, times: int) -> None:
        for length in filling:
            counts[length] -= sign * times
            at = bisect_left(there, length)
            if counts[length] and (at == len(there) or there[at] != length):
                there.insert(at, length)
            elif not counts[length] and at < len(there) and there[at] == length:
                del there[at]

    def options() -> list[tuple[int, ...]]:
        top = there[-1]
        counts[top] -= 1
        gone = not counts[top]
        if gone:
            there.pop()
        found = [(top, *f) for f in fillings(counts, there, capacity - top)]
        counts[top] += 1
        if gone:
            there.append(top)
        return found[::-1]  # the best is taken from the end

    while size(best) > least and spent < nodes:
        allowed = (size(best) - 1) * capacity - total
        if there and waste <= allowed:
            if len(choices) == len(path):
                choices.append(options())
                spent += 1
            if choices[-1]:
                filling = choices[-1].pop()
                times = min(counts[x] // filling.count(x) for x in set(filling))
                path.append(((filling, times), waste))
                take(filling, 1, times)
                waste += times * (capacity - sum(filling))
                continue
            choices.pop()
        elif not there and waste <= allowed:
            best = [f for f, _ in path]
            continue
        if not path:
            break
        (filling, times), waste = path.pop()
        take(filling, -1, times)
    return best


def places(packing: list[Filling]) -> np.ndarray:
    """Rows length, first rank, copies in the sequence, first sequence, first offset; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in packing:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            copies = filling.count(length)
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (any columns and a `length` of 1 to `capacity`) with sequence_id and offset.

    Every piece is in one sequence and none is longer than `capacity`; offsets
    in a sequence are gapless from 0. Equal lengths are dealt in any order.
    No pieces give no rows. Pieces should be narrow: they are shuffled once.
    """
    pieces = with_uid(pieces, "__bucket", ROWS_PER_BUCKET)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(solve(histogram, capacity))
    where = (table[:, 0] << 48) + table[:, 1]

    @pandas_udf("sequence_id long, offset long")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            lengths, ranks = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
            row = table[np.searchsorted(where, (lengths << 48) + ranks, "right") - 1]
            nth = ranks - row[:, 1]
            yield pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * lengths})

    columns = [c for c in pieces.columns if c not in ("__uid", "__bucket")]
    numbered = ranked(pieces, ["length"], "__bucket", ["__uid"], "__rank")
    return numbered.select(*columns, placed("length", "__rank").alias("p")).select(*columns, "p.*")
