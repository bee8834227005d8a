"""Conversation order: runs, utterances, scenes, context windows, histories."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx
from ..session import checkpoint, small_side
from .ordered import BLOCK, Layout, has_hot_keys, island_start, layout, look_back, running, sorted_stretches
from .select import first_wins, seeded, top_per_group, top_rows

# ---- fixed values ----
SCENE_CHARS, SCENE_GAP_HOURS, SCENE_MIN_CHARS = 900, 6.0, 60
UTTERANCE_GAP_MS = 2000
CONTEXT_TURNS, MIN_WORDS, MAX_WORDS, CONVERSATION_CAP = 6, 2, 250, 400
STANDALONE_WORDS, HISTORY_TURNS = 4, 8
# ---- end of fixed values ----

KEY, ORDER = ["conversation_id"], ["ts", "seq"]
# bytes of a folded text before the next part begins
PART_BYTES = 16 << 20


def ordered_join(items: Column, separator: str) -> Column:
    """Concatenate the last field of collected structs in the order of the others."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), separator)


def _folded(order: list[str], value: str, separator: str) -> Column:
    return ordered_join(F.collect_list(F.struct(*order, F.col(value).alias("v"))), separator)


def in_parts(lay: Layout, is_start: Column, text: str, part_bytes: int) -> Layout:
    """Add `part`, from 0 in each island: a part ends once its texts hold `part_bytes`.

    Places in an island are differences of one running sum, so islands of any
    size stay spread over the blocks of their key.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    lay = running(lay, size, "sum", "_upto")
    lay = running(lay, F.when(is_start, F.col("_upto") - size), "max", "_base")
    return lay.with_df(lay.df.withColumn("part", F.floor((F.col("_upto") - size - F.col("_base")) / part_bytes).cast("int")).drop("_upto", "_base"))


def merge_runs(turns: DataFrame, rows_per_block: int | None = None, cold: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """Consecutive turns of one speaker become one turn.

    (conversation_id, ts, seq) are those of the first turn, `last_ts` of the
    last. A run of more than `part_bytes` gives several turns, numbered by `part`.
    """
    lay = layout(turns, KEY, ORDER, rows_per_block, cold)
    lay = look_back(lay, 1, _previous=lambda w: F.lag("speaker").over(w))
    begins = ~F.coalesce(F.col("speaker") == F.col("_previous"), F.lit(False))
    lay = in_parts(island_start(lay, begins, "_run"), begins, "text", part_bytes)
    return (
        lay.df.groupBy(*KEY, "_run", "part")
        .agg(
            F.any_value("speaker").alias("speaker"),
            _folded(ORDER, "text", "\n").alias("text"),
            F.min(F.struct(*ORDER)).alias("_first"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("merged"),
        )
        .select(*KEY, F.col("_first.ts").alias("ts"), F.col("_first.seq").alias("seq"), "speaker", "text", "last_ts", "merged", "part")
    )


def merge_utterances(segments: DataFrame, gap_ms: int = UTTERANCE_GAP_MS, rows_per_block: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Segments of one speaker less than `gap_ms` apart become one utterance.

    The gap is measured from the end of the segment just before. An utterance of
    more than `part_bytes` gives several rows, numbered by `part`.
    """
    order = ["start_ms", "segment_id"]
    lay = layout(segments, ["audio_ref"], order, rows_per_block)
    lay = look_back(
        lay, 1,
        _speaker=lambda w: F.lag("speaker").over(w), _end=lambda w: F.lag("end_ms").over(w),
    )
    joins = F.coalesce(
        (F.col("speaker") == F.col("_speaker")) & (F.col("start_ms") - F.col("_end") < gap_ms), F.lit(False)
    )
    lay = in_parts(island_start(lay, ~joins, "_utterance"), ~joins, "text", part_bytes)
    return (
        lay.df.groupBy("audio_ref", "_utterance", "part")
        .agg(
            F.any_value("speaker").alias("speaker"),
            tx.strip(_folded(order, "text", " ")).alias("text"),
            F.min(F.struct(*order)).alias("_first"),
            F.count(F.lit(1)).alias("merged"),
        )
        .where(F.col("text") != "")
        .select("audio_ref", F.col("_first.start_ms").alias("start_ms"),
                F.col("_first.segment_id").alias("segment_id"), "speaker", "text", "merged", "part")
    )


def sessions(rows: DataFrame, keys: list[str], order: list[str], gap: Column, rows_per_block: int | None = None) -> DataFrame:
    """Add `session`: order values of the first row after a silence longer than `gap`."""
    lay = layout(rows, keys, order, rows_per_block)
    lay = look_back(lay, 1, _before=lambda w: F.lag(order[0]).over(w))
    starts = F.col("_before").isNull() | (F.col(order[0]) > F.col("_before") + gap)
    return island_start(lay, starts, "session").done().drop("_before")


# ---- scenes --------------------------------------------------------------------
#
# A scene ends before a line when the lines so far hold at least 900 characters
# or the silence exceeds six hours. Where it ends depends on where it began, so
# the fold is sequential; but all that one block hands to the next is the size
# of its open scene, which only matters up to the limit. Cut keys therefore
# compute, block by block and in parallel, what every possible size would turn
# into, and a small pass over the blocks picks the one that occurs.


class _Scenes:
    """Where scenes start in one ordered stretch of lines."""

    def __init__(self, sizes: np.ndarray, gaps: np.ndarray, limit: int):
        self.n, self.limit = len(sizes), limit
        self.total = np.concatenate([[0], np.cumsum(sizes)])
        self.gap_at = np.flatnonzero(gaps)

    def next_start(self, base: int, first: int) -> int:
        """First row from `first` on that finds a full scene or a gap; n when none."""
        full = max(int(np.searchsorted(self.total, base + self.limit, side="left")), first)
        at = int(np.searchsorted(self.gap_at, first))
        gap = int(self.gap_at[at]) if at < len(self.gap_at) else self.n
        return min(full, gap, self.n)

    def starts(self, carried: int) -> list[int]:
        """All scene starts when a scene of `carried` characters is open before row 0."""
        row = self.next_start(-carried, 0) if carried else 0
        found = []
        while row < self.n:
            found.append(row)
            row = self.next_start(self.total[row], row + 1)
        return found

    def ends(self) -> list[tuple[int, int | None]]:
        """(open size, row that opened it) at the end, for each carried size 0..limit.

        Chains of starts meet quickly, so each start is followed once.
        """
        known: dict[int, tuple[int, int]] = {}
        out = []
        for carried in range(self.limit + 1):
            row = self.next_start(-carried, 0) if carried else 0
            if row >= self.n:
                out.append((min(int(self.total[-1]) + carried, self.limit), None))
                continue
            path = []
            while row not in known:
                path.append(row)
                following = self.next_start(self.total[row], row + 1)
                if following >= self.n:
                    known[row] = (min(int(self.total[-1] - self.total[row]), self.limit), row)
                    break
                row = following
            known.update(dict.fromkeys(path, known[row]))
            out.append(known[row])
        return out


def scenes(
    rows: DataFrame, max_chars: int = SCENE_CHARS, max_gap_hours: float = SCENE_GAP_HOURS,
    min_chars: int = SCENE_MIN_CHARS, rows_per_block: int | None = None,
) -> DataFrame:
    """Readable scenes of each conversation: ts, seq of the first line, text, lines.

    The size check comes before a line is added, so a scene may exceed `max_chars`.
    """
    who = F.when(F.col("speaker") == "me", "Me").otherwise(
        F.coalesce(F.when(F.col("speaker_name") != "", F.col("speaker_name")), F.lit("Them"))
    )
    lines = rows.select(*KEY, *ORDER, "source", F.concat(who, F.lit(": "), F.col("text")).alias("line"))
    lay = layout(lines, KEY, ORDER, rows_per_block)
    lay = look_back(lay, 1, _before=lambda w: F.lag("ts").over(w))
    seconds = F.lit(max_gap_hours * 3600)
    gap = F.coalesce(
        (F.unix_micros("ts") - F.unix_micros("_before")) / 1e6 > seconds, F.lit(False)
    )
    df = lay.df.withColumn("_gap", gap).withColumn("_size", F.length("line")).drop("_before")
    lay = lay.with_df(df)
    marked = _mark_scenes(lay, max_chars)
    return (
        marked.groupBy(*KEY, "scene_ts", "scene_seq")
        .agg(
            _folded(ORDER, "line", "\n").alias("text"),
            F.count(F.lit(1)).alias("lines"),
            F.min_by("source", F.struct(*ORDER)).alias("source"),
        )
        .where(F.length("text") >= min_chars)
        .select(*KEY, F.col("scene_ts").alias("ts"), F.col("scene_seq").alias("seq"), "text", "lines", "source")
    )


def _mark_scenes(lay: Layout, limit: int) -> DataFrame:
    """Add scene_ts, scene_seq: order values of the line that opened the scene."""
    df = lay.df
    out = T.StructType(
        df.schema.fields + [T.StructField("scene_ts", T.TimestampType()), T.StructField("scene_seq", T.LongType())]
    )
    if lay.hot:
        df = df.join(F.broadcast(_entry_states(lay, limit)), [*KEY, BLOCK], "left")  # one row per block
    else:
        df = df.withColumns({"_carried": F.lit(0), "_open_ts": F.lit(None).cast("timestamp"), "_open_seq": F.lit(None).cast("long")})
    parts = lay.parts

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One pass over a sorted partition. The scene open at the end of an Arrow
        batch goes on into the next batch when the stretch does."""
        last, size, ts, seq = None, 0, pd.NaT, 0
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf.reset_index(drop=True)
            heads = (pdf[parts] != pdf[parts].shift()).any(axis=1).to_numpy()
            goes_on = tuple(pdf[parts].iloc[0]) == last
            bounds = np.flatnonzero(heads).tolist()  # row 0 is always a head here
            opener_ts, opener_seq = pdf["ts"].copy(), pdf["seq"].to_numpy(np.int64, copy=True)
            gaps, sizes = pdf["_gap"].to_numpy(bool), pdf["_size"].to_numpy()
            row_of = np.empty(len(pdf), np.int64)
            for lo, hi in zip(bounds, [*bounds[1:], len(pdf)]):
                if not (lo == 0 and goes_on):
                    carried = pdf["_carried"].iat[lo]
                    size = 0 if pd.isna(carried) else int(carried)
                    ts, seq = pdf["_open_ts"].iat[lo], pdf["_open_seq"].iat[lo]
                fold = _Scenes(sizes[lo:hi], gaps[lo:hi], limit)
                starts = fold.starts(size)
                row_of[lo:hi] = -1
                for s, e in zip(starts, [*starts[1:], hi - lo]):
                    row_of[lo + s : lo + e] = lo + s
                before = starts[0] if starts else hi - lo
                if before:
                    opener_ts.iloc[lo : lo + before] = ts
                    opener_seq[lo : lo + before] = int(seq)
                if starts:
                    size = int(fold.total[-1] - fold.total[starts[-1]])
                    ts, seq = pdf["ts"].iat[lo + starts[-1]], pdf["seq"].iat[lo + starts[-1]]
                else:
                    size += int(fold.total[-1])
            inside = row_of >= 0
            at = np.where(inside, row_of, np.arange(len(pdf)))
            pdf["scene_ts"] = opener_ts.where(~inside, opener_ts.take(at).set_axis(pdf.index))
            pdf["scene_seq"] = np.where(inside, opener_seq[at], opener_seq)
            last = tuple(pdf[parts].iloc[-1])
            yield pdf[[f.name for f in out.fields]]

    return sorted_stretches(lay.with_df(df)).mapInPandas(mark, out)


def _entry_states(lay: Layout, limit: int) -> DataFrame:
    """For each block of a cut key: size and first line of the scene open at its start."""
    schema = T.StructType(
        [*(lay.df.schema[k] for k in KEY), T.StructField(BLOCK, T.IntegerType()),
         T.StructField("after", T.ArrayType(T.IntegerType())),
         T.StructField("open_ts", T.ArrayType(T.TimestampType())), T.StructField("open_seq", T.ArrayType(T.LongType()))]
    )

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER, kind="stable").reset_index(drop=True)
        ends = _Scenes(pdf["_size"].to_numpy(), pdf["_gap"].to_numpy(bool), limit).ends()
        after = [size for size, _ in ends]
        ts = [None if row is None else pdf["ts"].iloc[row] for _, row in ends]
        seq = [None if row is None else int(pdf["seq"].iloc[row]) for _, row in ends]
        head = {k: [pdf[k].iloc[0]] for k in [*KEY, BLOCK]}
        return pd.DataFrame({**head, "after": [after], "open_ts": [ts], "open_seq": [seq]})

    entry = T.StructType(
        [*(lay.df.schema[k] for k in KEY), T.StructField(BLOCK, T.IntegerType()),
         T.StructField("_carried", T.IntegerType()), T.StructField("_open_ts", T.TimestampType()),
         T.StructField("_open_seq", T.LongType())]
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        size, ts, seq, rows = 0, None, None, []
        for _, r in pdf.sort_values(BLOCK).iterrows():
            rows.append((*[r[k] for k in KEY], r[BLOCK], size, ts, seq))
            if r["open_ts"][size] is not None and not pd.isna(r["open_ts"][size]):
                ts, seq = r["open_ts"][size], int(r["open_seq"][size])
            size = int(r["after"][size])
        return pd.DataFrame(rows, columns=[f.name for f in entry.fields])

    cut = lay.df.join(F.broadcast(lay.limits.select(*KEY)), KEY, "left_semi").select(*KEY, BLOCK, *ORDER, "_size", "_gap")
    tables = cut.groupBy(*KEY, BLOCK).applyInPandas(transfer, schema)
    return tables.groupBy(*KEY).applyInPandas(walk, entry)


# ---- training examples ----------------------------------------------------------


def context_candidates(
    merged: DataFrame, context_turns: int = CONTEXT_TURNS, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
    rows_per_block: int | None = None, cold: bool = False,
) -> DataFrame:
    """Owner turns with the turns before them, the cleaned reply and a drop reason."""
    lay = layout(merged, KEY, ORDER, rows_per_block, cold)
    lay = look_back(
        lay, context_turns,
        context=lambda w: F.collect_list(F.struct("speaker", "text")).over(w.rowsBetween(-context_turns, -1)),
    )
    own = lay.done().where((F.col("speaker") == "me") & (F.size("context") > 0))
    reply = tx.strip_media_markers(F.col("text"))
    return own.withColumn("reply", reply).select(
        *KEY, *ORDER, "last_ts", "context", "reply",
        F.coalesce(
            tx.target_problem(F.col("reply"), min_words, max_words),
            F.when(~F.exists("context", lambda t: t["speaker"] == "other"), "no_counterpart_context"),
        ).alias("drop_reason"),
        F.sha1(F.concat(F.element_at("context", -1)["text"], F.lit("\x1f"), F.col("reply"))).alias("pair_key"),
    )


def first_with_cap(
    candidates: DataFrame, key: str, group: str, order: list[str], cap: int | None, may_fill: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """First row of each key, taking the groups in turn, each stopping at `cap` kept rows, if there is a cap.

    Keys met after a group stopped stay free for later groups. Each round finds
    who owns each key, cuts the groups that reached the cap and frees what lay
    beyond; cuts only move earlier, so the rounds end with the exact answer.
    Returns the kept rows and the cuts (group, `_cut`), None when no group is full;
    `may_fill=False` says that no group has `cap` candidates.
    """
    turn = [F.col(group), *[F.col(c) for c in order]]
    if cap is None or not may_fill or not has_hot_keys(candidates, [group], cap - 1):
        return first_wins(candidates, [key], *turn), None
    ids = checkpoint(candidates.select(key, group, *order))
    here = F.struct(*order)
    cuts = None
    while True:
        owners = first_wins(before_cut(ids, cuts, group, order), [key], *turn)
        kept = top_per_group(owners, [group], cap, *turn[1:])
        found = checkpoint(
            kept.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.max(here).alias("_cut"))
            .where(F.col("_n") == cap).drop("_n")
        )
        if cuts is not None and found.exceptAll(cuts).isEmpty():
            break
        cuts = found
        if cuts.isEmpty():
            break
    return first_wins(before_cut(candidates, cuts, group, order), [key], *turn), cuts


def before_cut(rows: DataFrame, cuts: DataFrame | None, group: str, order: list[str]) -> DataFrame:
    """Rows up to and including their group's cut."""
    if cuts is None:
        return rows
    joined = rows.join(small_side(cuts), group, "left")
    return joined.where(F.col("_cut").isNull() | (F.struct(*order) <= F.col("_cut"))).drop("_cut")


def rendered_examples(kept: DataFrame, label: Column | None = None, system_prompt: str = "") -> DataFrame:
    """conversation_id, messages array<struct<role, content>>, last_ts."""
    parts = [F.lit(system_prompt) if system_prompt else None,
             F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("You are talking to "), label, F.lit("."))) if label is not None else None]
    system = F.concat_ws("\n\n", *[p for p in parts if p is not None]) if any(p is not None for p in parts) else F.lit("")
    context = F.filter(
        F.transform(
            "context",
            lambda t: F.struct(
                F.when(t["speaker"] == "other", "user").otherwise("assistant").alias("role"),
                tx.strip_media_markers(t["text"]).alias("content"),
            ),
        ),
        lambda m: m["content"] != "",
    )
    head = F.when(system != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(
        F.array().cast("array<struct<role:string,content:string>>")
    )
    reply = F.array(F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    return kept.select(
        *KEY, *ORDER, F.concat(head, context, reply).alias("messages"),
        F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_ts"),
    )


def normalized_messages(messages: Column, strict: bool = True, supports_system: bool = True) -> Column:
    """Shape one example for a chat template; NULL when nothing trainable remains.

    Leading assistant turns go, equal neighbours merge, the last turn must be
    the assistant's, and the system text stays first or joins the first turn.
    """
    system = F.filter(messages, lambda m: m["role"] == "system")
    turns = F.filter(messages, lambda m: m["role"] != "system")
    if strict:
        first = F.array_position(F.transform(turns, lambda m: m["role"] != "assistant"), F.lit(True)).cast("int")
        turns = F.when(first > 0, F.slice(turns, first, F.size(turns))).otherwise(F.slice(turns, 1, 0))

        def add(done: Column, m: Column) -> Column:
            last = F.element_at(done, -1)
            same = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["role"] == m["role"])
            joined = F.struct(m["role"].alias("role"), F.concat(last["content"], F.lit("\n"), m["content"]).alias("content"))
            return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
                F.concat(done, F.array(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
            )

        turns = F.aggregate(turns, F.array().cast("array<struct<role:string,content:string>>"), add)
    usable = (F.size(turns) >= 2) & (F.get(turns, F.size(turns) - 1)["role"] == "assistant")
    text = F.get(system, F.lit(0))["content"]
    if supports_system:
        with_system = F.concat(F.array(F.struct(F.lit("system").alias("role"), text.alias("content"))), turns)
    else:
        opening = F.get(turns, F.lit(0))
        folded = F.struct(opening["role"].alias("role"), F.concat(text, F.lit("\n\n"), opening["content"]).alias("content"))
        with_system = F.concat(F.array(folded), F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))))
    return F.when(usable, F.when(F.coalesce(text, F.lit("")) != "", with_system).otherwise(turns))


# ---- live windows ---------------------------------------------------------------


def retrieval_queries(turns: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Counterpart messages as search texts; a short one borrows the counterpart's
    words from the two turns before it."""
    lay = look_back(
        layout(turns, KEY, ORDER, rows_per_block), 2,
        _recent=lambda w: F.collect_list(F.struct("speaker", "text")).over(w.rowsBetween(-2, -1)),
    )
    recent = F.transform(F.filter("_recent", lambda r: r["speaker"] == "other"), lambda r: r["text"])
    short = F.size(tx.words(F.col("text"))) < STANDALONE_WORDS
    borrowed = tx.strip(F.array_join(F.concat(recent, F.array("text")), " "))
    return (
        lay.done().where(F.col("speaker") == "other")
        .withColumn("search_text", F.when(short, borrowed).otherwise(tx.strip(F.col("text"))))
        .drop("_recent")
    )


def recent_history(turns: DataFrame, turns_kept: int = HISTORY_TURNS, rows_per_block: int | None = None) -> DataFrame:
    """Each turn with the last `turns_kept` turns before it."""
    lay = look_back(
        layout(turns, KEY, ORDER, rows_per_block), turns_kept,
        history=lambda w: F.collect_list(F.struct("speaker", "text")).over(w.rowsBetween(-turns_kept, -1)),
    )
    return lay.done()


def conversation_slices(
    messages: DataFrame, n_conversations: int = 25, turns: int = 14, min_own: int = 4, seed: int | str = 7
) -> DataFrame:
    """First turns of a seeded choice among the longest conversations the owner took part in."""
    sizes = (
        messages.groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("speaker") == "me").alias("own"))
        .where(F.col("own") >= min_own)
    )
    longest = top_rows(sizes, n_conversations * 2, F.col("size").desc(), F.col("conversation_id"))
    picked = top_rows(longest.withColumn("_pick", seeded(seed, "conversation_id")), n_conversations, F.col("_pick")).select(*KEY)
    mine = messages.join(F.broadcast(picked), KEY, "left_semi")  # n_conversations rows
    return top_per_group(mine, KEY, turns, *[F.col(c) for c in ORDER])


def rendered_slices(slices: DataFrame, owner: str = "ME") -> DataFrame:
    """One prompt block for each conversation slice."""
    who = F.when(F.col("speaker") == "me", owner).otherwise("THEM")
    line = slices.withColumn("_line", F.concat(F.lit("  "), who, F.lit(": "), "text"))
    body = line.groupBy(*KEY).agg(_folded(ORDER, "_line", "\n").alias("body"))
    name = F.when(F.instr("conversation_id", ":") > 0, F.expr("substr(conversation_id, instr(conversation_id, ':') + 1)")).otherwise(F.col("conversation_id"))
    return body.select(*KEY, F.concat(F.lit("--- conversation with "), name, F.lit(" ---\n"), "body").alias("block"))


def evidence_turns(turns: DataFrame, min_ms: int = 1000, budget_ms: int = 60_000) -> DataFrame:
    """Longest turns of each (call, label) until they hold `budget_ms`.

    Every counted turn lasts at least `min_ms`, so budget/min rows suffice.
    """
    groups = ["audio_ref", "label"]
    length = F.col("end_ms") - F.col("start_ms")
    longest = top_per_group(
        turns.where(length >= min_ms).withColumn("length_ms", length), groups, budget_ms // min_ms,
        F.col("length_ms").desc(), F.col("start_ms"), F.col("turn_id"),
    )
    w = Window.partitionBy(*groups).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return longest.withColumn("before_ms", F.coalesce(F.sum("length_ms").over(w), F.lit(0))).where(F.col("before_ms") < budget_ms)


def folded_by_file(rows: DataFrame, key: str, order: list[str], text: str, separator: str = " ", rows_per_block: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One text for each file: its pieces in order, blank results dropped.

    A file of more than `part_bytes` gives several texts, numbered by `part`.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    lay = running(layout(rows, [key], order, rows_per_block), size, "sum", "_upto")
    parts = lay.done().withColumn("part", F.floor((F.col("_upto") - size) / part_bytes).cast("int"))
    return (
        parts.groupBy(key, "part").agg(tx.strip(_folded(order, text, separator)).alias("text"), F.count(F.lit(1)).alias("pieces"))
        .where(F.col("text") != "").select(key, "text", "pieces", "part")
    )
