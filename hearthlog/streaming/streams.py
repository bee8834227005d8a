"""Structured Streaming forms of the incremental and live operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import guard
from ..operators import tables as tb
from ..operators.moods import FRESH_MINUTES, MOODS, usable
from ..session import checkpoint, is_small, scratch_dir

# ---- fixed values ----
FRAME_MS, SPEECH_PROBABILITY = 32, 0.5
SILENCE_TO_END_MS, MIN_SPEECH_MS, MAX_TURN_MS = 900, 400, 30_000
REFUSAL = "That is not something to answer here. Please ask about something else."
# ---- end of fixed values ----


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over the files of one table."""
    path = f"{folder}/{name}*.parquet"
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def run_to_end(stream: DataFrame, path: str, state: str) -> DataFrame:
    """Process everything available into a parquet sink and return its rows."""
    query = (stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("append")
             .format("parquet").option("path", path).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_changes(stream: DataFrame, path: str, state: str, keys: list[str], *newest: str) -> DataFrame:
    """Process everything available and return the newest row of each key.

    Every micro-batch adds the rows it changed to the sink, in a folder of its
    own that a replay overwrites. State ends with the watermark. `newest` orders
    the changes of a key; by default the later batch wins.
    """
    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_at={number}")

    query = (stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("update")
             .foreachBatch(handle).start())
    query.awaitTermination()
    spark = stream.sparkSession
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_at", T.LongType())])).parquet(path)
    last = F.max_by(F.struct(*stream.columns), F.struct(*newest, "_at")).alias("_row")
    return changes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select("_row.*")


def with_closing_rows(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and the rows of a folder, which is made if need be.

    A row put there after the stream's end, later than all by the delay and the
    gap, moves the watermark on, so that append mode emits the last windows.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def run_batches(stream: DataFrame, state: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()


def ingest(stream: DataFrame, path: str, state: str) -> None:
    """Messages into the table at `path`; a replayed batch or file adds nothing."""

    def handle(batch: DataFrame, _: int) -> None:
        tb.insert_messages(batch, path)

    run_batches(stream, state, handle)


# states of a file in the ledger, the last to come counts
CLAIMED, ALONE, ASIDE, DONE = 1, 2, 3, 4


def ledger_states(spark: SparkSession, ledger: str) -> DataFrame:
    """file, state of every file the ledger names."""
    if not tb.exists(spark, ledger):
        return spark.createDataFrame([], "file string, state int")
    return spark.read.parquet(ledger).groupBy("file").agg(F.max("state").alias("state"))


def ingest_claimed(stream: DataFrame, work: Callable[[DataFrame], None], ledger: str, state: str) -> None:
    """`work` on the rows of each new file of a file stream, with a ledger of claims.

    `stream` has the column `file` (`_metadata.file_path`). A batch claims its
    files before the work and closes the claims after it. If the work died, the
    next start finds open claims and gives those files to the work one by one;
    a file that dies alone is set aside at the start after that, and the stream
    goes on without it. Work must bear repetition, as in any batch that is
    tried again.
    """

    def note(files: DataFrame, what: int, batch: int) -> None:
        files.select("file", F.lit(batch).alias("batch"), F.lit(what).alias("state"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(ledger)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = batch.select("file").distinct().join(ledger_states(spark, ledger), "file", "left")
        known = checkpoint(files)
        fresh = known.where("state IS NULL").select("file")
        open_ones = [r["file"] for r in known.where(F.col("state") == CLAIMED).orderBy("file").collect()]  # files of one trigger
        note(known.where(F.col("state") == ALONE), ASIDE, number)
        for file in open_ones:
            one = known.where(F.col("file") == file).select("file")
            note(one, ALONE, number)
            work(batch.where(F.col("file") == file))
            note(one, DONE, number)
        if not fresh.isEmpty():
            note(fresh, CLAIMED, number)
            work(batch.join(F.broadcast(fresh), "file", "left_semi"))  # files of one trigger
            note(fresh, DONE, number)

    run_batches(stream, state, handle)


def deduplicated(messages: DataFrame, ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """First row of each content hash within the watermark delay."""
    return tb.with_hash(messages).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def mood_windows(moods: DataFrame, width: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Strongest mood of each user in each event-time window, score averaged over its readings.

    A map-side sum for each mood keeps the state at one row for each window.
    """
    sums = [F.sum(F.when(F.col("mood") == m, F.col("score")).otherwise(0.0)).alias(m) for m in MOODS]
    w = (
        moods.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", width), "user_id")
        .agg(F.count(F.lit(1)).alias("readings"), *sums)
    )
    best = F.greatest(*MOODS)
    name = F.coalesce(*[F.when(F.col(m) == best, F.lit(m)) for m in MOODS])
    return w.select("user_id", F.col("window.start").alias("start"), name.alias("mood"), (best / F.col("readings")).alias("score"), "readings")


def latest_state(moods: DataFrame, width: str = f"{FRESH_MINUTES} minutes", delay: str = f"{FRESH_MINUTES} minutes") -> DataFrame:
    """Latest reading of each user in each stretch of `width`.

    A reading older than that is never used, so state need not outlive the
    watermark; the sink's newest row of a user is the user's state.
    """
    return moods.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "user_id").agg(
        F.max_by(F.struct("id", "mood", "score", "created_at"), F.struct("created_at", "id")).alias("m")
    ).select("user_id", "m.*")


def fresh_state(latest: DataFrame, as_of: Column) -> DataFrame:
    return latest.where(usable(as_of))


def conversation_sessions(rows: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Sessions of each key that end after a silence longer than `gap`."""
    return (
        rows.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
        .select(key, "first", "last", "n")
    )


def index_diary(entries: DataFrame, memories_path: str, log_path: str, state: str) -> None:
    """New diary rows become memories; their ids go to the processed log afterwards.

    A batch that is replayed after a failure finds its memories by id and skips them.
    """
    from ..functions import text as tx

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id"])
        if tb.exists(spark, memories_path):
            lo, hi = batch.agg(F.min("id"), F.max("id")).first()  # ids rise, so old files are skipped
            stored = spark.read.parquet(memories_path).where(F.col("entry_id").between(lo, hi)).select(
                F.col("entry_id").alias("id")
            )
            fresh = fresh.join(stored, "id", "left_anti")
        memories = fresh.select(
            F.col("id").alias("entry_id"), tx.diary_sentence(F.col("day"), F.col("text")).alias("text"),
            F.lit("diary").alias("kind"), F.lit("diary").alias("source"), F.col("day").cast("timestamp").alias("ts"),
            F.concat(F.lit("diary:"), F.col("id").cast("string")).alias("conversation_id"), F.lit("secret").alias("trust"),
        )
        tb.append(memories, memories_path)
        tb.append(fresh.select("id"), log_path)

    run_batches(entries, state, handle)


def guarded_turns(messages: DataFrame, kinds: list[str], owner_names: list[str] = ()) -> DataFrame:
    """Audit rows for guest messages and the replies given to them.

    `messages`: created_at, guest (boolean), message, reply. Owner turns are never logged.
    """
    reason = guard.attack_reason(F.col("message"), owner_names)
    redacted = guard.redact(F.col("reply"), kinds)
    found = F.array_sort(F.array_distinct(F.transform(guard.pii_values(F.col("reply"), kinds), lambda f: f["kind"])))
    return (
        messages.where("guest")
        .withColumns({"blocked_reason": reason, "_found": found})
        .withColumn(
            "outcome",
            F.when(F.col("blocked_reason").isNotNull(), "refused").when(F.size("_found") > 0, "redacted").otherwise("answered"),
        )
        .withColumn("redactions", F.when(F.col("outcome") == "redacted", F.col("_found")))
        .withColumn("reply", F.when(F.col("outcome") == "refused", REFUSAL).otherwise(redacted))
        .drop("_found", "guest")
    )


def audit_windows(turns: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Outcome counts by event-time window; rows later than the watermark are dropped."""
    return (
        turns.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", width), "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("window.start").alias("day"), "outcome", "n")
    )


# ---- spoken turns -----------------------------------------------------------------

TURN_SCHEMA = T.StructType([
    T.StructField("session", T.LongType()), T.StructField("first_frame", T.LongType()),
    T.StructField("frames", T.IntegerType()), T.StructField("speech_ms", T.IntegerType()),
])
_IDLE = (-1, 0, 0, 0)  # first frame, collected frames, silence ms, speech ms


def _step(state: tuple, frame: int, speech: bool) -> tuple[tuple, tuple | None]:
    """One frame: next state, and the turn it completes."""
    first, collected, silence, spoken = state
    if first < 0 and not speech:
        return _IDLE, None
    first = frame if first < 0 else first
    collected += 1
    silence, spoken = (0, spoken + FRAME_MS) if speech else (silence + FRAME_MS, spoken)
    if silence >= SILENCE_TO_END_MS:
        return _IDLE, (first, collected, spoken) if spoken >= MIN_SPEECH_MS else None
    if collected * FRAME_MS > MAX_TURN_MS:
        return _IDLE, (first, collected, spoken)
    return (first, collected, silence, spoken), None


def _steps(state: tuple, frames: np.ndarray, speech: np.ndarray) -> tuple[tuple, list[tuple]]:
    """`_step` over frames in order, turn by turn: next state, and the turns completed."""
    first, collected, silence, spoken = state
    n, i, done = len(frames), 0, []
    said = np.concatenate(([0], np.cumsum(speech)))
    spoke = np.flatnonzero(speech)
    gaps = np.diff(np.append(spoke, n)) - 1
    ends = spoke[gaps >= _QUIET] + _QUIET  # where silence that follows speech is long enough
    while i < n:
        if first < 0:
            place = np.searchsorted(spoke, i)
            if place == len(spoke):
                break
            i = int(spoke[place])
            first, collected, silence, spoken = int(frames[i]), 0, 0, 0
        quiet = i + _QUIET - silence // FRAME_MS - 1  # if no speech comes before
        if said[min(quiet + 1, n)] > said[i]:
            place = np.searchsorted(ends, i)
            quiet = int(ends[place]) if place < len(ends) else n
        end = min(quiet, i + _LONGEST - collected - 1)
        last = min(end + 1, n)
        spoken += int(said[last] - said[i]) * FRAME_MS
        collected += last - i
        if end >= n:
            silence = (n - 1 - int(spoke[-1])) * FRAME_MS if said[n] > said[i] else silence + (n - i) * FRAME_MS
            return (first, collected, silence, spoken), done
        if end < quiet or spoken >= MIN_SPEECH_MS:
            done.append((first, collected, spoken))
        (first, collected, silence, spoken), i = _IDLE, end + 1
    return (first, collected, silence, spoken), done


def packed_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row (session, frames, speech) for each session of a batch of (session, frame, probability)."""
    for pdf in batches:
        if len(pdf):
            order = np.argsort(pdf["session"].to_numpy(), kind="stable")
            sessions, starts = np.unique(pdf["session"].to_numpy()[order], return_index=True)
            speech = pdf["probability"].to_numpy()[order] >= SPEECH_PROBABILITY
            yield pd.DataFrame({"session": sessions, "frames": np.split(pdf["frame"].to_numpy(np.int64)[order], starts[1:]), "speech": np.split(speech, starts[1:])})


class TurnDetector(StatefulProcessor):
    """Keeps the open turn of each session between micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "first long, collected int, silence int, spoken int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        state = tuple(self._open.get() or _IDLE)
        runs = pd.concat(list(rows))
        frames, speech = np.concatenate(runs["frames"].to_list()), np.concatenate(runs["speech"].to_list())
        order = np.argsort(frames, kind="stable")
        after, done = _steps(state, frames[order], speech[order].astype(bool))
        if after != state:
            self._open.update(tuple(int(x) for x in after))
        yield pd.DataFrame([(key[0], *turn) for turn in done], columns=TURN_SCHEMA.fieldNames())

    def close(self) -> None:
        pass


def spoken_turns_stream(frames: DataFrame) -> DataFrame:
    """Completed turns from (session, frame, probability); needs the RocksDB state store.

    A session's frames of a batch of rows travel as one row, as the state's side takes rows one by one.
    """
    return frames.select("session", "frame", "probability").mapInPandas(packed_frames, "session long, frames array<long>, speech array<boolean>").groupBy("session").transformWithStateInPandas(
        statefulProcessor=TurnDetector(), outputStructType=TURN_SCHEMA, outputMode="Append", timeMode="None"
    )


# A turn that is not ended by silence has so many frames; silence of so many ends one.
_LONGEST, _QUIET = MAX_TURN_MS // FRAME_MS + 1, -(-SILENCE_TO_END_MS // FRAME_MS)
TURNS_PER_BLOCK = 64


def next_starts(at: np.ndarray, wanted: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First turn that starts at or after each of `wanted`, followed from turn to turn through ascending speech frames `at`.

    Returns where a start is wanted after those below `end`, and the starts of the last of `wanted`.
    """
    wanted, starts = wanted.copy(), []
    while True:
        place = np.searchsorted(at, wanted)
        live = (wanted < end) & (place < len(at))
        if not live.any():
            return wanted, np.array(starts, np.int64)
        found = at[np.minimum(place, len(at) - 1)]
        if live[-1]:
            starts.append(found[-1])
        wanted = np.where(live, found + _LONGEST, wanted)


def long_stretch_starts(rows: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """The rows of `rows` (session, part, at and others), the speech frames of long stretches, that begin a turn.

    A turn's start fixes the next one: the first speech after it is full. A block
    of frames maps every place where a start may be wanted to the place where
    the next block is asked; the maps are composed along the stretch, and each
    block then follows its own turns. No task reads a whole stretch.
    """
    width, names = turns_per_block * _LONGEST, rows.columns
    blocks = rows.withColumn("block", F.floor((F.col("at") - F.col("part")) / width).cast("long"))
    maps = "session long, part long, block long, places array<long>, asked array<long>"

    def mapped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        session, part, block = key
        at, begin = np.sort(pdf["at"].to_numpy(np.int64)), part + block * width
        places = at[at < begin + _LONGEST + _QUIET]
        asked, _ = next_starts(at, places, begin + width)
        return pd.DataFrame({"session": [session], "part": [part], "block": [block], "places": [places], "asked": [asked]})

    def composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, wanted, entries = pdf.sort_values("block"), key[1], []
        for places, asked in zip(pdf["places"], pdf["asked"]):
            entries.append(wanted)
            place = np.searchsorted(places, wanted)
            wanted = asked[place] if place < len(places) else wanted
        return pd.DataFrame({"session": key[0], "part": key[1], "block": pdf["block"], "entry": entries})

    def followed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["at"].to_numpy(np.int64))
        _, starts = next_starts(at, np.array([pdf["entry"].iloc[0]], np.int64), key[1] + (key[2] + 1) * width)
        return pdf.loc[pdf["at"].isin(starts), names]

    steps = blocks.select("session", "part", "at", "block").groupBy("session", "part", "block").applyInPandas(mapped, maps)
    entries = steps.groupBy("session", "part").applyInPandas(composed, "session long, part long, block long, entry long")
    return blocks.join(entries.hint("merge"), ["session", "part", "block"]).groupBy("session", "part", "block").applyInPandas(followed, rows.schema)


def spoken_turns(frames: DataFrame, rows_per_block: int | None = None, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """Batch twin: completed turns of each session.

    Silence of 900 ms leaves the detector idle whatever came before, so speech
    frames apart by that much begin stretches of their own. A stretch that fits
    into one turn is one; longer ones are followed by `long_stretch_starts`.
    All else is differences of running counts.
    """
    from ..operators.ordered import layout, running

    speech = F.col("probability") >= SPEECH_PROBABILITY
    lay = running(layout(frames, ["session"], ["frame"], rows_per_block), F.lit(1).cast("long"), "sum", "at")
    lay = running(lay, F.when(speech, F.col("at")), "max", "_before", inclusive=False)
    begins = speech & (F.col("_before").isNull() | (F.col("at") - F.col("_before") > _QUIET))
    lay = running(running(lay, F.when(begins, F.col("at")), "max", "part"), speech.cast("long"), "sum", "said")
    last = frames.groupBy("session").agg(F.count(F.lit(1)).alias("_frames"))
    path = scratch_dir(frames.sparkSession, "spoken")
    lay.done().where(speech).select("session", "part", "at", "frame", "said").write.parquet(path)
    spoken = frames.sparkSession.read.parquet(path)
    stretches = checkpoint(spoken.groupBy("session", "part").agg(
        F.min("frame").alias("frame"), F.min("said").alias("said"), F.max("at").alias("_end"), F.max("said").alias("_said")))
    is_long = F.col("_end") + _QUIET - F.col("part") >= _LONGEST
    short = stretches.where(~is_long).withColumns({"at": F.col("part"), "_heard": F.col("_said") - F.col("said") + 1})
    long_ones = stretches.where(is_long).drop("frame", "said")
    # joins of many narrow rows are merged: small on disk, they would be large as a table at the driver
    named = long_ones.select("session", "part")
    in_long = spoken.join(F.broadcast(named) if is_small(named) else named.hint("merge"), ["session", "part"])
    ordered = Window.partitionBy("session", "part").orderBy("at")  # one row for a turn
    heard = F.coalesce(F.lead("said").over(ordered) - 1, F.col("_said")) - F.col("said") + 1
    followed = long_stretch_starts(in_long, turns_per_block).join(long_ones.hint("merge"), ["session", "part"]).withColumn("_heard", heard)
    turns = short.unionByName(followed).join(last.hint("merge"), "session")
    quiet_end = F.col("_end") + _QUIET - F.col("at") + 1  # frames of a turn that silence ends
    by_silence = quiet_end <= _LONGEST
    length = F.when(by_silence, quiet_end).otherwise(_LONGEST)
    turns = turns.select("session", F.col("frame").alias("first_frame"), length.cast("int").alias("frames"), (F.col("_heard") * FRAME_MS).cast("int").alias("speech_ms"), by_silence.alias("_silence"), (F.col("at") + length - 1 <= F.col("_frames")).alias("_ended"))
    return turns.where(F.col("_ended") & (~F.col("_silence") | (F.col("speech_ms") >= MIN_SPEECH_MS))).drop("_silence", "_ended")


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, state) folders of one run."""
    return scratch_dir(spark, name), scratch_dir(spark, name + "-state")
