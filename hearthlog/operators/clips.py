"""Voice-clip quality and selection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .select import top_rows

# ---- fixed values ----
MIN_CLIP_SECONDS, MAX_CLIP_SECONDS = 3.0, 90.0
MIN_RMS, MAX_CLIP_RATIO, MIN_BANDWIDTH_HZ = 0.01, 0.005, 6000.0
MIN_WINDOW_RMS, MIN_SPEECH_RATIO, LOUD_RMS = 0.02, 0.6, 0.05
MIN_SIMILARITY_NOTES, MIN_SIMILARITY_CALLS = 0.55, 0.40
# ---- end of fixed values ----


def clip_verdict(clips: DataFrame) -> DataFrame:
    """Add `problem` ('' when none) and `accepted`; a very long clip only warns."""
    problem = (
        F.when(F.col("seconds") < MIN_CLIP_SECONDS, "too short")
        .when(F.col("seconds") > MAX_CLIP_SECONDS, "very long")
        .when(F.col("rms") < MIN_RMS, "too quiet")
        .when(F.col("clip_ratio") > MAX_CLIP_RATIO, "clipping")
        .when(F.col("bandwidth_hz") < MIN_BANDWIDTH_HZ, "narrow band")
        .otherwise("")
    )
    return clips.withColumn("problem", problem).withColumn(
        "accepted", (F.col("problem") == "") | (F.col("seconds") > MAX_CLIP_SECONDS)
    )


def clip_score() -> Column:
    return F.col("similarity") * F.col("speech_ratio") * F.least(F.lit(1.0), F.col("rms") / LOUD_RMS)


def gated_windows(measures: DataFrame, min_similarity: float = MIN_SIMILARITY_NOTES) -> DataFrame:
    """Measured windows that sound like the owner, with their score."""
    return measures.where(
        (F.col("rms") >= MIN_WINDOW_RMS)
        & (F.col("speech_ratio") >= MIN_SPEECH_RATIO)
        & (F.col("similarity") >= min_similarity)
    ).withColumn("score", clip_score())


def sliding_windows(files: DataFrame, total: str, size: float = 8.0, hop: float = 4.0) -> DataFrame:
    """Full windows over each file; a file shorter than `size` gives one window of its own length."""
    width = F.least(F.lit(size), F.col(total))
    last = F.floor((F.col(total) - width) / F.lit(hop)).cast("int")
    return (
        files.where(F.col(total) > 0)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("start", F.col("_step") * F.lit(hop))
        .withColumn("end", F.col("start") + width)
        .drop("_step")
    )


def diverse_top(clips: DataFrame, source: str, score: str, tie: str, keep: int = 6) -> DataFrame:
    """Best clip of each source first, then the rest by score, `keep` rows in all.

    Ranks 1..keep within a source are enough to decide, so each source is cut
    to `keep` rows before the final sort.
    """
    by_source = Window.partitionBy(source).orderBy(F.col(score).desc(), F.col(tie))
    ranked = clips.withColumn("_rn", F.row_number().over(by_source)).where(F.col("_rn") <= keep)
    return top_rows(ranked, keep, F.col("_rn") > 1, F.col(score).desc(), F.col(tie)).drop("_rn")


def reference_segments(
    segments: DataFrame,
    langs: list[str] = ("hi", "pa", "en"),
    min_seconds: float = 6.0,
    max_seconds: float = 12.0,
    min_chars: int = 40,
    per_lang: int = 40,
) -> DataFrame:
    """The owner's longest texts in each language among medium-length segments."""
    picked = segments.where(
        (F.col("speaker") == "me")
        & F.col("lang").isin(list(langs))
        & (F.col("end_sec") - F.col("start_sec")).between(min_seconds, max_seconds)
        & (F.length("text") > min_chars)
    )
    longest = Window.partitionBy("lang").orderBy(F.length("text").desc(), "segment_id")
    return picked.withColumn("rank", F.row_number().over(longest)).where(F.col("rank") <= per_lang)
