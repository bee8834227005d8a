"""Reports over messages, diary, audit, moods, clips and manifests.

All of them are partial aggregates: what reaches a report row has been counted
in the map tasks first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values ----
TARGET_MINUTES = 45.0
MIN_MOOD_SCORE = 0.35
# ---- end of fixed values ----


def corpus_stats(messages: DataFrame) -> DataFrame:
    """measure, value, n: rows by source and by speaker, conversations, total."""
    counted = messages.groupBy("source", "speaker", "conversation_id").agg(F.count(F.lit(1)).alias("_n"))
    lines = F.array(
        F.struct(F.lit("source").alias("measure"), F.col("source").alias("value")),
        F.struct(F.lit("speaker").alias("measure"), F.col("speaker").alias("value")),
        F.struct(F.lit("messages").alias("measure"), F.lit("all").alias("value")),
    )
    rows = counted.select("_n", F.explode(lines).alias("l")).groupBy("l.measure", "l.value").agg(F.sum("_n").alias("n"))
    convs = counted.agg(F.countDistinct("conversation_id").alias("n")).select(
        F.lit("conversations").alias("measure"), F.lit("all").alias("value"), "n"
    )
    return rows.unionByName(convs)


def diary_stats(entries: DataFrame, feedback: DataFrame) -> DataFrame:
    """measure, n: one aggregate over each table."""
    e = entries.agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("day").alias("days"),
        F.count_if(F.col("indexed_at").isNull()).alias("unindexed"),
    )
    ready = F.col("exported_at").isNull() & (F.length(F.trim(F.coalesce("chosen", F.lit("")))) > 0)
    f = feedback.agg(
        F.count(F.lit(1)).alias("feedback"), F.count_if(ready).alias("pairs_ready"),
        F.count_if(F.col("verdict") == "down").alias("thumbs_down"),
    )
    unpivot = lambda df: df.unpivot([], df.columns, "measure", "n")
    return unpivot(e).unionByName(unpivot(f))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most common non-null value of each key; the smaller value wins ties."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), value)).alias("_m")).select(
        key, F.col(f"_m.{value}").alias(value), F.col("_m.n").alias("n")
    )


def people_report(faces: DataFrame, photos: DataFrame, show: int) -> DataFrame:
    """person, faces, photos, first and last day; the `show` most frequent.

    Counts go through (person, photo) pairs, so the join sees each pair once and
    a person who appears in a third of all faces is counted in the map tasks.
    """
    pairs = faces.groupBy("person", "photo_id").agg(F.count(F.lit(1)).alias("_n"))
    dated = photos.select(F.col("id").alias("photo_id"), F.to_date("taken_at").alias("_day"))
    return (
        pairs.join(dated, "photo_id")
        .groupBy("person")
        .agg(F.sum("_n").alias("faces"), F.count(F.lit(1)).alias("photos"), F.min("_day").alias("first_day"), F.max("_day").alias("last_day"))
        .orderBy(F.col("faces").desc(), "person")
        .limit(show)
    )


def talkative_conversations(messages: DataFrame, min_own: int = 4) -> DataFrame:
    return (
        messages.groupBy("conversation_id")
        .agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("speaker") == "me").alias("own"))
        .where(F.col("own") >= min_own)
    )


def audit_digest(turns: DataFrame, since: Column) -> DataFrame:
    """measure, value, n: turns, outcomes and redaction kinds since a time, in one pass."""
    lines = F.concat(
        F.array(
            F.struct(F.lit("turns").alias("measure"), F.lit("all").alias("value")),
            F.struct(F.lit("outcome").alias("measure"), F.col("outcome").alias("value")),
        ),
        F.transform(
            F.coalesce("redactions", F.array().cast("array<string>")),
            lambda k: F.struct(F.lit("redaction").alias("measure"), k.alias("value")),
        ),
    )
    return (
        turns.where(F.col("created_at") >= since)
        .select(F.explode(lines).alias("l"))
        .groupBy("l.measure", "l.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mood_timeline(moods: DataFrame, since: Column) -> DataFrame:
    return (
        moods.where((F.col("created_at") >= since) & (F.col("score") >= MIN_MOOD_SCORE))
        .groupBy(F.to_date("created_at").alias("day"), "mood")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def memory_breakdown(memories: DataFrame) -> DataFrame:
    """measure, value, n, first, last over kind, source and trust in one grouping-sets pass."""
    sets = memories.groupingSets([["kind"], ["source"], ["trust"]], "kind", "source", "trust").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.grouping("kind").alias("_gk"), F.grouping("source").alias("_gs"),
    )
    measure = F.when(F.col("_gk") == 0, "kind").when(F.col("_gs") == 0, "source").otherwise("trust")
    value = F.when(F.col("_gk") == 0, F.col("kind")).when(F.col("_gs") == 0, F.col("source")).otherwise(F.col("trust"))
    return sets.select(measure.alias("measure"), value.alias("value"), "n", "first", "last")


def recording_progress(clips: DataFrame) -> DataFrame:
    """measure, value: minutes, percent of target, minutes of each language, rejected."""
    by_lang = clips.groupBy("lang").agg(
        F.sum(F.when(F.col("accepted"), F.col("seconds")).otherwise(0.0)).alias("_s"),
        F.count_if("accepted").alias("_a"), F.count_if(~F.col("accepted")).alias("_r"),
    )
    total = by_lang.agg(F.sum("_s").alias("s"), F.sum("_a").alias("a"), F.sum("_r").alias("r"))
    lines = F.array(
        F.struct(F.lit("clips").alias("measure"), F.col("a").cast("double").alias("value")),
        F.struct(F.lit("minutes").alias("measure"), F.round(F.col("s") / 60, 1).alias("value")),
        F.struct(F.lit("pct").alias("measure"), F.round(F.least(F.lit(100.0), F.col("s") / 60 * 100 / TARGET_MINUTES), 1).alias("value")),
        F.struct(F.lit("rejected").alias("measure"), F.col("r").cast("double").alias("value")),
    )
    langs = by_lang.where(F.col("_a") > 0).select(
        F.concat(F.lit("minutes:"), "lang").alias("measure"), F.round(F.col("_s") / 60, 1).alias("value")
    )
    return total.select(F.explode(lines).alias("l")).select("l.measure", "l.value").unionByName(langs)


def manifest_status(files: DataFrame, state: DataFrame) -> DataFrame:
    """klass, total, done, bytes of a file manifest and its download state."""
    return (
        files.join(state, "id", "left")
        .groupBy("klass")
        .agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("done", F.lit(False))).alias("done"),
            F.sum(F.when(F.col("done"), F.col("bytes")).otherwise(0)).alias("bytes"),
        )
    )


def file_report(messages: DataFrame, key: str, new: Column) -> DataFrame:
    """Parsed, new, owner and other rows of each file; warns when no row is the owner's."""
    return messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("parsed"), F.count_if(new).alias("new"),
        F.count_if(F.col("speaker") == "me").alias("own"), F.count_if(F.col("speaker") != "me").alias("other"),
        (F.count_if(F.col("speaker") == "me") == 0).alias("no_owner"),
    )


def by_day(entries: DataFrame, ts: str) -> DataFrame:
    """day, n, newest: entries under their day."""
    return entries.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest"))
