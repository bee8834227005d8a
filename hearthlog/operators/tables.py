"""Table upkeep on plain parquet: insert-or-ignore, upserts, slices, marks.

A change is computed as a new DataFrame; `buckets.change` writes only the hash
buckets that it touches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .select import first_wins

SEPARATOR = "\x1f"


def content_hash(
    source: Column, conversation_id: Column, ts: Column, speaker_name: Column, text: Column
) -> Column:
    """sha256 over the fields that make a message the same message."""
    iso = F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""),
    )
    parts = [source, conversation_id, iso, F.coalesce(speaker_name, F.lit("")), text]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def with_hash(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "content_hash",
        content_hash(*[F.col(c) for c in ("source", "conversation_id", "ts", "speaker_name", "text")]),
    )


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Incoming rows whose key is not stored yet, first one of each key."""
    fresh = first_wins(incoming, keys, *order) if order else incoming.dropDuplicates(keys)
    return fresh.join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row of each key by `version`; changes win over stored rows of the same version."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        changes.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return first_wins(both, keys, F.col(version).desc(), F.col("_new").desc()).drop("_new")


def replaced_slice(existing: DataFrame, column: str, values: list[str], fresh: DataFrame) -> DataFrame:
    """Rows of the given slices give way to `fresh`."""
    return existing.where(~F.col(column).isin(values) | F.col(column).isNull()).unionByName(fresh, allowMissingColumns=True)


def claimed(existing: DataFrame, files: DataFrame, key: str, count: str) -> DataFrame:
    """Rows with a count of -1 for the files that have no row yet; a file that crashes later is not tried again."""
    fresh = files.select(key).distinct().join(existing.select(key), key, "left_anti")
    return fresh.withColumn(count, F.lit(-1).cast(existing.schema[count].dataType))


def rewritten(existing: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The table with the rows of `changed` in place of those with their key."""
    return existing.join(changed.select(key), key, "left_anti").unionByName(changed)


def marked(existing: DataFrame, done: DataFrame, keys: list[str], column: str, value: Column) -> DataFrame:
    """Set `column` on rows whose key is in `done` and that carry no mark yet."""
    hits = done.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return existing.join(hits, keys, "left").withColumn(
        column, F.when(F.col("_hit") & F.col(column).isNull(), value).otherwise(F.col(column))
    ).drop("_hit")


def assigned(existing: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Overwrite `column` where `values` has the key."""
    side = values.select(*keys, F.col(column).alias("_value"), F.lit(True).alias("_hit"))
    return existing.join(side, keys, "left").withColumn(
        column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))
    ).drop("_value", "_hit")


def changed_rows(existing: DataFrame, recomputed: dict[str, Column]) -> DataFrame:
    """Rows where a recomputed column differs from the stored one, with the new values."""
    differs = F.lit(False)
    for name, column in recomputed.items():
        differs = differs | ~F.col(name).eqNullSafe(column)
    return existing.where(differs).withColumns(recomputed)


def reset_transcripts(segments: DataFrame, manifest: DataFrame, prefix: Column) -> tuple[DataFrame, DataFrame]:
    """Drop the transcripts and manifest rows of the files selected by `prefix`."""
    return segments.where(~prefix), manifest.where(~prefix)


def reset_labels(messages: DataFrame, sources: list[str] = ("call", "video")) -> DataFrame:
    """Messages without the rows promoted from calls."""
    return messages.where(~F.col("source").isin(list(sources)))


def reset_imputed(photos: DataFrame, mtimes: DataFrame) -> DataFrame:
    """Imputed dates go back to the file's modification time."""
    back = F.col("date_source") == "folder_median"
    return photos.join(mtimes.select("id", "mtime"), "id", "left").withColumns(
        {"taken_at": F.when(back, F.col("mtime")).otherwise(F.col("taken_at")),
         "date_source": F.when(back, "mtime").otherwise(F.col("date_source"))}
    ).drop("mtime")


def evolved(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns a table lacks, as NULL or with their default."""
    for name, ddl in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit((defaults or {}).get(name)).cast(ddl))
    return df


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) for an append-only log."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


# ---- writing ----------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = _fs(spark, path)
    return fs.exists(make(path))


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_log(rows: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Append to a log; every row is stamped with the time of the append."""
    append(rows.withColumn("created_at", F.current_timestamp()), path, partition_by)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """An export as JSON lines, in place of an earlier one."""
    manifest.write.mode("overwrite").json(folder)


def insert_messages(messages: DataFrame, path: str) -> int:
    """Append the messages not stored yet; returns how many were new.

    Equal hashes mean equal source and time, so only the stored partitions and
    row groups within the batch's sources and time span are read.
    """
    from ..session import checkpoint

    spark = messages.sparkSession
    fresh = checkpoint(first_wins(with_hash(messages), ["content_hash"], F.col("ts"), F.col("seq")))
    if exists(spark, path):
        span = fresh.agg(F.min("ts"), F.max("ts"), F.collect_set("source")).first()  # sources are few
        stored = spark.read.parquet(path).where(
            F.col("source").isin(span[2]) & F.col("ts").between(span[0], span[1])
        )
        fresh = checkpoint(fresh.join(stored.select("content_hash"), "content_hash", "left_anti"))
    n = fresh.count()
    if n:
        append(fresh.sortWithinPartitions("source", "ts"), path, ["source"])
    return n


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_splits(examples: DataFrame, folder: str) -> None:
    """`split=train` and `split=eval` folders of JSON lines holding only `messages`."""
    examples.select("split", "messages").write.mode("overwrite").partitionBy("split").json(folder)


def write_preferences(pairs: DataFrame, folder: str, stamp: str) -> bool:
    """One batch of preference pairs as JSON lines; nothing is written for an empty batch."""
    from ..session import checkpoint

    pairs = checkpoint(pairs.select("prompt", "chosen", "rejected", "counterpart"))
    if pairs.isEmpty():
        return False
    pairs.write.mode("overwrite").json(f"{folder}/dpo_{stamp}.jsonl")
    return True


def accepted_manifest(clips: DataFrame) -> DataFrame:
    return clips.where("accepted").orderBy("id").select(
        F.col("path").alias("audio"), F.col("question").alias("prompt"), "lang", "seconds",
        F.coalesce("transcript", F.lit("")).alias("transcript"),
    )


def rounded_manifest(clips: DataFrame) -> DataFrame:
    return clips.select(
        "source", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round("similarity", 3).alias("similarity"),
        F.round("speech_ratio", 3).alias("speech_ratio"), F.round("rms", 4).alias("rms"),
    )


def pending(column: str) -> Column:
    """Rows not handled yet: their status column is empty."""
    return F.col(column).isNull()
