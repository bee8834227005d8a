"""File listings, manifests and other file sources."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths, times
from ..operators.select import top_rows


def listing(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """path, mtime, size of the files with one of the suffixes; contents are never read. Files without a byte are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")
    ).transform(with_suffix, suffixes)


def with_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    return files.where(paths.suffix(F.col("path")).isin(suffixes))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, paths.AUDIO_SUFFIXES)


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, paths.VIDEO_SUFFIXES)


def photo_inventory(files: DataFrame, exif: DataFrame, as_of: Column, owner_names: list[str] = ()) -> DataFrame:
    """Photos of at least 20 000 bytes with date, its source, rank and folder hint.

    `exif`: path, capture, modified (strings).
    """
    rows = files.where(
        paths.suffix(F.col("path")).isin(paths.PHOTO_SUFFIXES) & (F.col("size") >= paths.MIN_PHOTO_BYTES)
    ).join(exif, "path", "left")
    date = times.photo_date(F.col("capture"), paths.file_name(F.col("path")), F.col("modified"), F.col("mtime"), as_of)
    return rows.withColumn("_d", date).select(
        "path", "size", F.col("_d.taken_at").alias("taken_at"), F.col("_d.date_source").alias("date_source"),
        paths.folder_rank(F.col("path"), owner_names).alias("rank"), paths.folder_hint(F.col("path")).alias("folder_hint"),
    )


READ_BYTES = 1 << 18
# file systems that workers can open; files of others are read whole by Spark
_OPENED = ("/", "file:", "hdfs:", "s3:", "s3a:", "gs:", "gcs:")


def file_hashes(listed: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """`listed` (path and any columns) with sha256, the digest of each file.

    Files are streamed where the task runs, `read_bytes` at a time, so none has
    to fit into memory or a row. A file that is gone by then has a null digest.
    """
    columns = [c for c in listed.columns if c != "sha256"]

    def digest(path: str) -> str | None:
        from pyarrow import fs

        if path.startswith(("/", "file:")):
            system, name = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        else:
            system, name = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/"))
        running = hashlib.sha256()
        try:
            with system.open_input_stream(name, compression=None, buffer_size=0) as stream:
                while data := stream.read(read_bytes):
                    running.update(data)
        except FileNotFoundError:
            return None
        return running.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    opened = F.lit(False)
    for start in _OPENED:
        opened = opened | F.startswith("path", F.lit(start))
    rows = listed.select(*columns)
    spark = listed.sparkSession
    streamed = rows.where(opened).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, f"{rows._jdf.schema().toDDL()}, sha256 string")
    others = [r[0] for r in rows.where(~opened).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()]  # folders
    if not others:
        return streamed
    whole = spark.read.format("binaryFile").load(others).select("path", F.sha2("content", 256).alias("sha256"))
    return streamed.unionByName(rows.where(~opened).join(whole, "path", "left"))


def unseen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, sha256) is not recorded: new ones and changed ones."""
    return files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def read_examples(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines examples; blank lines are skipped."""
    return spark.read.schema("messages array<struct<role:string,content:string>>").json(folder).where(
        F.col("messages").isNotNull()
    )


def folder_traces(paths_df: DataFrame, limit: int = 400) -> DataFrame:
    """First `limit` folders in name order."""
    folders = paths_df.select(paths.parent(F.col("path")).alias("folder")).where(F.col("folder") != "").distinct()
    return top_rows(folders, limit, F.col("folder"))
