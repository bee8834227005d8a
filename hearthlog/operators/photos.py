"""Photo table operators: imputed dates, duplicates, forwards, scan report."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import paths, text as tx
from .select import exact_rank

# ---- fixed values ----
SEED_SOURCES = ["exif", "filename"]
TIMELINE_SOURCES = ["exif", "filename", "exif_modified", "folder_median"]
MIN_SIBLINGS = 3
MIN_RANK = 2
# ---- end of fixed values ----


def folder_medians(photos: DataFrame, min_siblings: int = MIN_SIBLINGS) -> DataFrame:
    """(folder, median): upper median of the trusted dates in each full parent path."""
    seeds = photos.where(F.col("date_source").isin(SEED_SOURCES) & F.col("taken_at").isNotNull()).select(
        paths.parent(F.col("path")).alias("folder"), F.unix_micros("taken_at").alias("_us")
    )
    picked = exact_rank(seeds, "folder", "_us", lambda n: F.floor(n / 2), min_rows=min_siblings)
    return picked.select("folder", F.timestamp_micros("value").alias("median"))


def impute_dates(photos: DataFrame, min_siblings: int = MIN_SIBLINGS) -> DataFrame:
    """Give mtime-only photos their folder's median date."""
    with_folder = photos.withColumn("folder", paths.parent(F.col("path")))
    joined = with_folder.join(folder_medians(photos, min_siblings), "folder", "left")
    use = (F.col("date_source") == "mtime") & F.col("taken_at").isNotNull() & F.col("median").isNotNull()
    return (
        joined.withColumn("taken_at", F.when(use, F.col("median")).otherwise(F.col("taken_at")))
        .withColumn("date_source", F.when(use, "folder_median").otherwise(F.col("date_source")))
        .drop("folder", "median")
    )


def duplicates(files: DataFrame, content: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Point byte-identical files at one canonical copy.

    `files`: id, path, size, caption (and `content` when no reader is given).
    Sizes that occur once are dropped before any content is read or hashed; the
    group itself is never collected: its canonical row is a partial aggregate.
    Returns id, dupe_of, and the caption a canonical row inherits.
    """
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("size")
    colliding = files.join(sizes, "size", "left_semi")
    if content is not None:
        colliding = content(colliding)
    hashed = colliding.select(
        "id", "path", "caption", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")
    )
    order = F.struct(F.length("path").alias("a"), F.col("path").alias("b"), F.col("id").alias("c"))
    groups = (
        hashed.groupBy("sha256")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(order)["c"].alias("canonical"),
            F.min(F.when(F.col("caption").isNotNull(), F.struct(order.alias("o"), "caption")))["caption"].alias("_caption"),
        )
        .where(F.col("_n") > 1)
    )
    return hashed.join(groups, "sha256").select(
        "id",
        F.when(F.col("id") != F.col("canonical"), F.col("canonical")).alias("dupe_of"),
        F.when(F.col("id") == F.col("canonical"), F.coalesce("caption", "_caption")).otherwise(F.col("caption")).alias("caption"),
    )


def flag_forwards(photos: DataFrame) -> DataFrame:
    return photos.withColumn(
        "is_forward",
        F.when(F.col("caption").isNotNull(), tx.looks_forwarded(F.col("caption"))).otherwise(F.col("is_forward")),
    )


def pending_captions(photos: DataFrame) -> DataFrame:
    return photos.where(
        F.col("caption").isNull() & (F.col("rank") >= MIN_RANK) & F.col("dupe_of").isNull()
    )


def scan_report(photos: DataFrame) -> DataFrame:
    """Counts by rank, by date source, and by year of seed dates, in one pass."""
    trusted = F.col("date_source").isin(SEED_SOURCES)
    year = F.when(trusted, F.year("taken_at"))
    lines = F.array(
        F.struct(F.lit("rank").alias("measure"), F.col("rank").cast("string").alias("value")),
        F.struct(F.lit("date_source").alias("measure"), F.col("date_source").alias("value")),
        F.when(year.isNotNull(), F.struct(F.lit("year").alias("measure"), year.cast("string").alias("value"))),
        F.when(F.col("rank") >= MIN_RANK, F.struct(F.lit("usable").alias("measure"), F.lit("all").alias("value"))),
    )
    return (
        photos.select(F.explode(F.array_compact(lines)).alias("line"))
        .groupBy("line.measure", "line.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
