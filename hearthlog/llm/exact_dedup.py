"""Exact duplicates with a heavy-hitter split.

A Misra-Gries pass finds the digests that may be frequent, an exact count
verifies them, and their few winners are broadcast: copies of frequent texts
are then decided inside the map tasks. All other digests are shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint
from .common import ascii_lower, whole, with_uid

# A digest is frequent when it holds more than this share of the rows. The
# summary holds 1 / SUPPORT digests, which also bounds what is broadcast.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    """SHA-256 of the whole text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(whole(text)), 256)


def frequent(ids: DataFrame, winner: Column, support: float = SUPPORT) -> DataFrame:
    """(digest, winner, group_size) of the digests with more than `support` of the rows of a stored `ids`."""
    guesses = ids.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = (ids.join(F.broadcast(guesses), "digest").groupBy("digest")
               .agg(F.count("*").alias("group_size"), F.max(winner).alias("winner")))
    return checkpoint(counted.where(F.col("group_size") > support * ids.count()))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays; a null key is smaller
    than any other. Rows that repeat key and text are a group like any other:
    exactly one of them is kept. Null texts equal the empty text. No rows give
    no rows. Other columns of `docs` are not read.
    """
    ids = with_uid(docs.select(F.col(key).alias("id"), digest(F.col(text)).alias("digest")))
    entry = F.struct("id", "__uid")
    heavy = frequent(ids, entry, support)
    of_digest = Window.partitionBy("digest")
    frequent_rows = ids.join(F.broadcast(heavy), "digest")
    other_rows = (ids.join(F.broadcast(heavy), "digest", "left_anti")
                  .withColumn("group_size", F.count("*").over(of_digest)).withColumn("winner", F.max(entry).over(of_digest)))
    return frequent_rows.unionByName(other_rows).select(
        F.col("id").alias(key), F.col("winner.id").alias("keep_id"), "group_size",
        (F.col("__uid") == F.col("winner.__uid")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The kept rows of `docs` with all their columns, whatever their names; see `ledger` for the choice.

    Copies of frequent texts are removed before the shuffle that compares the others.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), digest(F.col(text)).alias("digest"))
    ids = checkpoint(marked.select("id", "digest"))
    heavy = frequent(ids, F.struct("id"), support).select("digest", F.col("winner.id").alias("keep"), F.lit(True).alias("heavy"))
    left = marked.join(F.broadcast(heavy), "digest", "left").where(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("keep")))
    best = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last()))
    return left.withColumn("rank", best).where("rank = 1").select("row.*")
