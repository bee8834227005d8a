"""Preference pairs out of corrections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

# ---- fixed values ----
MIN_DIFFERENCE = 0.12
# ---- end of fixed values ----

WORD = r"[^\x20\x09-\x0D]+"


def preference_pairs(feedback: DataFrame) -> DataFrame:
    """Pending corrections with `usable`: the rewrite is present and differs enough.

    Two answers are alike by the share of words they have in common, repeats
    counted. Every returned row counts as handled, usable or not. `id` is unique.
    """
    rows = feedback.where(F.col("exported_at").isNull() & (F.length(F.trim(F.coalesce("chosen", F.lit("")))) > 0)).select(
        "id", "prompt", tx.strip(F.col("chosen")).alias("chosen"), tx.strip(F.col("rejected")).alias("rejected"),
        F.coalesce("counterpart", F.lit("")).alias("counterpart"),
    )
    scored = rows.join(shared_words(rows, "id", "chosen", "rejected"), "id", "left")
    too_close = F.coalesce(F.col("similarity") > 1.0 - MIN_DIFFERENCE, F.lit(False))
    return scored.withColumn("usable", (F.col("chosen") != "") & ~too_close).drop("similarity")


def shared_words(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, similarity): twice the words that two texts share over all their words.

    Linear in the texts: words are counted by (key, word), so a long pair is
    spread over tasks. Pairs without any word give no row.
    """
    def words(c: str, left: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(WORD), F.lit(0))
        return F.transform(found, lambda w: F.struct(w.alias("word"), F.lit(left).alias("a"), F.lit(1 - left).alias("b")))

    said = pairs.select(key, F.explode(F.concat(words(a, 1), words(b, 0))).alias("w")).select(key, "w.*")
    counts = said.groupBy(key, "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.groupBy(key).agg(F.round(2.0 * F.sum(F.least("a", "b")) / F.sum(F.col("a") + F.col("b")), 9).alias("similarity"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; quadratic, so for message-sized texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1.0 - F.levenshtein(a, b) / longer).otherwise(1.0)
