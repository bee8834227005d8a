"""Quality rules as a ledger of failure bits.

Every rule is evaluated once and leaves a bit and its measurement. A policy is
a named, versioned set of rules, that is, a mask: applying it, comparing
versions and ablating rules are bitwise work on the stored ledger.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout_words", "n_exclaims"]

# rule -> failure test on the measures, in the order of their bits
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines",
    "shouting": "10 * n_shout_words > 5 * n_words",
    "exclaiming": "5 * n_exclaims > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "some_repeats": "100 * n_repeat_words > 20 * n_words",
}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "exclaiming", "word_length"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def measured(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of MEASURES; null has no words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = 0
    if len(windows) < len(words) - 2:
        end = 0
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            if windows[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    shouts = sum(map(bytes.isupper, words))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            covered, len(lines), shouts, text.count("!"))


@pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measured(t) for t in batch], columns=MEASURES, dtype="int64")


def failures() -> Column:
    """The failure bits of a row that has the measures."""
    bits = [F.when(F.expr(test), 1 << i).otherwise(0) for i, test in enumerate(RULES.values())]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out.cast("long")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measures and `failed` (bits by the order of RULES) for every row.

    Null and empty texts have no words and fail `few_words`. Repeated rows
    get a row each. No rows give no rows. Other columns are not read.
    """
    return docs.select(F.col(key), measures(F.col(text)).alias("m")).select(key, "m.*").withColumn("failed", failures())


def passes(failed: Column, policy: str = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail only it, rows kept without it.

    The ledger is folded to one row per distinct failure mask first, at most
    2 ** len(RULES) of them.
    """
    used = mask(policy)
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(used)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(1 << list(RULES).index(rule)).cast("long").alias("bit")) for rule in POLICIES[policy]]))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        n(F.col("bits").bitwiseAND(F.col("bit")) != 0)("fails"), n(F.col("bits") == F.col("bit"))("fails_only"),
        n(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"), n(F.col("bits") == 0)("kept"))


def kept(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of `docs` that pass a policy, with all their columns."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), measures(F.col(text)).alias("m"))
    return held.select("__doc", "m.*").where(passes(failures(), policy)).select("__doc.*")
