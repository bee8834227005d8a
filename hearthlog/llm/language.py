"""Language identification by Bayesian evidence fusion.

The posterior of a record multiplies the likelihood of its text (hashed byte
trigrams, tempered) with those of its declared markup language and its address
suffix and with a host prior. Suffix, declaration and host tables come from a
grouped aggregation of text posteriors over all rows; host priors are smoothed
towards their domain and domains towards the whole. A row's own share is taken
out of the counts before they judge it.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import checkpoint
from .common import lookup, read
from .url_filter import host_and_path

# Labelled documents that the text model is fitted on, by language, chosen by hash.
SAMPLE_DOCS = 300
BUCKETS = 1 << 15
# Trigrams of a text are far from independent: it counts as this many at most.
EVIDENCE = 60.0
# Weight of the level above in a smoothed prior, and of uniform counts in a likelihood.
SMOOTH, PRIOR_COUNT = 8.0, 1.0

# what is not closed reaches to the end, so that no opening is tried twice
_DROPPED = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|</?[a-zA-Z!?][^>]*(?:>|\Z)", re.S | re.I)


class TextModel(NamedTuple):
    """Languages in order and their log-probabilities (languages, BUCKETS)."""

    names: tuple[str, ...]
    weights: np.ndarray


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of one whole text, lower-cased, white space as one blank."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.int64)
    grams = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)


def visible(markup: str) -> str:
    return unescape(_DROPPED.sub(" ", markup))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> TextModel:
    """A model of the languages that the labels name, from at most `sample` labelled documents of each."""
    named = docs.where((F.col(lang) != "") & F.col(key).isNotNull())
    names = tuple(sorted(r[0] for r in named.select(lang).distinct().collect()))  # one row for a language
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    ids = named.select(lang, key).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(ids.select(key, F.col(lang).alias("lang"))), key)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: np.zeros(BUCKETS, np.int64) for name in names}
        for batch in batches:
            for name, t in zip(batch["lang"], batch["text"]):
                total[name] += trigram_counts(t)
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": t[at]})

    counts = np.full((len(names), BUCKETS), 0.5)
    sums = rows.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for row in sums.toPandas().itertuples():  # at most BUCKETS rows a language
        counts[names.index(row.lang), row.bucket] += row.n
    return TextModel(names, np.log(counts / counts.sum(1, keepdims=True)))


def with_text_odds(rows: DataFrame, model: TextModel) -> DataFrame:
    """`rows` (content, is_markup) with `ll`: tempered log-likelihoods by language; zeros where there is no text."""
    weights = model.weights.T.astype(np.float64)

    @pandas_udf("array<double>")
    def likelihoods(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, markups in batches:
            out = []
            for content, markup in zip(contents, markups):
                counts = trigram_counts(visible(content) if markup else content)
                at = np.flatnonzero(counts)
                n = counts.sum()
                out.append((counts[at] @ weights[at] * (min(1.0, EVIDENCE / n) if n else 0.0)).tolist())
            yield pd.Series(out)

    return rows.withColumn("ll", likelihoods("content", "is_markup")).drop("content", "is_markup")


def _normal(logs: Column) -> Column:
    """Probabilities from logs, as an array."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _tally(rows: DataFrame, key: str, name: str, languages: int) -> DataFrame:
    """Soft counts of each language by a key that is never null."""
    sums = [F.sum(F.col("soft")[i]) for i in range(languages)]
    return checkpoint(rows.groupBy(key).agg(F.array(*sums).alias(name), F.count("*").alias("n")))


def fused(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Stored `rows` (ll, declared, suffix, host, domain; null where unknown) with lang, confidence, text_lang."""
    n = len(languages)
    for c in ("declared", "suffix", "host", "domain"):
        rows = rows.withColumn(f"__{c}", F.coalesce(c, F.lit("")))
    rows = checkpoint(rows.withColumn("soft", _normal(F.col("ll"))))
    everything = rows.agg(*[F.coalesce(F.sum(F.col("soft")[i]), F.lit(0.0)).alias(str(i)) for i in range(n)]).first()
    whole = [everything[i] for i in range(n)]
    share = F.array(*[F.lit((w + 1.0) / (sum(whole) + n)) for w in whole])
    for c in ("declared", "suffix", "host", "domain"):
        rows = lookup(rows, _tally(rows, f"__{c}", f"by_{c}", n), [f"__{c}"], "n")
    kinds = {c: rows.select(F.col(f"__{c}")).distinct().count() + 1 for c in ("declared", "suffix")}

    def others(c: str) -> Column:
        return F.zip_with(f"by_{c}", "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def likelihood(c: str) -> Column:
        """log P(value | language), 0 for a value that is not there."""
        logs = [F.log((others(c)[i] + PRIOR_COUNT) / (F.lit(whole[i]) + PRIOR_COUNT * kinds[c])) for i in range(n)]
        return F.when(F.col(c).isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(F.array(*logs))

    def smoothed(c: str, above: Column) -> Column:
        total = F.aggregate(others(c), F.lit(0.0), lambda a, b: a + b)
        return F.when(F.col(c).isNull(), above).otherwise(F.zip_with(others(c), above, lambda a, b: (a + SMOOTH * b) / (total + SMOOTH)))

    rows = rows.withColumn("of_domain", smoothed("domain", share)).withColumn("prior", smoothed("host", F.col("of_domain")))
    rows = rows.withColumn("declaration", likelihood("declared")).withColumn("address", likelihood("suffix"))
    logs = F.array(*[F.col("ll")[i] + F.log(F.col("prior")[i]) + F.col("declaration")[i] + F.col("address")[i] for i in range(n)])
    rows = rows.withColumn("posterior", _normal(logs))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda p: names[F.array_position(p, F.array_max(p)).cast("int") - 1]
    return (rows.withColumn("lang", best(F.col("posterior"))).withColumn("confidence", F.array_max("posterior"))
            .withColumn("text_lang", F.when(F.array_max("ll") < 0, best(F.col("ll")))))


def page_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    content = F.coalesce(html, F.lit(""))
    host, _ = host_and_path(F.col(url))
    host = F.nullif(host, F.lit(""))
    declared = F.lower(F.regexp_extract(content, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col(key).cast("long").alias("page_id"), content.alias("content"), F.lit(True).alias("is_markup"),
                        F.nullif(declared, F.lit("")).alias("declared"), F.regexp_substr(host, F.lit("[^.:]+(?=(:[0-9]*)?$)")).alias("suffix"), host.alias("host"),
                        F.substring_index(host, ".", -2).alias("domain"))


def document_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Plain texts: no declaration and no address; the source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col(key).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.coalesce(text, F.lit("")).alias("content"),
                       F.lit(False).alias("is_markup"), none.alias("declared"), none.alias("suffix"), F.concat(F.lit("source:"), F.col(source)).alias("host"), F.lit("source:").alias("domain"))


def identified(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for every document and page: kind, doc_id, page_id, lang, confidence, text_lang, declared, suffix, host.

    The languages are those that `lang` of the documents names. Null and empty
    texts are judged by the other evidence alone. Without any, the most frequent
    language stands. Repeated rows get a row each; ties go to the first language
    in alphabetical order. Without a labelled document lang and text_lang are
    null. Columns not named are not read.
    """
    model = fit(docs)
    if not model.names:
        rows = document_rows(docs).unionByName(page_rows(pages))
        none = F.lit(None).cast("string")
        return rows.select("kind", "doc_id", "page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "suffix", "host")
    rows = checkpoint(with_text_odds(document_rows(docs).unionByName(page_rows(pages)), model))
    return fused(rows, model.names).select("kind", "doc_id", "page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "suffix", "host")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return identified(read(spark, folder, "documents"), read(spark, folder, "pages"))
