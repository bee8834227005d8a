"""Hybrid retrieval for a batch of queries: dense, keyword, fusion, diversity.

Memories are scored where they lie. Each task keeps only the best rows of every
query and hands those on, so what is shuffled is queries x fetch x tasks, never
queries x memories. The query batch is broadcast in chunks of bounded size; a
larger batch makes more passes over the memories.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx, times, vectors as vx
from ..session import checkpoint, scratch_dir, small_side
from .select import top_per_group
from .terms import TermTable

# ---- fixed values ----
TRUST_TIERS = ["public", "personal", "secret"]
PHOTO_BOOST, FORWARD_PENALTY = 1.6, 0.35
RRF_K = 60
REDUNDANCY = 0.45
RECENCY_HALFLIFE_DAYS, RECENCY_WEIGHT = 540.0, 0.25
FUSE_TEXT_CHARS, UNION_TEXT_CHARS = 80, 60
# ---- end of fixed values ----

QUERIES_PER_PASS = 512
_SCORE_DIGITS = 9  # scores are compared at this precision so that ties are ties


def allowed_tiers(max_trust: str) -> list[str]:
    return TRUST_TIERS[: TRUST_TIERS.index(max_trust) + 1]


def search_filter(max_trust: str = "secret", kinds: list[str] = ()) -> Column:
    """Metadata filter of a search; pushed to the scan."""
    cond = F.col("trust").isin(allowed_tiers(max_trust))
    return cond & F.col("kind").isin(list(kinds)) if kinds else cond


def fetch_size(limit: int) -> int:
    return max(4 * limit, 24)


def intent_weight(kind: Column, wants_photos: Column) -> Column:
    return F.when(
        wants_photos, F.when(kind == "photo", PHOTO_BOOST).when(kind == "forward", FORWARD_PENALTY).otherwise(1.0)
    ).otherwise(1.0)


def _chunks(queries: DataFrame, columns: list[str], per_pass: int) -> Iterator[list]:
    """Query batch to the driver in bounded pieces."""
    chunk = []
    for row in queries.select(*columns).toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == per_pass:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best finite scores; smaller id wins ties."""
    usable = np.flatnonzero(np.isfinite(scores))
    if len(usable) > k:
        # everything at or above the k-th score, so that ties are settled by id
        cut = np.partition(scores[usable], len(usable) - k)[len(usable) - k]
        usable = usable[scores[usable] >= cut]
    return usable[np.lexsort((ids[usable], -scores[usable]))][:k]


_PARTIAL = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("memory_id", T.LongType()), T.StructField("score", T.DoubleType())]
)


class _Keeper:
    """Best rows of each query seen so far in one task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = [np.empty(0, np.int64) for _ in range(n)]
        self.scores = [np.empty(0) for _ in range(n)]
        self.floor = np.full(n, -np.inf)  # what a row needs to be kept

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows x queries; -inf where a row is not eligible."""
        scores = np.round(scores, _SCORE_DIGITS)
        top = scores.max(axis=0, initial=-np.inf)
        for q in np.flatnonzero((top >= self.floor) & (top > -np.inf)).tolist():
            s, i = np.concatenate([self.scores[q], scores[:, q]]), np.concatenate([self.ids[q], ids])
            keep = _best(s, i, self.k)
            self.scores[q], self.ids[q] = s[keep], i[keep]
            if len(keep) == self.k:
                self.floor[q] = s[keep[-1]]

    def frame(self, query_ids: list[int]) -> pd.DataFrame:
        counts = [len(i) for i in self.ids]
        return pd.DataFrame(
            {"query_id": np.repeat(np.asarray(query_ids, np.int64), counts),
             "memory_id": np.concatenate([*self.ids, np.empty(0, np.int64)]),
             "score": np.concatenate([*self.scores, np.empty(0)])}
        )


def _eligible(pdf: pd.DataFrame, limits: list[tuple]) -> np.ndarray:
    """rows x queries: whether a row lies in each query's half-open window and kinds."""
    ts = pdf["_ts"].to_numpy(np.float64)
    lo = np.array([-np.inf if w[0] is None else w[0] for w in limits])
    hi = np.array([np.inf if w[1] is None else w[1] for w in limits])
    # a row without a time lies in no window, but a query without one takes it
    ok = ((ts[:, None] >= lo) | (lo == -np.inf)) & ((ts[:, None] < hi) | (hi == np.inf))
    asked: dict[tuple, list[int]] = {}
    for q, (_, _, kinds) in enumerate(limits):
        if kinds is not None:
            asked.setdefault(tuple(kinds), []).append(q)
    for kinds, of in asked.items():
        ok[:, of] &= pdf["kind"].isin(list(kinds)).to_numpy()[:, None]
    return ok


def _union(parts: list[DataFrame], spark) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], _PARTIAL)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_limits(queries: DataFrame) -> DataFrame:
    for c, kind in (("lo", "timestamp"), ("hi", "timestamp"), ("kinds", "array<string>")):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast(kind))
    return queries.withColumns({"_lo": F.unix_micros("lo"), "_hi": F.unix_micros("hi")})


def dense_top(
    queries: DataFrame, memories: DataFrame, fetch: int, metric: str = "l2", per_pass: int = QUERIES_PER_PASS
) -> DataFrame:
    """query_id, memory_id, similarity, rank (from 0) of the `fetch` nearest memories.

    `queries`: query_id, vector and optional lo, hi, kinds. Similarity is 1 - distance
    for the squared-L2 metric, or the cosine. Exact: every eligible row is scored.
    """
    spark = memories.sparkSession
    rows = memories.where(F.col("vector").isNotNull()).select(
        "memory_id", "vector", "kind", F.unix_micros("ts").alias("_ts")
    )
    parts = []
    for chunk in _chunks(_with_limits(queries), ["query_id", "vector", "_lo", "_hi", "kinds"], per_pass):
        batch = spark.sparkContext.broadcast(  # at most per_pass vectors
            ([r[0] for r in chunk], np.array([r[1] for r in chunk], dtype=np.float64), [tuple(r[2:]) for r in chunk])
        )

        def score(frames: Iterator[pd.DataFrame], batch=batch) -> Iterator[pd.DataFrame]:
            ids, q, limits = batch.value
            keeper = _Keeper(len(ids), fetch)
            q2 = (q * q).sum(axis=1)
            for pdf in frames:
                if not len(pdf):
                    continue
                v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                dot, v2 = v @ q.T, (v * v).sum(axis=1)
                if metric == "l2":
                    s = 1.0 - (v2[:, None] + q2[None, :] - 2.0 * dot)
                else:
                    scale = np.sqrt(v2)[:, None] * np.sqrt(q2)[None, :]
                    s = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
                s[~_eligible(pdf, limits)] = -np.inf
                keeper.add(s, pdf["memory_id"].to_numpy(np.int64))
            yield keeper.frame(ids)

        parts.append(rows.mapInPandas(score, _PARTIAL))
    best = top_per_group(_union(parts, spark), ["query_id"], fetch, F.col("score").desc(), F.col("memory_id"))
    return best.select("query_id", "memory_id", F.col("score").alias("similarity"), (F.col("rank") - 1).alias("rank"))


def term_table(memories: DataFrame, path: str | None = None) -> TermTable:
    """The term table of `memories`, brought up to date in `path` (a fresh shared folder if there is none)."""
    spark = memories.sparkSession
    table = TermTable(spark, path or scratch_dir(spark, "terms"))
    table.append(memories)
    return table


def keyword_top(queries: DataFrame, memories: DataFrame, fetch: int, index: TermTable | None = None) -> DataFrame:
    """query_id, memory_id, score, rank (from 0) of the `fetch` best keyword matches; see `TermTable.top`."""
    return (index or term_table(memories)).top(queries, memories, fetch)


def fuse(dense: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists for each query.

    Rows meet on (query_id, key). Where a query has no keyword hits its dense
    list stays as it is. `dense`: query_id, key, similarity, rank and `row`;
    `keyword`: query_id, key, rank, `row`.
    """
    best_of = Window.partitionBy("query_id")
    d = dense.select("query_id", "key", F.col("similarity").alias("_sim"), F.col("rank").alias("_dr"), F.col("row").alias("_drow"))
    w = keyword.select("query_id", "key", F.col("rank").alias("_kr"), F.col("row").alias("_krow"))
    # a key met twice in one list counts as a later row would in a keyed table
    d = d.groupBy("query_id", "key").agg(F.max_by(F.struct("_sim", "_dr", "_drow"), "_dr").alias("_d"))
    w = w.groupBy("query_id", "key").agg(
        F.min_by("_krow", "_kr").alias("_krow"), F.sum(1.0 / (k + F.col("_kr") + 1)).alias("_kw")
    )
    both = d.join(w, ["query_id", "key"], "full_outer").select(
        "query_id", "key", F.coalesce("_d._drow", "_krow").alias("row"), F.col("_d._sim").alias("_sim"),
        (F.coalesce(1.0 / (k + F.col("_d._dr") + 1), F.lit(0.0)) + F.coalesce("_kw", F.lit(0.0))).alias("rrf"),
        F.col("_kw").isNotNull().alias("_hit"),
    )
    top = F.max("rrf").over(best_of)
    best = F.coalesce(F.nullif(F.max("_sim").over(best_of), F.lit(0.0)), F.lit(1.0))
    fused = F.greatest(F.coalesce("_sim", F.lit(0.0)), best * (F.col("rrf") / top))
    return both.withColumn(
        "similarity", F.when(F.max(F.col("_hit").cast("int")).over(best_of) == 1, fused).otherwise(F.col("_sim"))
    ).select("query_id", "key", "row", "similarity", "rrf")


def fuse_key(ts: Column, text: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("|"), F.left(text, F.lit(FUSE_TEXT_CHARS)))


def search(
    queries: DataFrame, memories: DataFrame, limit: int, as_of: Column, max_trust: str = "secret",
    kinds: list[str] = (), metric: str = "l2", index: TermTable | None = None, per_pass: int = QUERIES_PER_PASS,
) -> DataFrame:
    """The `limit` best memories of each query with `score` and `rank` (from 1).

    `queries`: query_id, text, vector and optional lo, hi, kinds, and `limit`
    where a query wants fewer rows than the call.
    """
    eligible = memories.where(search_filter(max_trust, kinds))
    fetch = fetch_size(limit)
    # both lists are short and used twice: write them once instead of scoring twice
    dense = checkpoint(dense_top(queries, eligible, fetch, metric, per_pass))
    keyword = checkpoint(keyword_top(queries, eligible, fetch, index or term_table(memories)))
    if "limit" in queries.columns:
        own = small_side(queries.select("query_id", F.col("limit").alias("_limit")))
        cut = F.col("rank") < F.greatest(F.col("_limit") * 4, F.lit(24))  # each query's own fetch size
        dense, keyword = dense.join(own, "query_id").where(cut).drop("_limit"), keyword.join(own, "query_id").where(cut).drop("_limit")
    # only the few fetched rows get their text and metadata back
    hits = dense.select("memory_id").union(keyword.select("memory_id")).distinct()
    full = eligible.join(small_side(hits), "memory_id")
    row = F.struct(*[F.col(c) for c in memories.columns])
    full = full.select("memory_id", row.alias("row"), fuse_key(F.col("ts"), F.col("text")).alias("key"))
    fused = fuse(dense.join(full, "memory_id"), keyword.join(full, "memory_id"))
    age_days = (F.unix_micros(as_of) - F.unix_micros("row.ts")) / 86_400_000_000
    scored = fused.withColumn(
        "score", F.round(vx.recency_score(F.col("similarity"), age_days, RECENCY_HALFLIFE_DAYS, RECENCY_WEIGHT), _SCORE_DIGITS)
    )
    best = top_per_group(scored, ["query_id"], limit, F.col("score").desc(), F.col("row.memory_id"))
    if "limit" in queries.columns:
        best = best.join(own, "query_id").where(F.col("rank") <= F.col("_limit"))
    return best.select("query_id", "row.*", "similarity", "score", "rank")


def union_memories(*parts: DataFrame) -> DataFrame:
    """Memories of several kinds in one table; columns a kind lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def or_unwindowed(windowed: DataFrame, everything: DataFrame) -> DataFrame:
    """Per query the windowed result, or the unwindowed one where that is empty."""
    answered = small_side(windowed.select("query_id").distinct())
    return windowed.unionByName(everything.join(answered, "query_id", "left_anti"))


def union_results(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Results of two searches; an extra row that repeats (ts, opening text) is dropped."""
    key = ["query_id", "ts", F.left("text", F.lit(UNION_TEXT_CHARS)).alias("_t")]
    fresh = extra.withColumn("_t", F.left("text", F.lit(UNION_TEXT_CHARS))).join(
        main.select(*key).distinct(), ["query_id", "ts", "_t"], "left_anti"
    ).drop("_t")
    return main.withColumn("_from", F.lit(0)).unionByName(fresh.withColumn("_from", F.lit(1)))


def drop_forwards(results: DataFrame, own_photos: Column) -> DataFrame:
    """For own-photo questions drop forwards, unless nothing else is left."""
    others = results.groupBy("query_id").agg(F.count_if(F.col("kind") != "forward").alias("_others"))
    return results.join(small_side(others), "query_id").where(
        ~(own_photos & (F.col("kind") == "forward") & (F.col("_others") > 0))
    ).drop("_others")


def diversify(candidates: DataFrame, limit: int, order: str = "position", penalty: float = REDUNDANCY) -> DataFrame:
    """Greedy choice of relevant and mutually different rows for each query.

    A group holds one query's fetched candidates, a small constant number.
    Adds `pick` from 1; ties keep the earlier candidate.
    """
    schema = T.StructType([*candidates.schema.fields, T.StructField("pick", T.IntegerType())])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        vectors = [np.asarray(v, np.float64) if v is not None else None for v in pdf["vector"]]
        dim = next((len(v) for v in vectors if v is not None), 1)
        m = np.stack([np.zeros(dim) if v is None else v for v in vectors])
        norms = np.linalg.norm(m, axis=1)
        m = m / np.where(norms > 0, norms, 1.0)[:, None]
        has = np.array([v is not None for v in vectors])
        score = pdf["score"].to_numpy(np.float64)
        worst = np.full(len(pdf), -np.inf)
        left = np.ones(len(pdf), bool)
        picked = [0]
        left[0] = False
        while left.any() and len(picked) < limit:
            last = picked[-1]
            if has[last]:
                worst = np.maximum(worst, m @ m[last])
            overlap = np.where(has & np.isfinite(worst), worst, 0.0)
            value = np.round(np.where(left, score - penalty * overlap, -np.inf), 12)
            picked.append(int(np.argmax(value)))
            left[picked[-1]] = False
        out = pdf.iloc[picked].copy()
        out["pick"] = np.arange(1, len(picked) + 1, dtype=np.int32)
        return out

    return candidates.groupBy("query_id").applyInPandas(choose, schema)


def gather(
    queries: DataFrame, memories: DataFrame, limit: int, as_of: Column, guest: bool = False,
    penalty: float = REDUNDANCY, metric: str = "l2",
) -> DataFrame:
    """Memories that go into a reply, for a batch of queries.

    `queries`: query_id, text, vector. The time window is read from the text;
    photo questions get a second search and their own weights.
    """
    trust = "public" if guest else "secret"
    q = queries.withColumn("_w", times.time_window(F.col("text"), as_of)).select(
        "query_id", "text", "vector", F.col("_w.lo").alias("lo"), F.col("_w.hi").alias("hi"),
        tx.wants_photos(F.col("text")).alias("photos"), tx.wants_own_photos(F.col("text")).alias("own"),
    )
    q = checkpoint(q)
    # what a question may need is searched in one pass over the memories: the
    # question itself (0), the same without its window (1), pictures alone (2)
    kinds = F.when(F.col("own"), F.array(F.lit("photo"))).otherwise(F.array(F.lit("photo"), F.lit("forward")))
    no_time, no_kinds = F.lit(None).cast("timestamp"), F.lit(None).cast("array<string>")

    def form(number: int, lo: Column, hi: Column, kinds: Column, rows: int) -> Column:
        return F.struct(
            F.lit(number).alias("form"), lo.alias("lo"), hi.alias("hi"), kinds.alias("kinds"), F.lit(rows).alias("limit")
        )

    forms = F.array_compact(F.array(
        form(0, F.col("lo"), F.col("hi"), no_kinds, 4 * limit),
        F.when(F.col("lo").isNotNull(), form(1, no_time, no_time, no_kinds, 4 * limit)),
        F.when(F.col("photos"), form(2, F.col("lo"), F.col("hi"), kinds, 2 * limit)),
    ))
    asked = q.select("query_id", "text", "vector", F.explode(forms).alias("f")).select(
        (F.col("query_id") * 3 + F.col("f.form")).alias("query_id"), "text", "vector", "f.lo", "f.hi", "f.kinds", "f.limit"
    )
    found = checkpoint(search(asked, memories, 4 * limit, as_of, trust, metric=metric))
    found = found.withColumn("_form", F.pmod("query_id", F.lit(3))).withColumn(
        "query_id", F.floor(F.col("query_id") / 3).cast("long")
    )
    of_form = lambda n: found.where(F.col("_form") == n).drop("_form")
    rows = or_unwindowed(of_form(0), of_form(1))
    # a question without any result at all ends there
    extra = of_form(2).join(rows.select("query_id").distinct(), "query_id", "left_semi")
    rows = union_results(rows, extra)
    flags = small_side(q.select("query_id", "photos", "own"))
    rows = drop_forwards(rows.join(flags, "query_id"), F.col("own"))
    rows = rows.withColumn("score", F.col("score") * intent_weight(F.col("kind"), F.col("photos")))
    by_score = Window.partitionBy("query_id").orderBy(
        F.when(F.col("photos"), -F.col("score")), "_from", "rank", "memory_id"
    )
    rows = rows.withColumn("position", F.row_number().over(by_score)).drop("_from", "rank", "photos", "own")
    return diversify(rows, limit, "position", penalty)
