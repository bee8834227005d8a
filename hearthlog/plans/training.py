"""The training-set plan: messages in, split examples out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..operators import joins, select as sel, sequence as seq
from ..operators.ordered import ROWS_PER_BLOCK
from ..session import checkpoint


def candidates_with_drops(
    messages: DataFrame, exclude_sources: list[str] = ("video",), context_turns: int = seq.CONTEXT_TURNS,
    min_words: int = seq.MIN_WORDS, max_words: int = seq.MAX_WORDS, cap: int | None = seq.CONVERSATION_CAP,
    rows_per_block: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(candidates, kept, cuts): every owner turn with its drop reason, the first of
    each pair within the conversation cap, and where capped conversations stopped."""
    cands, may_fill = candidates(messages, exclude_sources, context_turns, min_words, max_words, cap, rows_per_block)
    good = cands.where(F.col("drop_reason").isNull())
    kept, cuts = seq.first_with_cap(good, "pair_key", "conversation_id", seq.ORDER, cap, may_fill)
    return cands, kept, cuts


def candidates(
    messages: DataFrame, exclude_sources: list[str] = ("video",), context_turns: int = seq.CONTEXT_TURNS,
    min_words: int = seq.MIN_WORDS, max_words: int = seq.MAX_WORDS, cap: int | None = seq.CONVERSATION_CAP,
    rows_per_block: int | None = None,
) -> tuple[DataFrame, bool]:
    """(owner turns with context and drop reason, whether a conversation can reach the cap).

    One count over two narrow columns of the messages answers both questions of
    skew: whether a conversation must be cut into blocks and whether one can fill.
    """
    rows = messages.where(~F.col("source").isin(list(exclude_sources)))
    largest = rows.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("speaker") == "me").alias("own")
    ).agg(F.max("n"), F.max("own")).first()
    cold = (largest[0] or 0) <= (rows_per_block or ROWS_PER_BLOCK)
    merged = seq.merge_runs(rows, rows_per_block, cold)
    return (
        seq.context_candidates(merged, context_turns, min_words, max_words, rows_per_block, cold),
        cap is not None and (largest[1] or 0) >= cap,
    )


def example_drops(messages: DataFrame, cap: int | None = seq.CONVERSATION_CAP, **options) -> DataFrame:
    """Drop counts of a build; works on the keys and reasons of the candidates only."""
    cands, may_fill = candidates(messages, cap=cap, **options)
    narrow = checkpoint(cands.select("conversation_id", *seq.ORDER, "pair_key", "drop_reason"))
    good = narrow.where(F.col("drop_reason").isNull())
    kept, cuts = seq.first_with_cap(good, "pair_key", "conversation_id", seq.ORDER, cap, may_fill)
    return drop_counts(narrow, kept, cuts)


def drop_counts(candidates: DataFrame, kept: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """drop_reason, n, with the rows kept under `kept`.

    Turns after a conversation reached its cap are never looked at, so they
    count nowhere; each capped conversation counts once.
    """
    seen = seq.before_cut(candidates, cuts, "conversation_id", seq.ORDER)
    by_reason = seen.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))
    n_kept = kept.groupBy().agg(F.count(F.lit(1)).alias("n"))
    reasons = by_reason.where(F.col("drop_reason").isNotNull())
    usable = by_reason.where(F.col("drop_reason").isNull()).select("n").unionByName(n_kept.select((-F.col("n")).alias("n")))
    duplicate = usable.agg(F.sum("n").alias("n")).where(F.col("n") > 0).select(F.lit("duplicate").alias("drop_reason"), "n")
    out = reasons.unionByName(duplicate).unionByName(n_kept.select(F.lit("kept").alias("drop_reason"), "n"))
    if cuts is not None:
        capped = cuts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
        out = out.unionByName(capped.select(F.lit("conversation_cap").alias("drop_reason"), "n"))
    return out


def build_examples(
    messages: DataFrame, people: DataFrame | None = None, system_prompt: str = "", **options
) -> DataFrame:
    """Training examples (conversation_id, ts, seq, messages, last_ts).

    `people`: position, contact, relationship; without it counterparts keep their names.
    """
    _, kept, _ = candidates_with_drops(messages, **options)
    kept = kept.withColumn("_name", tx.counterpart_name(F.col("conversation_id")))
    if people is not None:
        kept = joins.with_labels(kept, F.col("_name"), joins.relationship_aliases(people))
        known: Column = F.col("known_label")
    else:
        known = F.lit(None).cast("string")
    return seq.rendered_examples(kept, tx.counterpart_label(F.col("_name"), known), system_prompt)


def build_training_set(
    messages: DataFrame, since: str = "", replay_ratio: float = 0.3, eval_fraction: float = 0.05, **options
) -> DataFrame:
    """Examples with a leak-free `split`; with `since`, the new ones plus a replay sample."""
    examples = build_examples(messages, **options)
    if since:
        examples = sel.new_and_replay(examples, since, ["conversation_id", "seq"], replay_ratio)
    return sel.split_by_group(examples, "conversation_id", eval_fraction)
