"""Cut keys must give what one plain ordered pass gives, with one key holding most rows."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from hearthlog.operators import moods as md, ordered, select as sel, sequence as seq

BLOCK_ROWS = 7


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    rows, t0 = [], datetime(2024, 1, 1)
    for conv, n in (("hot", 400), ("b", 30), ("c", 1), ("d", 9)):
        at = t0
        for i in range(n):
            at += timedelta(seconds=rng.choice([0, 5, 600, 30_000]))
            rows.append(("chat", conv, at, i, rng.choice(["me", "other"]), rng.choice(["Ann", None]), "x" * rng.randint(0, 400) + f" word{i}", float(rng.randint(0, 9))))
    df = spark.createDataFrame(rows, "source string, conversation_id string, ts timestamp, seq long, speaker string, speaker_name string, text string, v double")
    return df.repartition(3).cache()


def same(a, b):
    cols = sorted(a.columns)
    left, right = sorted(map(repr, a.select(cols).collect())), sorted(map(repr, b.select(cols).collect()))
    assert left == right
    return len(left)


def test_blocks_are_bounded_and_ordered(turns):
    lay = ordered.layout(turns, ["conversation_id"], ["ts", "seq"], BLOCK_ROWS)
    assert lay.hot
    sizes = lay.df.groupBy("conversation_id", "_block").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect()
    hot = sorted((r["_block"], r["a"], r["b"], r["n"]) for r in sizes if r["conversation_id"] == "hot")
    assert len(hot) > 20 and max(n for *_, n in hot) < 80
    assert all(x[2] < y[1] for x, y in zip(hot, hot[1:]))
    assert {r["_block"] for r in sizes if r["conversation_id"] == "c"} == {0}


@pytest.mark.parametrize("how", ["sum", "max", "count"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(turns, how, inclusive):
    lay = ordered.layout(turns, ["conversation_id"], ["ts", "seq"], BLOCK_ROWS)
    got = ordered.running(lay, F.col("v"), how, "r", inclusive).done().select("conversation_id", "seq", "r")
    w = Window.partitionBy("conversation_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = turns.select("conversation_id", "seq", {"sum": F.sum, "max": F.max, "count": F.count}[how]("v").over(w).alias("r"))
    if how == "count" and not inclusive:
        got, want = got.fillna(0, ["r"]), want.fillna(0, ["r"])
    assert same(got, want) == 440


@pytest.mark.parametrize("rows", [1, 6, 25])
def test_look_back(turns, rows):
    lay = ordered.layout(turns, ["conversation_id"], ["ts", "seq"], BLOCK_ROWS)
    frame = lambda w: F.collect_list("seq").over(w.rowsBetween(-rows, -1))
    got = ordered.look_back(lay, rows, c=frame).done().select("conversation_id", "seq", "c")
    want = turns.select("conversation_id", "seq", frame(Window.partitionBy("conversation_id").orderBy("ts", "seq")).alias("c"))
    same(got, want)


def test_global_order(turns):
    got = sel.numbered(turns.select("conversation_id", "seq"), ["conversation_id", "seq"], "p", 20)
    want = turns.select("conversation_id", "seq", F.row_number().over(Window.orderBy("conversation_id", "seq")).cast("long").alias("p"))
    same(got, want)
    cap = sel.until_cap(turns, ["conversation_id", "seq"], F.col("v"), 300, 20)
    assert same(cap, sel.until_cap(turns, ["conversation_id", "seq"], F.col("v"), 300)) < 440


@pytest.mark.parametrize("op", ["merge_runs", "scenes", "retrieval_queries", "recent_history"])
def test_sequence_operators(turns, op):
    fn = getattr(seq, op)
    kw = {"min_chars": 0} if op == "scenes" else {}
    assert same(fn(turns, rows_per_block=BLOCK_ROWS, **kw), fn(turns, **kw)) > 0


def test_scenes_against_a_plain_loop(turns):
    rows = sorted(turns.collect(), key=lambda r: (r["conversation_id"], r["ts"], r["seq"]))
    want, conv = [], None
    for r in rows:
        line = f"{'Me' if r['speaker'] == 'me' else r['speaker_name'] or 'Them'}: {r['text']}"
        if r["conversation_id"] != conv or size >= 900 or (r["ts"] - prev).total_seconds() > 6 * 3600:
            want.append([r["conversation_id"], r["seq"], []])
            conv, size = r["conversation_id"], 0
        want[-1][2].append(line)
        size, prev = size + len(line), r["ts"]
    want = sorted((c, s, "\n".join(ls), len(ls)) for c, s, ls in want)
    for block in (None, BLOCK_ROWS):
        got = sorted(tuple(r) for r in seq.scenes(turns, min_chars=0, rows_per_block=block).select("conversation_id", "seq", "text", "lines").collect())
        assert got == want


def test_context_candidates(turns):
    plain = seq.context_candidates(seq.merge_runs(turns))
    assert same(seq.context_candidates(seq.merge_runs(turns, BLOCK_ROWS), rows_per_block=BLOCK_ROWS), plain) > 50


def test_sessions(turns):
    gap = F.expr("INTERVAL 6 HOURS")
    args = (["conversation_id"], ["ts", "seq"], gap)
    same(seq.sessions(turns, *args, BLOCK_ROWS), seq.sessions(turns, *args))


def test_moods(turns):
    m = turns.select("conversation_id", "seq", "ts", F.element_at(F.array(*[F.lit(x) for x in md.MOODS]), (F.col("seq") % 5 + 1).cast("int")).alias("mood"), F.col("v").alias("score"))
    args = ("conversation_id", ["ts", "seq"])
    same(md.smoothed(m, *args, BLOCK_ROWS), md.smoothed(m, *args))
    quiet = lambda b: md.sustained_quiet(m, *args, "score", 700, 4, 2, b)
    same(quiet(BLOCK_ROWS), quiet(None))
    for keep in (0.8, 0.999):  # the second remembers far more rows than a block has
        level = lambda b: md.smoothed_level(m, *args, "score", keep, b).withColumn("level", F.round("level", 9))
        same(level(BLOCK_ROWS), level(None))


def test_mood_at(turns):
    readings = turns.where("seq % 3 = 0").select("conversation_id", F.col("ts").alias("created_at"), F.col("seq").alias("id"), F.lit("tired").alias("mood"), F.col("v").alias("score"))
    asked = turns.where("seq % 3 > 0").select("conversation_id", "ts", F.col("seq").alias("turn_id"))
    got = md.mood_at(asked, readings, "conversation_id", BLOCK_ROWS)
    same(got, md.mood_at(asked, readings, "conversation_id"))
    assert got.where("mood is not null").count() > 20


def test_merge_utterances(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([100, 1000, 3000, 5000])
        rows.append(("a" if i < 280 else "b", i, at, at + rng.choice([500, 2000]), rng.choice(["me", "other"]), rng.choice(["", f"w{i}"])))
    s = spark.createDataFrame(rows, "audio_ref string, segment_id long, start_ms long, end_ms long, speaker string, text string")
    same(seq.merge_utterances(s, rows_per_block=BLOCK_ROWS), seq.merge_utterances(s))


def test_dedup_with_cap_against_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(f"c{rng.randint(0, 5)}", i, f"k{rng.randint(0, 60)}") for i in range(400)]
    seen, kept, counts = set(), [], {}
    for conv, i, key in sorted(rows):
        if counts.get(conv, 0) >= 8 or key in seen:
            continue
        seen.add(key)
        counts[conv] = counts.get(conv, 0) + 1
        kept.append(i)
    df = spark.createDataFrame(rows, "g string, i long, k string")
    out, cuts = seq.first_with_cap(df, "k", "g", ["i"], 8)
    assert sorted(r["i"] for r in out.collect()) == sorted(kept)
    assert cuts.count() == sum(n == 8 for n in counts.values())


def test_exact_rank(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.randint(0, 10**13), 86_400_000_000 * 5 + rng.randint(0, 2_000_000), 7])) for k in "aab" for _ in range(101)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: r["value"] for r in sel.exact_rank(df, "k", "v", lambda n: F.floor(n / 2)).collect()}
    want = {k: sorted(v for kk, v in rows if kk == k)[sum(kk == k for kk, _ in rows) // 2] for k in "ab"}
    assert got == want


def test_seeded_sample_is_whole_and_repeatable(spark):
    df = spark.range(500)
    small = sel.seeded_sample(df, 60, 1, ["id"])
    sel_limit, sel.SORT_LIMIT_ROWS = sel.SORT_LIMIT_ROWS, 10
    try:
        big = sel.seeded_sample(df, 60, 1, ["id"])
        assert same(small, big) == 60
    finally:
        sel.SORT_LIMIT_ROWS = sel_limit


def test_large_samples_and_budgets_equal_the_sorted_ones(spark):
    df = spark.range(3000).selectExpr("id", "id % 900 AS twin")
    digest = {r.id: r.d for r in df.select("id", sel.seeded(5, "twin").alias("d")).collect()}
    for n in (1, 1500, 2999, 3000, 5000):
        got = sorted(digest[r.id] for r in sel.seeded_sample(df, n, 5, ["twin"]).collect())
        assert got == sorted(digest.values())[:n]
    spent = sel.within_budget(df, ["id"], F.lit(2), 4000, 2)
    assert [(r.id, r.used) for r in spent.orderBy("id").collect()] == [(i, 2 * i + 2) for i in range(2000)]


def test_long_runs_and_files_come_in_parts(spark):
    rows = [("hot", i, "me" if i < 900 else "other", f"text {i} " + "é" * (i % 7)) for i in range(1000)] + [(f"c{i}", j, "me", "a b") for i in range(20) for j in range(3)]
    turns = spark.createDataFrame(rows, "conversation_id string, seq long, speaker string, text string").withColumn("ts", F.timestamp_seconds("seq"))
    for block in (None, BLOCK_ROWS):
        whole = {(r.conversation_id, r.speaker): r.text for r in seq.merge_runs(turns, block).collect()}
        parts = sorted(map(tuple, seq.merge_runs(turns, block, part_bytes=500).select("conversation_id", "seq", "speaker", "part", "text").collect()))
        assert max(len(p[4].encode()) for p in parts) < 520 and sum(p[0] == "hot" for p in parts) > 20
        for key in whole:
            assert "\n".join(p[4] for p in parts if (p[0], p[2]) == key) == whole[key]
        files = sorted(map(tuple, seq.folded_by_file(turns, "conversation_id", ["ts", "seq"], "text", "|", block, 700).select("conversation_id", "part", "text").collect()))
        assert "|".join(f[2] for f in files if f[0] == "hot") == "|".join(r[3] for r in rows[:1000]).strip() or len(files) > 20
    segments = spark.createDataFrame([("r", i, 10 * i, 10 * i + 9, "me", f"word{i}") for i in range(300)], "audio_ref string, segment_id long, start_ms long, end_ms long, speaker string, text string")
    said = sorted(map(tuple, seq.merge_utterances(segments, part_bytes=200).select("part", "start_ms", "text").collect()))
    assert " ".join(x[2] for x in said) == " ".join(f"word{i}" for i in range(300)) and len(said) > 8


def test_large_group_limits(turns):
    order = [F.col("ts").desc(), F.col("seq")]
    want = sel.top_per_group(turns, ["conversation_id"], 150, *order)
    most, sel.GROUP_LIMIT_ROWS = sel.GROUP_LIMIT_ROWS, 10
    try:
        assert same(sel.top_per_group(turns, ["conversation_id"], 150, *order), want) == 190
    finally:
        sel.GROUP_LIMIT_ROWS = most
