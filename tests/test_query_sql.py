"""Queries against their SQL over small tables made to reach a limit or a tie."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import compare
from hearthlog.operators import clustering as cl, ordered, retrieval as rt
from hearthlog.plans import catalog, queries_tables

duckdb = pytest.importorskip("duckdb")
catalog.load()


def against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(catalog.QUERIES[name](spark, str(folder)), con, catalog.SQL[name])


def long_conversation(spark):
    """One source with more owner turns than the cap of a conversation."""
    return spark.range(1260).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("words of turn "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(20).cast("long").alias("n_chars"))


def test_drop_counts_of_a_long_conversation(spark, tmp_path):
    assert against_sql(spark, tmp_path, "a14_drop_counts", documents=long_conversation(spark)).startswith("ok")


def test_examples_of_a_long_conversation(spark, tmp_path):
    assert against_sql(spark, tmp_path, "sft_examples", documents=long_conversation(spark)).startswith("ok")


def test_owner_among_clusters_in_equally_many_calls(spark):
    rows = [(1, 200, [0.0, 1.0]), (7, 200, [1.0, 0.0]), (8, 150, [1.0, 0.0])]
    clusters = spark.createDataFrame(rows, "leader int, calls long, vector array<double>")
    assert cl.pick_owner(clusters, 200, [1.0, 0.0]).first()["leader"] == 7


def test_keyword_search_makes_no_row_for_each_query_and_memory(spark):
    texts = [(i, f"common words w{i % 7} n{i}") for i in range(300)]
    m = spark.createDataFrame(texts, "memory_id long, text string")
    q = spark.createDataFrame([(i, f"common w{i}") for i in range(7)], "query_id long, text string")
    table = rt.term_table(m)
    found = table.top(q, m, 5, per_pass=3)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    assert got == {i: [i + 7 * k for k in range(5)] for i in range(7)}


def test_leaders_do_not_pass_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "id long, vector array<double>")
    want = {tuple(r) for r in cl.leader_clusters(e, 0.9).collect()}
    monkeypatch.setattr(type(e), "toPandas", lambda *_: pytest.fail("rows at the driver"))
    assert {tuple(r) for r in cl.leader_clusters(e, 0.9, leaders_per_pass=7).collect()} == want


def test_listed_files_lie_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_tables, "scratch_dir", lambda *_: f"{tmp_path}/media")
    events = spark.range(300).select(F.col("id").alias("user_id"), F.lit("{}").alias("props"))
    assert against_sql(spark, tmp_path, "sc3_listings", events=events).startswith("ok")
    assert len(list((tmp_path / "media" / "m4a").glob("*=*"))) <= 64


def test_promoted_messages_of_segments_and_turns_without_length(spark, tmp_path):
    rows = [(1, 600, 1, "view", 0.0), (2, 300, 1, "signup", 10.0), (3, 320, 1, "error", 9.0),  # a segment inside turns
            (4, 600, 2, "click", 5.0), (5, 660, 2, "error", 0.0), (6, 661, 2, "signup", 0.0),  # turns inside a segment
            (7, 600, 4, "view", 5.0), (8, 600, 4, "error", 0.0), (9, 900, 4, "error", 0.0)]  # turns at its ends
    events = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit('{"k": 1}').alias("props"))
    assert against_sql(spark, tmp_path, "v11_promoted_messages", events=events).startswith("ok")


def test_promoted_messages_keep_repeated_texts(spark, tmp_path):
    events = spark.range(12).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(600)).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.when(F.col("id") < 11, "view").otherwise("signup").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 98}').alias("props"))
    assert against_sql(spark, tmp_path, "v11_promoted_messages", events=events).startswith("ok")


def test_sections_of_blank_and_missing_texts(spark, tmp_path):
    texts = ["", "#", " \n", "a b\n\n", "a\x0b", "a\u00a0\n", "\n\nb", "a ### b", "\ta\r\n", None]
    rows = [(i, text, lang) for i, (text, lang) in enumerate((t, n) for t in texts for n in ("en", None, "", " de "))]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert against_sql(spark, tmp_path, "sc11_sections", documents=documents).startswith("ok")


def test_smoothed_mood_of_ties_and_readings_of_nothing(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for user in [None, -5, *range(0, 900, 15)]:
        values = np.round(rng.exponential(50, 24), 2).tolist()
        for kind, order in (("view", rng.permutation(24)), ("click", rng.permutation(24)), ("signup", rng.permutation(24))):
            rows += [(user, int(at), kind, values[i]) for at, i in zip(rng.integers(0, 400, 24), order)]
        rows += [(user, -2, "purchase", 0.0), (user, -1, "error", None), (user, None, "error", 1.0)]
    events = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "event_id long, user_id long, at long, event_type string, value double").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    assert against_sql(spark, tmp_path, "st4_smoothed_mood", events=events).startswith("ok")


def test_smoothed_mood_across_batches_and_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(50, (2, 15)), 2)
    values[1] = rng.permutation(values[0])  # of the last 30 readings 15 are views and 15 are clicks, and both sum to the same
    rows = [(1000 * i + u, i, u, ["view", "click"][i % 2], float(values[i % 2, i // 2 % 15])) for u, n in ((1, 2000), (2, 90), (3, 77), (17, 41), (40, 12)) for i in range(n)]
    events = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, block = spark.conf.get(setting), ordered.ROWS_PER_BLOCK
    try:
        for batch, ordered.ROWS_PER_BLOCK in ((7, block), (100, 37), (10000, 400)):
            spark.conf.set(setting, batch)
            assert against_sql(spark, tmp_path, "st4_smoothed_mood", events=events).startswith("ok")
    finally:
        spark.conf.set(setting, before)
        ordered.ROWS_PER_BLOCK = block
