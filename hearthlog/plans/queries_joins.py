"""Join and set queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as agg, joins, moods as md, retrieval as rt
from ..sources import tables as t
from . import sql as q
from .catalog import query


@query("j1_speaker_overlap", f"""
WITH {q.SEGMENTS}, {q.DIARIZED}, o AS (
 SELECT s.segment_id, d.label, sum(least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms)) AS ov, min((d.start_ms, d.turn_id)) AS first_turn
 FROM segments s JOIN diarized d ON s.audio_ref = d.audio_ref AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms
 WHERE least(s.end_ms, d.end_ms) > greatest(s.start_ms, d.start_ms) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ov DESC, first_turn) AS rn FROM o)
SELECT s.segment_id, b.label, CAST(b.ov AS BIGINT) AS overlap_ms FROM segments s LEFT JOIN b ON b.segment_id = s.segment_id AND rn = 1""")
def j1(spark, folder):
    out = joins.assign_speakers(t.segments(spark, folder), t.diarized_turns(spark, folder))
    return out.select("segment_id", "label", "overlap_ms")


@query("j2_faces_with_photos", """
SELECT l_returnflag AS person, year(o_orderdate) AS year, count(*) AS faces FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def j2(spark, folder):
    # counted per photo before the join: the join then sees one row per (photo, person)
    faces = t.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("person")).agg(
        F.count("*").alias("n"))
    photos = t.photos(spark, folder).select("id", F.year("taken_at").cast("long").alias("year"))
    return faces.join(photos, "id").groupBy("person", "year").agg(F.sum("n").alias("faces"))


@query("j3_relationship_labels", """
WITH people AS (SELECT n_nationkey AS position, n_name || ' / alias ' || n_nationkey AS contact, r_name || '.' AS relationship FROM nation JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT position, trim(unnest(string_split(contact, '/'))) AS alias, rtrim(trim(relationship), '.') AS rel FROM people),
d AS (SELECT lower(alias) AS k, arg_max(alias || ' (' || rel || ')', position) AS label FROM a WHERE alias <> '' GROUP BY 1)
SELECT c_custkey, label AS known_label FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN d ON d.k = lower(CASE WHEN c_custkey % 2 = 0 THEN upper(n_name) WHEN c_custkey % 3 = 0 THEN 'ALIAS ' || n_nationkey ELSE 'nobody' END)""")
def j3(spark, folder):
    nation, region = t.table(spark, folder, "nation"), t.table(spark, folder, "region")
    people = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("position"),
        F.concat("n_name", F.lit(" / alias "), F.col("n_nationkey").cast("string")).alias("contact"),
        F.concat("r_name", F.lit(".")).alias("relationship"))
    c = t.table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("n_name")).when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit("ALIAS "), F.col("n_nationkey").cast("string"))).otherwise("nobody")
    return joins.with_labels(c, name, joins.relationship_aliases(people)).select("c_custkey", "known_label")


_J4_NAME = "CASE WHEN p_partkey % 3 = 0 THEN concat('My ', n_name, ' friend') WHEN p_partkey % 3 = 1 THEN substr(n_name, 2, 3) ELSE p_name END"


@query("j4_loose_names", f"""
WITH parts AS (SELECT p_partkey, {_J4_NAME} AS name FROM part JOIN nation ON n_nationkey = p_partkey % 25),
m AS (SELECT p_partkey, n_name, row_number() OVER (PARTITION BY p_partkey ORDER BY n_nationkey) AS rn FROM parts JOIN nation
 ON contains(lower(trim(name)), lower(trim(n_name))) OR contains(lower(trim(n_name)), lower(trim(name))) WHERE trim(name) <> '')
SELECT p.p_partkey, m.n_name AS person FROM parts p LEFT JOIN m ON m.p_partkey = p.p_partkey AND rn = 1""")
def j4(spark, folder):
    nation = t.table(spark, folder, "nation")
    parts = t.table(spark, folder, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(
        nation, "n_nationkey").select("p_partkey", F.expr(_J4_NAME).alias("name"))
    return joins.loose_match(parts, "name", nation, "n_name", "n_nationkey").select("p_partkey", "person")


@query("j5_not_done", "SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def j5(spark, folder):
    d = t.table(spark, folder, "documents").select("doc_id", "n_chars")
    return joins.not_done(d, t.table(spark, folder, "labels"), ["doc_id"])


@query("j8_language_hints", """
WITH c AS (SELECT source, CASE WHEN lang = 'es' THEN 'ur' ELSE lang END AS lang FROM documents),
n AS (SELECT source, lang, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM n) WHERE rn = 1)
SELECT d.doc_id, CASE WHEN m.lang = 'ur' THEN 'hi' WHEN m.lang IN ('en','hi','pa') THEN m.lang END AS forced FROM documents d JOIN m USING (source)""")
def j8(spark, folder):
    d = t.table(spark, folder, "documents").select("doc_id", "source", F.when(F.col("lang") == "es", "ur").otherwise(F.col("lang")).alias("lang"))
    hints = agg.majority(d, "source", "lang").select("source", tx.language_hint(F.col("lang")).alias("forced"))
    return d.join(hints, "source").select("doc_id", "forced")


_WINDOWS = """windows AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 > 0 THEN TIMESTAMP '2023-12-25' + to_days(CAST(item_id AS INTEGER)) END AS lo,
 CASE WHEN item_id % 4 > 0 THEN TIMESTAMP '2023-12-25' + to_days(CAST(item_id + item_id % 7 AS INTEGER)) END AS hi FROM benchmark)"""


@query("j9_rows_in_windows", f"""
WITH {_WINDOWS} SELECT query_id, event_type, count(*) AS n, epoch_us(min(ts)) AS first_us FROM events JOIN windows ON lo IS NULL OR (ts >= lo AND ts < hi) GROUP BY ALL""")
def j9(spark, folder):
    base = F.expr("TIMESTAMP '2023-12-25 00:00:00'")
    on = F.col("item_id") % 4 > 0
    day = lambda n: F.timestamp_micros(F.unix_micros(base) + n * 86_400_000_000)
    w = t.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(on, day(F.col("item_id"))).alias("lo"),
        F.when(on, day(F.col("item_id") + F.col("item_id") % 7)).alias("hi"))
    return joins.counts_in_windows(t.table(spark, folder, "events"), "ts", w, "query_id", ["event_type"],
                                   [F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us")], grain="day")


@query("j11_mood_at_turn", f"""
WITH {q.MOODS}, turns AS (SELECT user_id, ts, event_id AS turn_id FROM events WHERE event_type = 'view'),
r AS (SELECT * FROM moods WHERE mood <> 'neutral')
SELECT t.turn_id, CASE WHEN r.created_at >= t.ts - INTERVAL 10 MINUTE THEN r.mood END AS mood, CASE WHEN r.created_at >= t.ts - INTERVAL 10 MINUTE THEN r.score END AS score
FROM turns t ASOF LEFT JOIN r ON r.user_id = t.user_id AND r.created_at <= t.ts""")
def j11(spark, folder):
    turns = t.table(spark, folder, "events").where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("turn_id"))
    return md.mood_at(turns, t.moods(spark, folder).where("mood <> 'neutral'"), "user_id").select("turn_id", "mood", "score")


@query("u1_union_memories", f"""
WITH {q.EVENT_TURNS}
SELECT kind, count(*) AS n, count(counterpart) AS with_counterpart FROM (
 SELECT 'episodic' AS kind, speaker_name AS counterpart FROM turns UNION ALL SELECT 'diary', NULL FROM documents UNION ALL SELECT 'photo', NULL FROM orders) GROUP BY kind""")
def u1(spark, folder):
    from ..operators.retrieval import union_memories

    e = t.event_turns(spark, folder).select(F.lit("episodic").alias("kind"), "text", "ts", F.col("speaker_name").alias("counterpart"))
    d = t.table(spark, folder, "documents").select(F.lit("diary").alias("kind"), "text")
    p = t.photos(spark, folder).select(F.lit("photo").alias("kind"), F.col("path").alias("text"), F.col("taken_at").alias("ts"))
    return union_memories(e, d, p).groupBy("kind").agg(F.count("*").alias("n"), F.count("counterpart").alias("with_counterpart"))


_RESULTS = """main AS (SELECT doc_id % 40 AS query_id, lang AS ts, text, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'forward' ELSE 'photo' END AS kind FROM documents WHERE doc_id % 2 = 0),
extra AS (SELECT doc_id % 40 AS query_id, lang AS ts, text, doc_id, 'photo' AS kind FROM documents)"""


def _results(spark, folder):
    d = t.table(spark, folder, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("lang").alias("ts"), "text", "doc_id")
    main = d.where("doc_id % 2 = 0").withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "forward").otherwise("photo"))
    return main, d.withColumn("kind", F.lit("photo"))


@query("u2_union_results", f"""
WITH {_RESULTS} SELECT query_id, doc_id, 0 AS side FROM main UNION ALL
SELECT query_id, doc_id, 1 FROM extra e WHERE NOT EXISTS (SELECT 1 FROM main m WHERE m.query_id = e.query_id AND m.ts = e.ts AND left(m.text, 60) = left(e.text, 60))""")
def u2(spark, folder):
    main, extra = _results(spark, folder)
    return rt.union_results(main, extra).select("query_id", "doc_id", F.col("_from").alias("side"))


@query("u3_drop_forwards", f"""
WITH {_RESULTS} SELECT query_id, doc_id FROM main m WHERE NOT (query_id % 2 = 0 AND kind = 'forward'
  AND EXISTS (SELECT 1 FROM main o WHERE o.query_id = m.query_id AND o.kind <> 'forward'))""")
def u3(spark, folder):
    main, _ = _results(spark, folder)
    return rt.drop_forwards(main, F.col("query_id") % 2 == 0).select("query_id", "doc_id")


@query("u4_fallback", """
WITH base AS (SELECT doc_id % 40 AS query_id, doc_id FROM documents),
w AS (SELECT * FROM base WHERE doc_id < 30)
SELECT query_id, doc_id FROM w UNION ALL SELECT query_id, doc_id FROM base WHERE query_id NOT IN (SELECT query_id FROM w)""")
def u4(spark, folder):
    base = t.table(spark, folder, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    return rt.or_unwindowed(base.where("doc_id < 30"), base)
