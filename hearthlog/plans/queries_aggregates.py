"""Report queries: statistics, digests, breakdowns, top rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg, photos as ph, select as sel
from ..sources import tables as t
from . import sql as q
from .catalog import query

SINCE = "TIMESTAMP '2024-01-20 00:00:00'"


@query("a1_corpus_stats", f"""
WITH {q.MESSAGES} SELECT 'source' AS measure, source AS value, count(*) AS n FROM messages GROUP BY ALL
UNION ALL SELECT 'speaker', speaker, count(*) FROM messages GROUP BY ALL
UNION ALL SELECT 'messages', 'all', count(*) FROM messages
UNION ALL SELECT 'conversations', 'all', count(DISTINCT conversation_id) FROM messages""")
def a1(spark, folder):
    return agg.corpus_stats(t.messages(spark, folder))


_DIARY = """entries AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 = 0 THEN ts END AS indexed_at FROM events WHERE event_type <> 'error'),
feedback AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN ts END AS exported_at, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE props END AS chosen,
  CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS verdict FROM events WHERE event_type = 'error')"""


def _diary(spark, folder):
    e = t.table(spark, folder, "events")
    entries = e.where("event_type <> 'error'").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("indexed_at"))
    k = F.col("event_id") % 5
    feedback = e.where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("exported_at"),
        F.when(k == 0, F.lit(None)).when(k == 1, "  ").otherwise(F.col("props")).alias("chosen"),
        F.when(F.col("value") > 50, "up").otherwise("down").alias("verdict"))
    return entries, feedback


@query("a2_diary_stats", f"""
WITH {_DIARY} SELECT 'entries' AS measure, count(*) AS n FROM entries UNION ALL SELECT 'days', count(DISTINCT day) FROM entries
UNION ALL SELECT 'unindexed', count(*) FROM entries WHERE indexed_at IS NULL UNION ALL SELECT 'feedback', count(*) FROM feedback
UNION ALL SELECT 'pairs_ready', count(*) FROM feedback WHERE exported_at IS NULL AND chosen IS NOT NULL AND length(trim(chosen)) > 0
UNION ALL SELECT 'thumbs_down', count(*) FROM feedback WHERE verdict = 'down'""")
def a2(spark, folder):
    return agg.diary_stats(*_diary(spark, folder))


@query("p2_pending_work", f"""
WITH {_DIARY}, {q.PHOTOS} SELECT 'entry' AS kind, id FROM entries WHERE indexed_at IS NULL
UNION ALL SELECT 'pair', id FROM feedback WHERE exported_at IS NULL AND chosen IS NOT NULL AND length(trim(chosen)) > 0
UNION ALL SELECT 'caption', id FROM photos WHERE rank >= 2 AND id % 3 > 0 AND id % 5 > 0
UNION ALL SELECT DISTINCT 'call', user_id FROM events WHERE event_type = 'view'""")
def p2(spark, folder):
    from ..operators.tables import pending

    entries, feedback = _diary(spark, folder)
    photos = t.photos(spark, folder).withColumns(
        {"caption": F.when(F.col("id") % 3 == 0, "seen"), "dupe_of": F.when(F.col("id") % 5 == 0, F.lit(1))})
    segments = t.table(spark, folder, "events").select(
        F.col("user_id").alias("audio_ref"), F.when(F.col("event_type") != "view", "me").alias("speaker"))
    return (
        entries.where(pending("indexed_at")).select(F.lit("entry").alias("kind"), "id")
        .unionByName(feedback.where(pending("exported_at") & (F.length(F.trim("chosen")) > 0)).select(F.lit("pair").alias("kind"), "id"))
        .unionByName(ph.pending_captions(photos).select(F.lit("caption").alias("kind"), "id"))
        .unionByName(segments.where(pending("speaker")).select(F.lit("call").alias("kind"), F.col("audio_ref").alias("id")).distinct())
    )


@query("a3_majority_language", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1""")
def a3(spark, folder):
    return agg.majority(t.table(spark, folder, "documents"), "source", "lang")


@query("a4_people_report", """
SELECT 'person_' || l_suppkey AS person, count(*) AS faces, count(DISTINCT l_orderkey) AS photos,
  CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY faces DESC, person LIMIT 20""")
def a4(spark, folder):
    faces = t.table(spark, folder, "lineitem").select(
        F.concat(F.lit("person_"), F.col("l_suppkey").cast("string")).alias("person"), F.col("l_orderkey").alias("photo_id"))
    return agg.people_report(faces, t.photos(spark, folder), 20)


@query("a5_talkative_conversations", f"""
WITH {q.MESSAGES} SELECT conversation_id, count(*) AS size, count(*) FILTER (speaker = 'me') AS own FROM messages GROUP BY 1 HAVING count(*) FILTER (speaker = 'me') >= 3""")
def a5(spark, folder):
    return agg.talkative_conversations(t.messages(spark, folder), 3)


_MEDIANS = f"""{q.PHOTOS}, f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM photos),
ranked AS (SELECT folder, taken_at, row_number() OVER (PARTITION BY folder ORDER BY taken_at) - 1 AS i, count(*) OVER (PARTITION BY folder) AS n FROM f WHERE date_source IN ('exif', 'filename')),
med AS (SELECT folder, taken_at AS median FROM ranked WHERE i = n // 2 AND n >= 3)"""


@query("a6_folder_medians", f"WITH {_MEDIANS} SELECT folder, strftime(median, '%Y-%m-%d') AS median FROM med")
def a6(spark, folder):
    return ph.folder_medians(t.photos(spark, folder)).select("folder", F.date_format("median", "yyyy-MM-dd").alias("median"))


@query("a6_exact_median_times", """
WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, epoch_us(ts) AS value FROM r WHERE i = n // 2""")
def a6_times(spark, folder):
    e = t.table(spark, folder, "events").select("user_id", F.unix_micros("ts").alias("us"))
    return sel.exact_rank(e, "user_id", "us", lambda n: F.floor(n / 2))


@query("j7_imputed_dates", f"""
WITH {_MEDIANS} SELECT f.id, strftime(CASE WHEN date_source = 'mtime' AND median IS NOT NULL THEN median ELSE taken_at END, '%Y-%m-%d') AS taken_at,
  CASE WHEN date_source = 'mtime' AND median IS NOT NULL THEN 'folder_median' ELSE date_source END AS date_source FROM f LEFT JOIN med USING (folder)""")
def j7(spark, folder):
    return ph.impute_dates(t.photos(spark, folder)).select("id", F.date_format("taken_at", "yyyy-MM-dd").alias("taken_at"), "date_source")


_AUDIT = """audit AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'view' THEN 'answered' WHEN 'click' THEN 'refused' ELSE 'redacted' END AS outcome,
 CASE WHEN event_id % 3 = 0 THEN ['PHONE_NUMBER', 'EMAIL_ADDRESS'] WHEN event_id % 3 = 1 THEN ['IN_PAN'] END AS redactions FROM events)"""


def _audit(spark, folder):
    e = t.table(spark, folder, "events")
    k = F.col("event_id") % 3
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "view", "answered").when(F.col("event_type") == "click", "refused").otherwise("redacted").alias("outcome"),
        F.when(k == 0, F.array(F.lit("PHONE_NUMBER"), F.lit("EMAIL_ADDRESS"))).when(k == 1, F.array(F.lit("IN_PAN"))).alias("redactions"))


@query("a7_audit_digest", f"""
WITH {_AUDIT}, r AS (SELECT * FROM audit WHERE created_at >= {SINCE})
SELECT 'turns' AS measure, 'all' AS value, count(*) AS n FROM r UNION ALL SELECT 'outcome', outcome, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'redaction', k, count(*) FROM (SELECT unnest(redactions) AS k FROM r) GROUP BY ALL""")
def a7(spark, folder):
    return agg.audit_digest(_audit(spark, folder), F.expr(SINCE))


@query("a8_mood_timeline", f"""
WITH {q.MOODS} SELECT CAST(created_at AS DATE) AS day, mood, count(*) AS n FROM moods WHERE created_at >= {SINCE} AND score >= 0.35 GROUP BY ALL""")
def a8(spark, folder):
    return agg.mood_timeline(t.moods(spark, folder), F.expr(SINCE))


@query("a9_memory_breakdown", f"""
WITH {q.MEMORIES} SELECT measure, value, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM (
 SELECT 'kind' AS measure, kind AS value, ts FROM memories UNION ALL SELECT 'source', source, ts FROM memories UNION ALL SELECT 'trust', trust, ts FROM memories) GROUP BY ALL""")
def a9(spark, folder):
    b = agg.memory_breakdown(t.memories(spark, folder))
    return b.select("measure", "value", "n", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query("a10_scan_report", f"""
WITH {q.PHOTOS} SELECT 'rank' AS measure, CAST(rank AS VARCHAR) AS value, count(*) AS n FROM photos GROUP BY ALL
UNION ALL SELECT 'date_source', date_source, count(*) FROM photos GROUP BY ALL
UNION ALL SELECT 'year', CAST(year(taken_at) AS VARCHAR), count(*) FROM photos WHERE date_source IN ('exif', 'filename') GROUP BY ALL
UNION ALL SELECT 'usable', 'all', count(*) FROM photos WHERE rank >= 2""")
def a10(spark, folder):
    return ph.scan_report(t.photos(spark, folder))


@query("a11_recording_progress", """
WITH c AS (SELECT event_type AS lang, value AS seconds, value BETWEEN 3 AND 90 AS accepted FROM events)
SELECT 'clips' AS measure, CAST(count(*) FILTER (accepted) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'minutes', round(sum(seconds) FILTER (accepted) / 60, 1) FROM c
UNION ALL SELECT 'pct', round(least(100.0, sum(seconds) FILTER (accepted) / 60 * 100 / 45.0), 1) FROM c
UNION ALL SELECT 'rejected', CAST(count(*) FILTER (NOT accepted) AS DOUBLE) FROM c
UNION ALL SELECT 'minutes:' || lang, round(sum(seconds) / 60, 1) FROM c WHERE accepted GROUP BY lang""")
def a11(spark, folder):
    c = t.table(spark, folder, "events").select(
        F.col("event_type").alias("lang"), F.col("value").alias("seconds"), F.col("value").between(3, 90).alias("accepted"))
    return agg.recording_progress(c)


@query("a13_manifest_status", """
SELECT lang AS klass, count(*) AS total, count(*) FILTER (quality = 1) AS done, CAST(coalesce(sum(n_chars) FILTER (quality = 1), 0) AS BIGINT) AS bytes
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def a13(spark, folder):
    files = t.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("klass"), F.col("n_chars").alias("bytes"))
    state = t.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("done"))
    return agg.manifest_status(files, state)


@query("a15_duplicate_files", """
WITH f AS (SELECT doc_id, 'd/' || source || '/' || doc_id AS path, text, CASE WHEN doc_id % 3 = 0 THEN 'caption ' || doc_id END AS caption FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text) AS n, first_value(doc_id) OVER w AS canonical, first_value(caption IGNORE NULLS) OVER w AS inherited FROM f
 WINDOW w AS (PARTITION BY text ORDER BY length(path), path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id AS id, CASE WHEN doc_id <> canonical THEN canonical END AS dupe_of, CASE WHEN doc_id = canonical THEN coalesce(caption, inherited) ELSE caption END AS caption FROM g WHERE n > 1""")
def a15(spark, folder):
    f = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("d/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").alias("size"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("caption "), F.col("doc_id").cast("string"))).alias("caption"))
    return ph.duplicates(f)


@query("a16_evidence_turns", f"""
WITH {q.DIARIZED}, l AS (SELECT *, end_ms - start_ms AS length_ms FROM diarized WHERE end_ms - start_ms >= 60000),
b AS (SELECT *, coalesce(sum(length_ms) OVER (PARTITION BY audio_ref, label ORDER BY length_ms DESC, start_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ms FROM l)
SELECT turn_id, CAST(before_ms AS BIGINT) AS before_ms FROM b WHERE before_ms < 7200000""")
def a16(spark, folder):
    from ..operators.sequence import evidence_turns

    return evidence_turns(t.diarized_turns(spark, folder), 60_000, 7_200_000).select("turn_id", "before_ms")


@query("a18_file_texts", f"""
WITH {q.MESSAGES} SELECT conversation_id, md5({q.strip("string_agg(text, ' ' ORDER BY ts, seq)")}) AS text_md5, count(*) AS pieces FROM messages GROUP BY 1""")
def a18(spark, folder):
    from ..operators.sequence import folded_by_file

    f = folded_by_file(t.messages(spark, folder), "conversation_id", ["ts", "seq"], "text")
    return f.select("conversation_id", F.md5("text").alias("text_md5"), "pieces")


@query("a19_file_report", f"""
WITH {q.MESSAGES} SELECT conversation_id, count(*) AS parsed, count(*) FILTER (seq >= 2) AS new, count(*) FILTER (speaker = 'me') AS own,
 count(*) FILTER (speaker <> 'me') AS other, count(*) FILTER (speaker = 'me') = 0 AS no_owner FROM messages GROUP BY 1""")
def a19(spark, folder):
    return agg.file_report(t.messages(spark, folder), "conversation_id", F.col("seq") >= 2)


@query("a20_by_day", """SELECT CAST(ts AS DATE) AS day, count(*) AS n, epoch_us(max(ts)) AS newest_us FROM events GROUP BY 1""")
def a20(spark, folder):
    return agg.by_day(t.table(spark, folder, "events"), "ts").select("day", "n", F.unix_micros("newest").alias("newest_us"))


@query("t1k_latest_rows", f"WITH {_AUDIT} SELECT id, outcome FROM audit ORDER BY created_at DESC, id DESC LIMIT 50")
def t1k(spark, folder):
    return sel.top_rows(_audit(spark, folder), 50, F.col("created_at").desc(), F.col("id").desc()).select("id", "outcome")


@query("t2k_latest_mood", f"WITH {q.MOODS} SELECT id, mood, score FROM moods ORDER BY created_at DESC, id DESC LIMIT 1")
def t2k(spark, folder):
    m = t.moods(spark, folder)
    return m.agg(F.max_by(F.struct("id", "mood", "score"), F.struct("created_at", "id")).alias("m")).select("m.*")


@query("t3k_random_rows", "SELECT event_id FROM events ORDER BY md5('3|' || event_id), event_id LIMIT 20")
def t3k(spark, folder):
    return sel.seeded_sample(t.table(spark, folder, "events").select("event_id"), 20, 3, ["event_id"])


@query("t4k_longest_texts", """
SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 40""")
def t4k(spark, folder):
    d = t.table(spark, folder, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return sel.top_per_group(d, ["lang"], 40, F.col("n").desc(), F.col("doc_id")).select(
        "doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query("t5k_week_rows", """
SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE ts >= date_trunc('week', TIMESTAMP '2024-01-18') AND ts < date_trunc('week', TIMESTAMP '2024-01-18') + INTERVAL 7 DAY""")
def t5k(spark, folder):
    from ..functions.times import in_week_of

    e = t.table(spark, folder, "events").where(in_week_of(F.col("ts"), F.expr("DATE '2024-01-18'")))
    return e.select("event_id", F.to_date("ts").alias("day"))


@query("t7k_longest_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def t7k(spark, folder):
    d = t.table(spark, folder, "documents").select("doc_id", "n_chars")
    return sel.top_rows(d, 12, F.col("n_chars").desc(), F.col("doc_id"))
