"""SQL for the table adapters, shared by the equivalent queries."""

MESSAGES = """messages AS (
 SELECT CASE conv_id % 4 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'call' WHEN 2 THEN 'voice_note' ELSE 'video' END AS source,
        'chat:' || conv_id AS conversation_id,
        make_timestamp(1704067200000000 + (conv_id % 3650) * 86400000000 + turn * 60000000) AS ts,
        turn AS seq,
        CASE role WHEN 'assistant' THEN 'me' ELSE 'other' END AS speaker,
        CASE WHEN role <> 'assistant' THEN 'guest' || (conv_id % 7) END AS speaker_name,
        text
 FROM conversations WHERE role <> 'system')"""

EVENT_TURNS = """turns AS (
 SELECT 'event' AS source, 'user:' || user_id AS conversation_id, ts, event_id AS seq,
        CASE WHEN event_type IN ('view', 'click') THEN 'me' ELSE 'other' END AS speaker,
        event_type AS speaker_name, event_type || ' ' || props AS text
 FROM events)"""

DOCUMENT_TURNS = """turns AS (
 SELECT 'document' AS source, 'doc:' || source AS conversation_id,
        make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ts, doc_id AS seq,
        CASE WHEN doc_id % 3 = 2 THEN 'me' ELSE 'other' END AS speaker, source AS speaker_name, text, lang
 FROM documents)"""

SEGMENTS = """segments AS (
 SELECT 'rec' || user_id AS audio_ref, event_id AS segment_id, epoch_us(ts) // 1000 AS start_ms,
        epoch_us(ts) // 1000 + CAST(round(value * 60000) AS BIGINT) AS end_ms, event_type AS speaker, props AS text
 FROM events WHERE event_type IN ('view', 'click'))"""

DIARIZED = """diarized AS (
 SELECT 'rec' || user_id AS audio_ref, event_id AS turn_id, epoch_us(ts) // 1000 AS start_ms,
        epoch_us(ts) // 1000 + CAST(round(value * 60000) AS BIGINT) AS end_ms, event_type AS label
 FROM events WHERE event_type NOT IN ('view', 'click'))"""

MOODS = """moods AS (
 SELECT event_id AS id, user_id, ts AS created_at,
        CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'happy' WHEN 'purchase' THEN 'surprised'
             WHEN 'signup' THEN 'tired' ELSE 'stressed' END AS mood,
        value / 500 AS score
 FROM events)"""

MEMORIES = """memories AS (
 SELECT d.doc_id AS memory_id, e.embedding AS vector, d.text,
        CASE d.doc_id % 5 WHEN 0 THEN 'episodic' WHEN 1 THEN 'fact' WHEN 2 THEN 'diary' WHEN 3 THEN 'photo' ELSE 'forward' END AS kind,
        d.source, make_timestamp((1483228800 + (d.doc_id % 3000) * 86400) * 1000000) AS ts,
        'doc:' || d.source AS conversation_id, 'guest' || (d.doc_id % 9) AS counterpart,
        CASE d.doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'personal' ELSE 'secret' END AS trust
 FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

PHOTOS = """photos AS (
 SELECT o_orderkey AS id,
        '/archive/' || o_orderpriority || '/cust' || o_custkey || '/IMG_' || o_orderkey || '.jpg' AS path,
        CAST(o_orderdate AS TIMESTAMP) AS taken_at,
        CASE o_orderkey % 4 WHEN 0 THEN 'exif' WHEN 1 THEN 'filename' WHEN 2 THEN 'exif_modified' ELSE 'mtime' END AS date_source,
        CAST(o_orderkey % 4 AS INTEGER) AS rank, o_totalprice, o_orderstatus
 FROM orders)"""

# whitespace-separated words of a text
WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
TRIM = "trim({c}, E' \\t\\n\\r\\x0b\\x0c')"


def words(c: str) -> str:
    return WORDS.replace("{c}", c)


def strip(c: str) -> str:
    return TRIM.replace("{c}", c)


def target_problem(c: str, low: int = 2, high: int = 250) -> str:
    w = words(c)
    return rf"""CASE WHEN regexp_matches({c}, '^[^\p{{L}}\p{{N}}\p{{M}}_]*$') OR lower({c}) = '[media]' THEN 'empty_or_media'
      WHEN len({w}) < {low} THEN 'too_short' WHEN len({w}) > {high} THEN 'too_long'
      WHEN len({w}) >= 6 AND len(list_distinct({w})) <= greatest(2, len({w}) // 4) THEN 'repetitive' END"""


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
