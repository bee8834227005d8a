"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, exact_dedup, html_text, language, manifest, mixing, ngram_trie, packing, quality, sharding, simhash, url_filter, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenized(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return language.query(spark, folder)


@query("op3_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.ledger(read(spark, folder, "documents"))


@query("op4_warc", """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM h""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, folder, "pages")).drop("intact")


@query("op5_balanced_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(read(spark, folder, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(read(spark, folder, "documents"))
    return found.withColumn("fingerprint", simhash.hex_print("fingerprint"))


@query("op7_quality_rules", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
s AS (SELECT doc_id, i, word || chr(1) || lead(word) OVER o || chr(1) || lead(word, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM s WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS x(j) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words,
  CAST(len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS BIGINT) AS n_shout_words,
  CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims FROM t LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(len(lines) AS BIGINT) AS n_lines, n_shout_words, n_exclaims FROM m),
f AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines)::INT
  + 16 * (10 * n_shout_words > 5 * n_words)::INT + 32 * (5 * n_exclaims > n_words)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
  + 128 * (100 * n_repeat_words > 20 * n_words)::INT AS failed FROM k)
SELECT * EXCLUDE (failed), CAST(failed AS BIGINT) AS failed, (failed & 3) <> 0 AS base_failed, (failed & 127) = 0 AS kept FROM f""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.ledger(read(spark, folder, "documents"))
    base = ~quality.passes(F.col("failed"), "base")
    return rows.withColumn("base_failed", base).withColumn("kept", quality.passes(F.col("failed")))


@query("op8_source_mixing", f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
p AS (SELECT *, 2.0 * source_size / weight AS full_at, coalesce(sum(2 * source_size) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS gone, 1.5 * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW b AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (total - caps) / (weights - gone) AS lev FROM p),
c AS (SELECT *, min(CASE WHEN full_at <= lev THEN 1 ELSE 0 END) OVER (ORDER BY full_at, source) = 1 AS capped FROM q),
l AS (SELECT *, (any_value(total) OVER () - coalesce(sum(CASE WHEN capped THEN 2 * source_size END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size ELSE level * weight END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
u AS (SELECT d.doc_id, d.size, r.*, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS (SELECT *, k, floor(rate) + CASE WHEN CAST('0x' || substr(digits, k + 1, 8) AS BIGINT) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM u, generate_series(0, 24) AS g(k)),
b AS (SELECT source, k FROM e GROUP BY source, k, target QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - target), k) = 1)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.k = b.k""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(read(spark, folder, "documents"))


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return html_text.extracted(pages, html_text.train(pages))


@query("op10_url_filter")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(read(spark, folder, "pages"), url_filter.train(url_filter.labelled(spark)))


# CRC-32 of the decimal doc_id: each character is mixed in and shifted out over eight steps
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""
_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LEAF = lambda n_chars: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', n_chars, 'text')))})"
_SIBLING = "CASE WHEN s.digest IS NULL THEN '.' WHEN s.pos % 2 = 0 THEN 'L' || s.digest ELSE 'R' || s.digest END"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF("(n_chars + 1)")} END AS told FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, lev, pos, n, digest) AS (SELECT lang, 0, pos, n, leaf FROM l
  UNION ALL SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lev, n, pos // 2),
r AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lev, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM r UNION ALL SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lev, n, pos // 2),
v AS (SELECT r.lang, list({_SIBLING} ORDER BY o.lev) AS steps FROM r JOIN u AS o ON o.n > 1 AND o.pos = r.pos >> o.lev LEFT JOIN u AS s ON s.lev = o.lev AND s.pos = xor(o.pos, 1) GROUP BY r.lang),
w AS (SELECT l.lang, l.pos, list({_SIBLING} ORDER BY o.lev) AS steps FROM l JOIN t AS o ON o.n > 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.pos = l.pos >> o.lev
  LEFT JOIN t AS s ON s.lang IS NOT DISTINCT FROM o.lang AND s.lev = o.lev AND s.pos = xor(o.pos, 1) GROUP BY l.lang, l.pos),
p AS (SELECT doc_id, leaf, coalesce(told, leaf) AS shown, subroot, (SELECT digest FROM u WHERE n = 1) AS root, list_concat(coalesce(w.steps, []), coalesce(v.steps, [])) AS steps
  FROM l JOIN r ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN w ON w.lang IS NOT DISTINCT FROM l.lang AND w.pos = l.pos LEFT JOIN v ON v.lang IS NOT DISTINCT FROM l.lang),
q AS (SELECT *, list_reduce(list_concat([shown], steps), lambda a, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM q""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.audited(read(spark, folder, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_STEPS = lambda x: f"pow(10.0, floor(-log10({x}) * 4096 + 0.5) / -4096)"


@query("op13_ngram_trie", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS mark, list_concat(list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), ['']) AS words FROM documents),
t AS (SELECT r, doc_id, coalesce(mark, 0) AS mark, coalesce(mark % 5 = 1, false) AS held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
c AS (SELECT w, count(*) FILTER (WHERE NOT held_out) AS n, count(*) AS total FROM t GROUP BY w),
b AS (SELECT min(p) AS least FROM (SELECT CAST(pow(2, unnest(range(0, 62))) AS BIGINT) AS p) WHERE (SELECT count(*) FROM c WHERE total >= p) <= 524288), k AS (SELECT c.*, total >= least AS often FROM c, b),
z AS (SELECT sum(n) AS tokens, sum(n) + 0.5 * (count(*) FILTER (WHERE n > 0) + 1) AS total FROM c),
x AS (SELECT *, lag(w, 1, ' ') OVER o AS u, lag(w, 2, ' ') OVER o AS v FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
y AS (SELECT x.*, c.n, CASE WHEN u = ' ' THEN mark ELSE CAST('0x' || substr(md5(v), 1, 8) AS BIGINT) END % greatest(1, CAST(ceil(CASE WHEN k.often THEN k.n ELSE 0 END / 200000.0) AS BIGINT)) AS part
  FROM x JOIN c USING (w) JOIN k ON k.w = CASE WHEN u = ' ' THEN '' ELSE u END),
g3 AS (SELECT u, part, v, w, count(*) AS n3 FROM y WHERE NOT held_out GROUP BY ALL), h3 AS (SELECT u, part, v, sum(n3) AS c3, count(*) AS t3 FROM g3 GROUP BY ALL),
g2 AS (SELECT u, part, w, sum(n3) AS n2 FROM g3 GROUP BY ALL), h2 AS (SELECT u, part, sum(n2) AS c2, count(*) AS t2 FROM g2 GROUP BY ALL),
p AS (SELECT r, doc_id, held_out, y.n, (y.n + 0.5) / z.total AS p1, coalesce({_STEPS("(n2 - 0.75) / c2")}, 0) AS p2, coalesce({_STEPS("0.75 * t2 / c2")}, 1) AS w2,
  coalesce({_STEPS("(n3 - 0.75) / c3")}, 0) AS p3, coalesce({_STEPS("0.75 * t3 / c3")}, 1) AS w3, z.tokens
  FROM y LEFT JOIN h2 USING (u, part) LEFT JOIN g2 USING (u, part, w) LEFT JOIN h3 USING (u, part, v) LEFT JOIN g3 USING (u, part, v, w), z)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE n > 0) AS n_known, CAST(any_value(tokens) AS BIGINT) AS train_tokens,
  round(sum(log10(p1)), 6) AS base_score, round(sum(log10(p3 + w3 * (p2 + w2 * p1))), 6) AS score FROM p GROUP BY r""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_trie.scored(read(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


