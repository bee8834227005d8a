"""Scores against a plain model of dictionaries; Elias-Fano sequences against arrays."""
import hashlib
import math
import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hearthlog.llm import elias_fano, ngram_trie

DOCS = "doc_id long, text string, block string"
ODD = [(None, "a b c a b d"), (1, None), (2, ""), (3, " \n"), (4, "A b C"), (4, "A b C"), (5, "the the the the cat"), (6, "ÉCOLE école x"), (7, "long " * 5000 + "tail"), (8, "never seen Words here"), (9, "a b c a b d a b c")]


def step(x):
    return 10.0 ** (math.floor(-math.log10(x) * 4096 + 0.5) / -4096)


def brute_force(rows, class_tokens, frequent=1 << 18):
    docs = []
    for key, text in rows:
        mark = None if key is None else zlib.crc32(str(key).encode())
        docs.append((key, mark or 0, mark is not None and mark % 5 == 1, (text or "").encode().lower().split() + [b""]))
    n, total = Counter(), Counter()
    for _, _, held, words in docs:
        total.update(words)
        if not held:
            n.update(words)
    least = next(1 << p for p in range(64) if sum(t >= 1 << p for t in total.values()) <= frequent)
    often = {w for w, t in total.items() if t >= least}
    z = sum(n.values()) + 0.5 * (len(n) + 1)

    def grams(mark, words):
        before = [b" ", b" ", *words]
        for v, u, w in zip(before, before[1:], words):
            seen = n[b""] if u == b" " else n[u] if u in often else 0
            parts = max(1, -(-seen // class_tokens))
            part = (mark if u == b" " else int(hashlib.md5(v).hexdigest()[:8], 16)) % parts
            yield (u, part), v, w

    c3, c2 = defaultdict(Counter), defaultdict(Counter)
    for _, mark, held, words in docs:
        for u, v, w in grams(mark, words) if not held else ():
            c3[u, v][w] += 1
            c2[u][w] += 1
    out = []
    for key, mark, held, words in docs:
        score = 0.0
        for u, v, w in grams(mark, words):
            p = (n[w] + 0.5) / z
            for level in (c2.get(u), c3.get((u, v))):
                if level:
                    c = sum(level.values())
                    p = (step((level[w] - 0.75) / c) if level[w] else 0) + step(0.75 * len(level) / c) * p
            score += math.log10(p)
        out.append((key, held, len(words), sum(n[w] > 0 for w in words), sum(n.values()), sum(math.log10((n[w] + 0.5) / z) for w in words), score))
    return out


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-5)


@pytest.mark.parametrize("class_tokens, shard_tokens, frequent", [(200_000, 1_500_000, 1 << 18), (3, 500, 1 << 18), (3, 2000, 4)])
def test_odd_texts_equal_brute_force(spark, monkeypatch, class_tokens, shard_tokens, frequent):
    monkeypatch.setattr(ngram_trie, "CLASS_TOKENS", class_tokens)
    docs = spark.createDataFrame([(k, t, "x") for k, t in ODD], DOCS).repartition(3)
    same(ngram_trie.scored(docs, shard_tokens=shard_tokens, frequent_words=frequent).collect(), brute_force(ODD, class_tokens, frequent))
    assert ngram_trie.scored(docs.limit(0)).count() == 0


def test_documents_equal_brute_force_and_held_out_texts_gain(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "CLASS_TOKENS", 500)
    monkeypatch.setattr(ngram_trie, "CHUNK_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = ngram_trie.scored(docs, frequent_words=1000).collect()
    same(got, brute_force([(r.doc_id, r.text) for r in docs.collect()], 500, 1000))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 12, (400, 3)).astype(np.uint64)
    grams, n = np.unique(grams, axis=0, return_counts=True)
    contexts, words = np.arange(12, dtype=np.uint64), np.arange(13, dtype=np.uint64)  # the last word is not known
    places = grams.astype(np.int64)
    trie = ngram_trie.Trie(ngram_trie.Trie.arrays(contexts, words, places[:, 0], places[:, 1], places[:, 2], n.astype(float)))
    p1 = np.append((np.bincount(places[:, 2], weights=n, minlength=12) + 0.5) / (n.sum() + 0.5 * 13), 0.5 / (n.sum() + 0.5 * 13))
    for u in (0, 5, 99):
        for v in (0, 3, 12):
            a, g = trie.parts(np.array([u], np.uint64), words, np.zeros(13, np.int64), np.full(13, v), np.arange(13))
            assert abs((a + g * p1).sum() - 1) < 1e-3


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5, 9], [0, 2 ** 64 - 1], list(range(0, 300_000, 7)), [2 ** 63 + 10 ** 9 * i for i in range(40_000)]])
def test_elias_fano_gives_back_and_finds(values):
    values = np.array(values, np.uint64)
    level = elias_fano.EliasFano(elias_fano.encode(values))
    assert (level.all() == values).all() and len(level) == len(values)
    if len(np.unique(values)) == len(values):
        asked = np.unique(np.concatenate((values[::3], values[::5] + np.uint64(1)))) if len(values) else np.arange(3, dtype=np.uint64)
        where = {v: i for i, v in enumerate(values.tolist())}
        assert level.find(asked).tolist() == [where.get(v, -1) for v in asked.tolist()]


def test_columns_come_back():
    columns = [np.array([], np.int64), np.array([0, 3, 255]), np.array([70_000, 1]), np.array([2 ** 64 - 1, 4], np.uint64)]
    assert [c.tolist() for c in ngram_trie._spread(ngram_trie._squeezed(columns))] == [c.tolist() for c in columns]


@pytest.mark.parametrize("split_tokens, frequent", [(1, 1 << 18), (3, 1 << 18), (3, 4)])
def test_parts_of_contexts_move_work_and_no_scores(spark, monkeypatch, split_tokens, frequent):
    monkeypatch.setattr(ngram_trie, "SPLIT_TOKENS", split_tokens)
    monkeypatch.setattr(ngram_trie, "COUNTED", 4)
    docs = spark.createDataFrame([(k, t, "x") for k, t in ODD], DOCS).repartition(3)
    same(ngram_trie.scored(docs, shard_tokens=500, frequent_words=frequent).collect(), brute_force(ODD, 1 << 60, frequent))


def test_documents_in_parts_equal_whole_contexts(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SPLIT_TOKENS", 20)
    monkeypatch.setattr(ngram_trie, "CHUNK_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(ngram_trie.scored(docs, shard_tokens=2000).collect(), brute_force([(r.doc_id, r.text) for r in docs.collect()], 1 << 60))


def test_a_context_of_many_tokens_is_one_context(spark):
    # the digest of the word before each "the" tells the word after it
    digit = lambda v: int(hashlib.md5(v.encode()).hexdigest()[:8], 16) % 2
    rows = [(i, " ".join(f"{v} the w{digit(v)}" for v in (f"v{(1500 * i + j) % 499}" for j in range(1500)))) for i in range(200)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], DOCS)
    same(ngram_trie.scored(docs).collect(), brute_force(rows, 1 << 60))


def test_counts_travel_in_few_bytes_and_come_back():
    rng = np.random.default_rng(2)
    words, counts = rng.permutation(100_000).astype(np.int64) << 40, np.append(rng.integers(0, 2000, 99_999), 1_700_000)
    held = ngram_trie.Frequent(words, counts, 700_000, 5)
    held.parts[7] = 9
    raw = pickle.dumps(held)
    assert len(raw) < 16 * len(words)  # every worker gets them with each of its tasks
    back = pickle.loads(raw)
    for name in ("words", "counts", "context_words", "context_counts", "parts"):
        assert (getattr(back, name) == getattr(held, name)).all()


def test_texts_come_to_workers_in_small_batches(spark, monkeypatch):
    key, seen, counted = "spark.sql.execution.arrow.maxRecordsPerBatch", [], ngram_trie.vocabulary
    monkeypatch.setattr(ngram_trie, "vocabulary", lambda rows: (seen.append(rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["key"]) for b in bs), "key long").agg({"key": "max"}).first()[0]), counted(rows))[1])
    before = spark.conf.get(key)
    rows = [(i, "a b") for i in range(5000)]
    assert ngram_trie.scored(spark.createDataFrame([(k, t, "x") for k, t in rows], DOCS).coalesce(1)).count() == 5000
    assert seen[0] <= 1000 and spark.conf.get(key) == before


def test_blocks_have_every_word_and_every_row():
    texts = ["", " \n", "A b\tÉ\x0bc ", "x\x85y\x00 z\x1cw", "  the The"] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[p:p + 4])], names=["text"]) for p in range(0, len(texts), 4)]
    for most in (0, 1, 10, 1000):
        got = []
        for chunk in ngram_trie._chunks(iter(batches), "text", most):
            known, tokens, starts = ngram_trie._flat(chunk.column("text"))
            got += [[known[t] for t in tokens[p:q]] for p, q in zip(starts, [*starts[1:], len(tokens)])]
        assert got == [[*t.encode().lower().split(), b""] for t in texts]
