"""Sharding of tables without rows to fill gaps."""
import random
from collections import Counter

from hearthlog.llm import sharding


def test_groups_stay_whole_when_every_text_is_copied(spark):
    rng = random.Random(4)
    sizes = [900, 130] + [min(60, int(2 / rng.random() ** 0.8)) for _ in range(400)]
    texts = [f"text {g}" for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.sharded(docs).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1 and all(r.linked for r in rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    cut = [t for t, s in where.items() if len(s) > 1]
    assert len(cut) < 24 and sum(len(s) for s in where.values()) <= len(where) + 900 // min(counts.values()) + 24
