"""Near-duplicates by five-word similarity against all pairs."""
import random

import corpus_pipeline
import pytest
from hearthlog.llm import similar

FOLDER = "/root/testdata/sf0.001"


def brute_force(rows):
    """Keys that stay: smallest of each group linked by five-word set similarity of at least 0.8."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    first = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            first[find(i)] = min(key, first.get(find(i), key))
    losers = {key for i, (key, _) in enumerate(rows) if key is not None and key != first[find(i)]}
    return sorted((r for r in rows if r[0] not in losers), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
    return words


def planted(seed):
    rng = random.Random(seed)
    lexicon = [f"word{i}" for i in range(400)]
    license_line = [rng.choice(lexicon) for _ in range(40)]
    rows, key = [], 0
    for base in range(40):  # copies on both sides of 0.8, some under a common passage
        words = [rng.choice(lexicon) for _ in range(rng.choice([12, 60, 150, 600]))] + license_line * (base % 3 == 0)
        for copy in range(rng.choice([1, 2, 4])):
            rows.append((key := key + 1, " ".join(edited(rng, words, rng.randrange(len(words) // 30 + 2) if copy else 0))))
    hub = [rng.choice(lexicon) for _ in range(150)]
    for _ in range(70):  # one large group, most pairs of which are under 0.8
        rows.append((key := key + 1, " ".join(edited(rng, hub, rng.randrange(1, 5)))))
    rows += [(key + 1, None), (key + 2, ""), (key + 3, " \n"), (None, "no key"), (None, "no key"), (key + 4, "no key"), (key + 5, "No  KEY"), (key + 6, rows[0][1]), (key + 6, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("common", [6, 10 ** 9])
def test_groups_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "OFTEN", common)
    rows = planted(common % 97)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in similar.representatives(docs).collect()), key=str)
    assert got == brute_force(rows) and len(got) < len(rows) - 60
    assert similar.representatives(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_copies_at_the_threshold(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(3)
    long_ones = [t.split() for _, t in rows if len(t.split()) > 200][:20]
    rows += [(10_000 + i, " ".join(edited(rng, w, max(1, len(w) // 60)))) for i, w in enumerate(long_ones)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, more, FOLDER).collect()), key=str)
    assert got == brute_force(rows) and sum(k >= 10_000 for k, _ in got) < 5


def test_prefixes_of_alike_sets_meet():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.sample(range(1000), rng.randrange(1, 60))
        b = [x for x in a if rng.random() < 0.93] + rng.sample(range(1000, 2000), rng.randrange(5))
        if b and 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)):
            assert set(sorted(a)[: similar.prefix_length(len(a))]) & set(sorted(b)[: similar.prefix_length(len(b))])


def test_boilerplate_under_the_threshold_meets_nowhere(spark):
    rng = random.Random(4)
    common = [f"common{i}" for i in range(88)]
    rows = [(i, " ".join([f"own{rng.randrange(10 ** 9)}" for _ in range(16)] + common)) for i in range(400)]
    met = similar.meetings(spark.createDataFrame(rows, "node long, text string"))
    assert met.count() < 100
    assert similar.links(spark.createDataFrame(rows, "node long, text string")).count() == 0


def test_every_pair_of_a_whole_table_is_connected(spark):
    """Recall of the stage on whole documents: all pairs of five-word similarity 0.8 or more, found by an inverted index."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = list({" ".join((t or "").lower().split()): (k, t) for k, t in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in similar.representatives(docs).collect()), key=str) == brute_force(rows)


def test_fingerprints_bring_near_copies_together_before_runs_do(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "more"])), (2, " ".join(rng.sample(words, 3000))), (3, " ".join(words).replace(" ", "\n"))]
    texts = spark.createDataFrame(rows, "node long, text string")
    assert similar.simhash.fingerprint(rows[0][1]) == similar.simhash.fingerprint(rows[3][1])
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in similar.fingerprint_pairs(texts).collect()}
    assert (0, 3) in pairs and pairs & {(0, 1), (1, 3)} and not any(2 in p for p in pairs)
    asked = []
    monkeypatch.setattr(similar, "fingerprint_pairs", lambda t, make=similar.fingerprint_pairs: asked.append(t) or make(t))
    assert len(similar.links(texts).collect()) == 2 and asked
