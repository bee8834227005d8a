"""The corpus pipeline, stage by stage against plain versions."""
from collections import Counter

import corpus_pipeline
from hearthlog.llm import mixing, quality
from test_llm_similar import brute_force

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = docs.columns, None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, FOLDER).write.parquet(path := f"{tmp_path}/{number}")
        docs = spark.read.parquet(path)
        left = docs.collect()
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        if name == "quality_rules":
            keeps = lambda t: not sum(1 << i for i, test in enumerate(quality.RULES) if test in quality.POLICIES["v2"] and fails(test, t))
            assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in before if keeps(r.text))
        elif name == "exact_dedup":
            best = {}
            for r in before:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
                best[text] = max(best.get(text, -1), r.doc_id)
            assert sorted(r.doc_id for r in left) == sorted(best.values())
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in left) == sorted(key for key, _ in brute_force([(r.doc_id, r.text) for r in before]))
        elif name == "source_mixing":
            want = Counter({r.doc_id: r.copies for r in mixing.plan(spark.read.parquet(f"{tmp_path}/{number - 1}")).collect()})
            assert Counter(r.doc_id for r in left) == +want
    whole = Counter(r.doc_id for r in before)
    assert {r.doc_id for r in left} == set(whole) and Counter(r.doc_id for r in left if r.piece == 0) == whole
    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in run) == Counter((r.doc_id, r.piece, r.length) for r in left)


def fails(rule, text):
    n, chars, symbols, dup, repeated, lines, shouts, exclaims = quality.measured(text)
    return {"few_words": n < 50, "repeated_windows": 100 * repeated > 50 * n, "symbols": 10 * symbols > n, "repeated_lines": lines >= 4 and 10 * dup > 4 * lines,
            "shouting": 10 * shouts > 5 * n, "exclaiming": 5 * exclaims > n, "word_length": chars < 2 * n or chars > 15 * n}[rule]
