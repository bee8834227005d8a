"""Merkle manifests against a plain tree, for any band height, and the sweeps by themselves."""
import hashlib
import random
import zlib

import pytest
from hearthlog.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold(leaves):
    """Root of a tree and the proof steps of each leaf."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(at):
            pair = place ^ 1
            steps[i].append("." if pair >= len(level) else ("L" if place & 1 else "R") + level[pair])
            at[i] = place >> 1
        level = [H(*level[j:j + 2]) for j in range(0, len(level), 2)]
    return level[0], steps


def plain(rows):
    by_lang = {}
    for r in rows:
        told = None
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
            told = H(*map(field, (*r[:3], None if r[3] is None else r[3] + 1, r[4])))
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*map(field, r[:5])), told, r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: (sorted(by_lang[lang]), *fold([x[2] for x in sorted(by_lang[lang])])) for lang in langs}
    root, tops = fold([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        leaves, subroot, steps = trees[lang]
        for (_, _, leaf, told, key), own in zip(leaves, steps):
            proof, folded = own + top, told or leaf
            for s in proof:
                folded = H(s[1:], folded) if s[0] == "L" else H(folded, s[1:])
            out.append((key, leaf, subroot, root, H(*(s[1:] for s in proof)), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    rng = random.Random(n)
    return [(i, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5, 60]), rng.choice([None, "", "Text é", "x" * 1000]), "clash") for i in range(n)]


ODD = [(None, "s", "en", 1, "no key", "t"), (None, "s", "en", 1, "no key", "t"), (3, None, None, None, None, None), (3, None, None, None, None, None), (3, "s", "en", 2, "same key", "t"), (3, "s", "en", 2, "other text", "t"), (-5, "s", "", 0, "", "t"), (7, "é", "zz", 9, "lone", "t")]


@pytest.mark.parametrize("rows, height", [(ODD, 6), (rows_of(150, ["en", "de", None, "é"]), 2), (rows_of(70, ["en"]), 6), (rows_of(1, ["en"]), 6)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, rows, height):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = manifest.manifest(docs, height=height, extra=manifest.tampered(docs))
    got = got.withColumn("folded", manifest.folded(manifest.F.coalesce("extra", "leaf"), got["proof"]))
    found = [(r.doc_id, r.leaf, r.subroot, r.root, H(*(s[1:] for s in r.proof)), r.folded, r.folded == r.root) for r in got.collect()]
    assert sorted(found, key=str) == plain(rows)


def test_audit_columns_and_an_empty_table(spark):
    rows = rows_of(60, ["en", "fr", None])
    docs = spark.createDataFrame(rows, DOCS)
    got = manifest.audited(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert {r.verified for r in got} == {True, False}
    assert manifest.audited(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
def test_sweeps_of_one_block(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = manifest.levels_of(n, 6)
    digests = manifest.forward(leaves, levels)
    root, steps = fold(leaves)
    assert digests[-1] == [root] and manifest.backward(digests, ["top"]) == [s + ["top"] for s in steps]
