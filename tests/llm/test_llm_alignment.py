"""Tokenizer alignment against whole-text tokenizing and plain counting; perfect hashes against dictionaries."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hearthlog.llm import alignment
from hearthlog.llm.perfect_hash import PerfectHash
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a  b", "a\nb", "\nBar  x \n y", "x \t y", "end ", "two  ", "  b c  d", "ÉCOLE café 東京都 ▁literal", "<|endoftext|> and <s> </s> <0x41>", "it's they'll 12345 --- ***",
       "a\x00b", "\r\n;\r\nx", "é ﬁ \U0001f600\U0001f468‍\U0001f469", "　wide   em", "a\x1c b\x85 c", "http://x.y/z?q=1&r=2 " * 3, "aaaa" * 300, "ab " * 3000, "▁", "x▁ y", "same text", "same text"]


def brute_force(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    byte_of = {chr(i if i in shown else next(hidden)): i for i in range(256)}
    rows, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            p = q = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                r, s = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
                groups.append((ids_a[p:r], ids_b[q:s]))
                p, q = r, s
        rows.append(groups)
        counts.update({(x, y) for g, h in groups for x in g for y in h})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups in rows:
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def plain(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_odd_texts_and_any_split_equal_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(None if i == 4 else i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, pairs string").repartition(3, "doc_id")
    got = alignment.aligned(docs, A, B, fan=2).collect()
    want = dict(zip([None if i == 4 else i for i in range(len(ODD))], brute_force(ODD)))
    assert {r.doc_id: p for r, p in zip(got, plain(got))} == want and len(got) == len(ODD)
    assert alignment.aligned(docs.limit(0), A, B).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect())
    got = sorted(alignment.aligned(docs.repartition(5), A, B, fan=2).collect())
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert plain(got) == brute_force([r.text for r in rows])


def test_units_forgotten_and_counts_handed_on_early_change_nothing(monkeypatch):
    texts = [t for t in ODD if t] * 2
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 10)
    memory = alignment.Remembered(alignment.Tokenizers(A, B), shown=True, most=3)
    want = [b[:4] for b in brute_force(texts)]
    for text, (n_a, n_b, groups, links) in zip(texts, want):
        sizes, at, _ = memory.chunk([text])
        sums = memory.numbers[:, at].sum(axis=1).tolist()
        assert sums == [n_a, n_b, groups, links] or (not n_a and not memory.same[at].all())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_is_a_bijection(n):
    keys = np.array(random.Random(n).sample(range(1 << 40), n), np.int64)
    hashed = PerfectHash.of(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(n))
    assert len(hashed.index(np.arange(100))) == 100
    assert 64 * len(hashed.bits) < 5 * n + 400


def test_tree_of_sums_and_unions(spark):
    rows = [(s, np.array(sorted(random.Random(i).sample(range(50), 5)), "<i8").tobytes()) for i in range(40) for s in (0, 1)]
    frame = spark.createDataFrame(rows, "slice int, pairs binary")
    want = {s: sorted({x for t, raw in rows if t == s for x in np.frombuffer(raw, "<i8").tolist()}) for s in (0, 1)}
    assert {r.slice: np.frombuffer(r.pairs, "<i8").tolist() for r in alignment.tree(frame, "pairs", alignment._union, 3).collect()} == want
    vectors = spark.createDataFrame([(0, np.full(4, i, "<i8").tobytes()) for i in range(10)], "slice int, counts binary")
    assert np.frombuffer(alignment.tree(vectors, "counts", alignment._sum, 2).first().counts, "<i8").tolist() == [45] * 4
