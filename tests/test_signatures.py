"""Components by signatures beside the exact ones: links are true, and few linked pairs are kept apart."""
import numpy as np
from hearthlog.operators import clustering as cl

THRESHOLD = 0.45


def test_most_linked_pairs_are_connected_and_no_others(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    v = centres[rng.integers(60, size=900)] + 0.75 * rng.normal(size=(900, 24))
    v[:40] = v[40:80]  # equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    links = cl.signature_links(df, THRESHOLD, signatures=12, chunk_rows=64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = np.round(u @ u.T, 9) >= THRESHOLD
    assert all(close[r.src, r.dst] for r in links.collect())
    label = {r.id: r.component for r in cl.connected_components(df, links).collect()}
    a, b = np.nonzero(np.triu(close, 1))
    recall = np.mean([label[i] == label[j] for i, j in zip(a.tolist(), b.tolist())])
    assert len(a) > 3000 and recall >= 0.9


def test_a_table_of_one_stretch_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(80, 8)))]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    by = lambda links: {r.id: r.component for r in cl.connected_components(df, links).collect()}
    assert by(cl.signature_links(df, 0.7, 1, 4096, 1)) == by(cl.similar_links(df, 0.7))
    assert cl.signature_links(df.limit(0), 0.7).count() == 0


def test_rows_of_many_blocks_and_link_tasks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cl, "LINKS_PER_TASK", 100)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 12))
    v[:30] = v[30:60]
    df = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = np.round(u @ u.T, 9) >= 0.75
    label = np.arange(700)
    while (lower := np.where(close, label[None, :], 700).min(axis=1)).tolist() != label.tolist():
        label = lower
    links = cl.similar_links(df, 0.75, pivots=1, chunk_rows=60)  # twelve blocks
    got = {r.id: r.component for r in cl.connected_components(df, links).collect()}
    assert got == {3 * i: 3 * int(x) for i, x in enumerate(label)}


def test_no_row_is_copied_for_each_pair_of_blocks(spark, monkeypatch):
    """Pairs of blocks are numbers; what is written of the vectors grows with the rows alone."""
    written = []
    frame = type(spark.range(0))
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda self: written.append((self.columns, self.count())) or write(self)))
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "id long, vector array<double>")
    cl.similar_links(df, 0.9, pivots=1, chunk_rows=20)
    rows = [n for columns, n in written if "vector" in columns]
    assert rows and max(rows) == 400
