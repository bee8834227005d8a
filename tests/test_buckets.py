"""Bucketed tables, file digests, claims of a stream: each against what it must leave alone."""
import hashlib
import os

from hearthlog.operators import buckets as bk, tables as tb
from hearthlog.sources import files
from hearthlog.streaming import streams as st
from pyspark.sql import functions as F


def names(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, found in os.walk(path) for f in found if f.endswith(".parquet")}


def test_a_change_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(500).selectExpr("id AS k", "0 AS v")
    bk.create(rows, path, ["k"], 16)
    before = names(path)
    touched = bk.change(spark, path, ["k"], 16, spark.createDataFrame([(7, 5)], "k long, v int"), lambda old, new: tb.rewritten(old, new, "k"))
    gone = before - names(path)
    assert len(touched) == 1 and {os.path.dirname(g) for g in gone} == {f"bucket={touched[0]}"}
    assert {r.k: r.v for r in bk.read(spark, path).collect()} == {i: 5 * (i == 7) for i in range(500)}
    assert bk.change(spark, path, ["k"], 16, rows.limit(0), lambda old, new: old) == []


def test_digests_of_large_and_empty_files(spark, tmp_path):
    contents = {"a/large.bin": os.urandom(3_000_000), "b/empty.bin": b"", "c d/odd name.bin": b"x"}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {os.path.relpath(r.path, tmp_path): (r.sha256, r.size) for r in files.file_hashes(files.listing(spark, str(tmp_path), ["bin"]), 1000).collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items() if d}
    asked = spark.createDataFrame([(str(tmp_path / n),) for n in ("none.bin", "b/empty.bin")], "path string")
    assert {os.path.basename(r.path): r.sha256 for r in files.file_hashes(asked).collect()} == {"none.bin": None, "empty.bin": hashlib.sha256(b"").hexdigest()}


def test_listings_by_kind(spark, tmp_path):
    for name in ("x.opus", "y.MP4", "z.txt", "deep/er/w.m4a"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    tail = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    assert tail(files.audio_files(spark, str(tmp_path))) == ["w.m4a", "x.opus"] and tail(files.video_files(spark, str(tmp_path))) == ["y.MP4"]


def test_a_file_that_kills_its_batch_is_set_aside(spark, tmp_path):
    source, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    for value in ("good", "poison", "fine"):
        spark.createDataFrame([(value,)], "v string").coalesce(1).write.mode("append").parquet(source)
    seen = []

    def work(rows):
        values = [r.v for r in rows.collect()]
        if "poison" in values:
            raise ValueError("poison")
        seen.extend(values)

    def start():
        stream = spark.readStream.schema("v string").parquet(source).select("v", F.col("_metadata.file_path").alias("file"))
        st.ingest_claimed(stream, work, ledger, state)

    deaths = 0
    for _ in range(5):
        try:
            start()
        except Exception:  # noqa: BLE001
            deaths += 1
    assert deaths == 2 and sorted(set(seen)) == ["fine", "good"]
    assert sorted(r.state for r in st.ledger_states(spark, ledger).collect()) == [st.ASIDE, st.DONE, st.DONE]
    spark.createDataFrame([("later",)], "v string").coalesce(1).write.mode("append").parquet(source)
    start()
    assert "later" in seen
