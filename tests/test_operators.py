"""Operators without SQL twins against plain loops on small fixtures."""
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlog.operators import clustering as cl, joins, retrieval as rt, sequence as seq, tables as tb, terms
from hearthlog.plans import training
from hearthlog.sources import chat, documents as docs
from hearthlog.streaming import streams as st


def vectors(n, dim=8, groups=5, noise=0.4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, [float(x) for x in centres[rng.integers(groups)] + noise * rng.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("strict,threshold", [(False, 0.42), (True, 0.55), (False, 0.9)])
def test_leader_clusters_match_one_ordered_pass_at_any_pass_size(spark, strict, threshold):
    rows = vectors(150)  # noisy: many rows are close to several leaders
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, [0.0] * 8), (301, None), (302, [0.0] * 8)]
    ok = lambda x: x > threshold if strict else x >= threshold
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    sim = lambda i, j: round(float(unit[i] @ unit[j]), 9)
    leaders, want = [], {}
    for i in unit:
        if not any(ok(sim(i, j)) for j in leaders):
            leaders.append(i)
    for i, _ in rows:
        want[i] = max(((sim(i, j), -j) for j in leaders if ok(sim(i, j))))[1] * -1 if i in unit else i
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for parts, per_pass in ((1, 1000), (5, 7), (3, 1)) if threshold < 0.9 else ((4, 16),):
        got = {r["id"]: r["leader"] for r in cl.leader_clusters(df.repartition(parts), threshold, strict, per_pass).collect()}
        assert got == want
    ranked = cl.ranked_groups(cl.leader_clusters(df, threshold, strict)).select("person", "size").distinct().orderBy("person").collect()
    assert [r["size"] for r in ranked] == sorted((r["size"] for r in ranked), reverse=True)
    assert cl.leader_clusters(df.where("false"), threshold, strict).count() == 0


@pytest.mark.parametrize("threshold", [0.97, 0.9, 0.3])
def test_components_match_all_pairs(spark, threshold):
    rows = vectors(90, noise=0.25)
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # copies of one vector
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(m @ m.T, 9) >= threshold
    ids, root = [i for i, _ in rows], {}
    for k, i in enumerate(ids):
        if i in root:
            continue
        todo = [k]
        root[i] = i
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if ids[j] not in root:
                    root[ids[j]] = i
                    todo.append(j)
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    links = cl.similar_links(df, threshold, pivots=16, chunk_rows=16)
    got = {r["id"]: r["component"] for r in cl.connected_components(df, links).collect()}
    assert got == root
    assert links.count() < len(rows) * 40  # far fewer than the pairs of the copies


def memories(spark, n=80):
    rng = random.Random(7)
    kinds, tiers = ["episodic", "photo", "forward", "diary"], ["public", "personal", "secret"]
    words = "college trip photo wedding exam bank project game river train".split()
    rows = [(i, v, " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))), rng.choice(kinds), "src", datetime(2015, 1, 1) + timedelta(days=40 * i), f"c{i}", "", rng.choice(tiers)) for i, v in vectors(n)]
    return rows, spark.createDataFrame(rows, "memory_id long, vector array<double>, text string, kind string, source string, ts timestamp, conversation_id string, counterpart string, trust string").repartition(4)


def test_dense_and_keyword_do_not_depend_on_passes(spark):
    rows, m = memories(spark)
    q = spark.createDataFrame([(i, rows[i][1], rows[i + 1][2], None, datetime(2018, 1, 1) if i == 2 else None) for i in range(7)],
                              "query_id long, vector array<double>, text string, lo timestamp, hi timestamp")
    dense = sorted(tuple(r) for r in rt.dense_top(q, m, 9).collect())
    assert dense == sorted(tuple(r) for r in rt.dense_top(q, m, 9, per_pass=2).collect())
    v = np.array([r[1] for r in rows])
    for i in range(7):
        ok = [r[0] for r in rows if i != 2 or r[5] < datetime(2018, 1, 1)]
        sims = sorted(((-round(1 - float(((v[j] - v[i]) ** 2).sum()), 9), j) for j in ok))[:9]
        assert [x[1] for x in sorted((x for x in dense if x[0] == i), key=lambda x: x[3])] == [j for _, j in sims]


def bm25(rows, asked, allowed, k):
    """Best (score, id) of one query by a plain loop over all texts."""
    words = {r[0]: re.findall(r"\w+", r[2].lower()) for r in rows}
    mean = sum(map(len, words.values())) / len(rows)
    df = Counter(w for ws in words.values() for w in set(ws))
    score = lambda ws: sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(asked.lower().split()) if w in ws)
    found = [(-round(score(words[r[0]]), 9), r[0]) for r in rows if allowed(r)]
    return sorted(x for x in found if x[0] < 0)[:k]


@pytest.mark.parametrize("halves, seed_rows", [(False, 0), (True, 8)])
def test_keyword_search_equals_a_plain_loop(spark, monkeypatch, halves, seed_rows):
    monkeypatch.setattr(terms, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(terms, "BLOCK_BITS", 3)
    rows, m = memories(spark)
    extra = [(1000 + i, None, "rare%d train river" % (i % 4), "diary", "s", datetime(2016, 1, 1), "c", "", "public") for i in range(60)]
    rows, m = rows + extra, m.unionByName(spark.createDataFrame(extra, m.schema))
    asked = [(0, "rare1 train", None, None, None), (1, "College trip photo", None, datetime(2016, 6, 1), None), (2, "train river exam", datetime(2015, 6, 1), None, ["diary", "photo"]), (3, "unknown words", None, None, None), (4, "", None, None, None)]
    q = spark.createDataFrame(asked, "query_id long, text string, lo timestamp, hi timestamp, kinds array<string>")
    table = rt.term_table(m.where("memory_id % 3 = 0")) if halves else None
    if halves:
        table.append(m)
        table.append(m)  # nothing is new
    got = {}
    for r in rt.keyword_top(q, m, 5, table).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.memory_id))
    for query_id, text, lo, hi, kinds in asked:
        allowed = lambda r: (lo is None or r[5] >= lo) and (hi is None or r[5] < hi) and (kinds is None or r[3] in kinds)  # noqa: B023, E731
        assert sorted(got.get(query_id, [])) == bm25(rows, text, allowed, 5)


def test_diversify_matches_greedy_loop(spark):
    rng = random.Random(3)
    vs = vectors(24, groups=3, noise=0.2)
    rows = [(q, i, v if i % 7 else None, rng.random(), pos) for q in (1, 2) for pos, (i, v) in enumerate(vs[q * 4 :])]
    want = []
    for q in (1, 2):
        pool = [r for r in rows if r[0] == q]
        picked = [pool.pop(0)]
        cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        while pool and len(picked) < 6:
            def value(c):
                seen = [cos(c[2], p[2]) for p in picked if p[2] is not None] if c[2] is not None else []
                return c[3] - 0.45 * (max(seen) if seen else 0.0)
            best = max(pool, key=value)
            picked.append(best)
            pool.remove(best)
        want += [(q, r[1], k + 1) for k, r in enumerate(picked)]
    df = spark.createDataFrame(rows, "query_id long, memory_id long, vector array<double>, score double, position int")
    got = rt.diversify(df, 6).select("query_id", "memory_id", "pick").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_gather(spark):
    rows, m = memories(spark)
    q = spark.createDataFrame([(1, "college trip", rows[0][1]), (2, "meri photo college", rows[5][1]), (3, "exam in 2016", rows[3][1]), (4, "river in 2012", rows[8][1])],
                              "query_id long, text string, vector array<double>")
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    got = rt.gather(q, m, 5, now).select("query_id", "memory_id", "kind", "ts", "pick").collect()
    by = {k: [r for r in got if r["query_id"] == k] for k in (1, 2, 3, 4)}
    assert all(len(by[k]) == 5 for k in (1, 2, 4)) and by[3]
    assert all(r["kind"] != "forward" for r in by[2])
    assert all(r["ts"].year == 2016 for r in by[3])  # stays in the named year
    guest = rt.gather(q, m, 5, now, guest=True).collect()
    public = {r[0] for r in rows if r[8] == "public"}
    assert guest and all(r["memory_id"] in public for r in guest)


def test_assign_speakers(spark):
    s = spark.createDataFrame([("a", 1, 4500, 7000), ("a", 2, 20000, 25000), ("a", 3, 0, 3_000_000)], "audio_ref string, segment_id long, start_ms long, end_ms long")
    t = spark.createDataFrame([("a", 1, "A", 0, 5000), ("a", 2, "B", 5000, 8000), ("a", 3, "A", 8000, 12000)], "audio_ref string, turn_id long, label string, start_ms long, end_ms long")
    for width in (1000, 600_000):
        got = {r["segment_id"]: r["label"] for r in joins.assign_speakers(s, t, width).collect()}
        assert got == {1: "B", 2: None, 3: "A"}


def test_relationships_and_loose_names(spark):
    people = spark.createDataFrame([(0, "Ann / Annie", "friend."), (1, "Bob", ""), (2, "bob", "cousin")], "position int, contact string, relationship string")
    got = {r["alias"]: r["label"] for r in joins.relationship_aliases(people).collect()}
    assert got == {"ann": "Ann (friend)", "annie": "Annie (friend)", "bob": "bob (cousin)"}
    names = spark.createDataFrame([("Tomm....Big (close)",), ("o",), ("zed",), ("",), ("ANN",)], "name string")
    who = spark.createDataFrame([(0, "tomm"), (1, "Bob"), (2, "Ann"), (3, "Annabelle of the long name")], "pos int, who string")
    found = {r["name"]: r["person"] for r in joins.loose_match(names, "name", who, "who", "pos").collect()}
    assert found == {"Tomm....Big (close)": "tomm", "o": "tomm", "zed": None, "": None, "ANN": "Ann"}


CHAT = """13/07/23, 9:10 pm - Messages are end-to-end encrypted.
13/07/23, 9:15 pm - Sunil: hello
second line

13/07/23, 9:16 pm - Owner: <Media omitted>
01/08/23, 12:05 am - Owner: midnight: yes
01/08/23, 12:30 pm - Sunil: This message was deleted
[02/08/23, 9:15:42 PM] Sunil: ‎image omitted
13/13/23, 9:15 pm - Sunil: no such day
02/08/23, 10:00 pm - Sunil created group
tail of the bad day's entry
"""


def test_chat_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "WhatsApp Chat with Sunil.txt").write_text(CHAT, encoding="utf-8")
    (tmp_path / "Chat with B.txt").write_text("7/26/23, 21:15 - B: month first <This message was edited>\n", encoding="utf-8")
    m = chat.read_chats(spark, str(tmp_path), ["owner"])
    got = sorted((r["conversation_id"], r["ts"], r["speaker"], r["speaker_name"], r["text"], r["is_media"]) for r in m.collect())
    d = datetime
    assert got == [
        ("whatsapp:B", d(2023, 7, 26, 21, 15), "other", "B", "month first", False),
        ("whatsapp:Sunil", d(2023, 7, 13, 21, 15), "other", "Sunil", "hello\nsecond line", False),
        ("whatsapp:Sunil", d(2023, 7, 13, 21, 16), "me", "Owner", "[media]", True),
        ("whatsapp:Sunil", d(2023, 8, 1, 0, 5), "me", "Owner", "midnight: yes", False),
        ("whatsapp:Sunil", d(2023, 8, 2, 21, 15, 42), "other", "Sunil", "[media]", True),
    ]
    path = str(tmp_path / "store")
    assert tb.insert_messages(m, path) == 5
    assert tb.insert_messages(m, path) == 0
    assert spark.read.parquet(path).count() == 5


def test_chat_files_in_splits(spark, tmp_path):
    lines = [f"{1 + i % 28:02d}/{1 + i // 28 % 12:02d}/2023, 10:{i % 60:02d} - {'Owner' if i % 3 else 'Ann'}: text {i}\nmore {i}" for i in range(3000)]
    (tmp_path / "Chat with Ann.txt").write_text("\n".join(lines), encoding="utf-8")
    whole = chat.read_chats(spark, str(tmp_path), ["owner"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cut = chat.read_chat_lines(spark, str(tmp_path))
        assert cut.rdd.getNumPartitions() > 3
        order = [r["line"] for r in cut.orderBy("line_no").collect()]
        assert order == "\n".join(lines).split("\n")
        got = chat.parse_chats(cut, ["owner"], rows_per_block=400)
        pick = lambda df: sorted((r["text"], r["speaker"]) for r in df.select("text", "speaker").collect())
        assert pick(got) == pick(whole) and len(pick(got)) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_guest_persona(spark):
    cards = ["# Voice\nshort\n## Family\nAnn\n## Humour style\nkk\n", "no headings at all", "  ", "# Odd\nx"]
    df = spark.createDataFrame(list(enumerate(cards)), "id int, text string")
    got = {r["id"]: r["card"] for r in docs.guest_persona(df, "id", "text").collect()}
    assert got == {0: "# Voice\nshort\n\n## Humour style\nkk\n\n" + docs.GUEST_NOTE, 1: docs.GUEST_NOTE, 2: "", 3: docs.GUEST_NOTE}


def test_training_examples(spark):
    t0 = datetime(2024, 1, 1)
    say = [("other", "hello"), ("other", "are you there"), ("me", "yes I am [media]"), ("me", "tell me"), ("other", "[media]"), ("me", "nice one"), ("me", "[media]")]
    rows = [("whatsapp", "whatsapp:Ann", t0 + timedelta(minutes=i), i, s, None, x) for i, (s, x) in enumerate(say)]
    rows += [("video", "v", t0, 0, "me", None, "never used")]
    m = spark.createDataFrame(rows, "source string, conversation_id string, ts timestamp, seq long, speaker string, speaker_name string, text string")
    people = spark.createDataFrame([(0, "Ann", "friend")], "position int, contact string, relationship string")
    out = training.build_examples(m, people).orderBy("ts").collect()
    got = [[tuple(x) for x in r["messages"]] for r in out]
    system = ("system", "You are talking to Ann (friend).")
    assert got == [
        [system, ("user", "hello\nare you there"), ("assistant", "yes I am tell me")],
        [system, ("user", "hello\nare you there"), ("assistant", "yes I am tell me"), ("assistant", "nice one")],
    ] or got == [
        [system, ("user", "hello\nare you there"), ("assistant", "yes I am \ntell me")],
        [system, ("user", "hello\nare you there"), ("assistant", "yes I am \ntell me"), ("assistant", "nice one")],
    ]


def test_normalized_messages(spark):
    def case(*turns):
        return [{"role": r, "content": c} for r, c in turns]

    rows = [
        (1, case(("system", "s"), ("assistant", "x"), ("user", "a"), ("user", "b"), ("assistant", "c"))),
        (2, case(("user", "a"))),
        (3, case(("assistant", "a"), ("assistant", "b"))),
        (4, case(("user", "a"), ("assistant", "b"))),
    ]
    df = spark.createDataFrame(rows, "id int, m array<struct<role:string,content:string>>")
    for supports, first in ((True, [("system", "s"), ("user", "a\nb"), ("assistant", "c")]), (False, [("user", "s\n\na\nb"), ("assistant", "c")])):
        got = {r["id"]: [tuple(x) for x in r["n"]] if r["n"] is not None else None for r in df.select("id", seq.normalized_messages(F.col("m"), True, supports).alias("n")).collect()}
        assert got == {1: first, 2: None, 3: None, 4: [("user", "a"), ("assistant", "b")]}


def test_spoken_turns_match_a_plain_loop(spark, tmp_path):
    rng = random.Random(8)
    rows, want = [], []
    for session in (1, 2, 3):
        frame, speech = 0, []
        while frame < 4000:
            run = rng.choice([3, 20, 60, 400, 1500] if session == 3 else [3, 20, 60])
            speech += [rng.random() < 0.5] * run
            frame += run
        state, first, got, silence, spoken = 0, None, 0, 0, 0
        for i, talk in enumerate(speech):
            rows.append((session, i, 0.9 if talk else 0.1))
            if talk:
                first = i if first is None else first
                silence, spoken = 0, spoken + 32
            elif first is not None:
                silence += 32
            got += first is not None
            if first is not None and (silence >= 900 or got * 32 / 1000 > 30.0):
                if silence < 900 or spoken >= 400:
                    want.append((session, first, got, spoken))
                first, got, silence, spoken = None, 0, 0, 0
    df = spark.createDataFrame(rows, "session long, frame long, probability double")
    assert sorted(map(tuple, st.spoken_turns(df).collect())) == sorted(want)
    assert sorted(map(tuple, st.spoken_turns(df, rows_per_block=300).collect())) == sorted(want)
    source = str(tmp_path / "frames")
    df.where("frame < 1000").coalesce(1).write.mode("append").parquet(source)
    sink, state = str(tmp_path / "turns"), str(tmp_path / "state")
    run = lambda: st.run_to_end(st.spoken_turns_stream(spark.readStream.schema(df.schema).parquet(source)), sink, state)
    run()
    df.where("frame >= 1000").coalesce(1).write.mode("append").parquet(source)
    assert sorted(map(tuple, run().collect())) == sorted(want)  # a turn open at the cut goes on


def test_table_upkeep(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(2, "z", 1), (3, "w", 0), (2, "old", 0)], "k int, v string, t int")
    assert sorted(map(tuple, tb.upserted(a, b, ["k"], "t").collect())) == [(1, "x", 1), (2, "z", 1), (3, "w", 0)]
    assert [tuple(r) for r in tb.claimed(a, b, "k", "t").collect()] == [(3, -1)]
    assert sorted(map(tuple, tb.rewritten(a, b.where("v = 'z'"), "k").collect())) == [(1, "x", 1), (2, "z", 1)]


def test_every_query_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as entry

    small, may_be_empty = "/root/testdata/sf0.001", {"st5_fresh_state"}  # no user was seen in the last minutes there
    for name, run in entry.queries().items():
        if not name.startswith("op") and name != "pipeline":  # those have tests of their own
            rows = run(spark, small).count()
            assert rows > 0 or name in may_be_empty, name

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_streams_drop_late_rows_and_close_windows(spark, tmp_path):
    source, sink, state, closing = (str(tmp_path / x) for x in ("in", "out", "state", "closing"))
    put = lambda rows: spark.createDataFrame(rows, "created_at timestamp, outcome string").coalesce(1).write.mode("append").parquet(source)
    day = lambda d, h=0: datetime(2024, 1, d, h)
    put([(day(1), "answered"), (day(3), "refused"), (day(3, 5), "refused")])
    counts = lambda: st.run_changes(st.audit_windows(spark.readStream.schema("created_at timestamp, outcome string").parquet(source)), sink, state, ["day", "outcome"])
    found = lambda df: sorted((r["day"].day, r["outcome"], r["n"]) for r in df.collect())
    assert found(counts()) == [(1, "answered", 1), (3, "refused", 2)]
    put([(day(1, 9), "answered"), (day(3, 6), "refused"), (day(3, 1), "answered")])  # the first is days late
    assert found(counts()) == [(1, "answered", 1), (3, "answered", 1), (3, "refused", 3)]

    rows = spark.readStream.schema("created_at timestamp, outcome string").parquet(source)
    sessions = st.conversation_sessions(st.with_closing_rows(rows, closing), "outcome", "created_at")
    sink, state = sink + "-sessions", state + "-sessions"
    st.run_to_end(sessions, sink, state)
    spark.createDataFrame([(day(9), None)], "created_at timestamp, outcome string").write.mode("append").parquet(closing)
    out = st.run_to_end(sessions, sink, state).where("outcome IS NOT NULL")
    assert sorted((r["outcome"], r["first"].day, r["last"].hour, r["n"]) for r in out.collect()) == [
        ("answered", 1, 0, 1), ("answered", 1, 9, 1), ("answered", 3, 1, 1), ("refused", 3, 6, 3)]


def test_postings_of_a_block_equal_counts_of_its_words():
    import pyarrow as pa
    from collections import Counter
    from hearthlog.operators import terms

    rows = [(5, "a b a", 0), (3, "é a", 0), (1030, "b", 1), (1031, "b b a", 1), (1040, "z", 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some]), pa.array([len(r[1].split()) for r in some], pa.int32()),
                                           pa.array([r[2] for r in some], pa.int64())], names=["memory_id", "text", "length", "block"]) for some in (rows[:3], rows[3:])]
    got = [r for b in terms._blocks(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len({(r["term"], r["block"]) for r in got}) and all(r["n"] == len(r["ids"]) for r in got)
    assert Counter({(r["term"], r["block"], i, n): t for r in got for i, t, n in zip(r["ids"], r["tf"], r["length"])}) == Counter(
        {(w, block, i, len(text.split())): n for i, text, block in rows for w, n in Counter(text.split()).items()})


def test_rare_and_common_terms_add_up(monkeypatch):
    import numpy as np
    from hearthlog.operators import terms

    rng = np.random.default_rng(3)
    rows, names, questions = 50, 40, 30
    has = rng.random((names, questions)) < np.linspace(0.01, 0.9, names)[:, None]
    weights = np.where(has, rng.random((names, questions)), 0)
    gains = np.where(rng.random((rows, names)) < np.linspace(0.02, 0.9, names), rng.random((rows, names)), 0)
    place, term = np.nonzero(gains)
    asked = np.nonzero(has)[1], np.append(0, np.cumsum(has.sum(axis=1)))
    for rare, pairs in ((0, 7), (1, 7), (32, 1 << 20), (10 ** 9, 100)):
        monkeypatch.setattr(terms, "RARE", rare)
        monkeypatch.setattr(terms, "PAIRS_AT_A_TIME", pairs)
        assert np.allclose(terms._products(place, term, gains[place, term], rows, weights, asked), gains @ weights)
