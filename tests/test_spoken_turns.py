"""Endpointing of long sessions by composed block maps against the frame-by-frame machine."""
import random

import pandas as pd
import pytest
from hearthlog.streaming import streams as st

SCHEMA = "session long, frame long, probability double"


def plain(rows):
    out = []
    for session in sorted({r[0] for r in rows}):
        state = st._IDLE
        for _, frame, p in sorted(r for r in rows if r[0] == session):
            state, turn = st._step(state, frame, p >= st.SPEECH_PROBABILITY)
            if turn:
                out.append((session, *turn))
    return sorted(out)


def frames(seed, sessions, n, quiet, pause):
    """Speech with single quiet frames, and pauses of up to `pause` frames."""
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        i = 0
        while i < n:
            for _ in range(rng.randrange(1, 400)):
                rows.append((s, 3 * i, 0.0 if rng.random() < quiet else 0.9))
                i += 1
            for _ in range(rng.randrange(pause + 1)):
                rows.append((s, 3 * i, 0.1))
                i += 1
    return rows


@pytest.mark.parametrize("quiet, pause, blocks", [(0.0, 0, (None, 64)), (0.3, 28, (700, 1)), (0.1, 45, (5000, 3)), (0.9, 10, (None, 2))])
def test_turns_of_any_stretches_equal_the_machine(spark, quiet, pause, blocks):
    rows = frames(7, 2, 9000, quiet, pause)
    got = st.spoken_turns(spark.createDataFrame(rows, SCHEMA).repartition(3), *blocks).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_one_session_of_continuous_speech_is_spread(spark):
    """No group that a task folds holds more than a block of the one stretch."""
    rows = [(1, i, 0.9) for i in range(60_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, st.spoken_turns(df, 5000, 4).collect())) == plain(rows)
    blocks = df.selectExpr("session", "0L AS part", "frame AS at")
    starts = st.long_stretch_starts(blocks, 4)
    assert sorted(r["at"] for r in starts.collect()) == list(range(0, 60_000, st._LONGEST))


def test_no_table_of_turns_is_broadcast(spark):
    """However small they lie on disk, frames and turns are merged; only checked-small names of stretches are broadcast."""
    rows = frames(3, 3, 3000, 0.1, 45)
    out = st.spoken_turns(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.collect())) == plain(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]  # what ran, where it is adaptive
    assert plan.count("BroadcastHashJoin") <= 2  # the long stretches, named for the maps and for the turns


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("quiet, pause", [(0.0, 0), (0.3, 28), (0.1, 45), (0.5, 60), (0.9, 10), (0.97, 30)])
@pytest.mark.parametrize("batch", [1, 7, 29, 500, 20_000])
def test_the_stream_goes_from_turn_to_turn_and_not_from_frame_to_frame(monkeypatch, quiet, pause, batch):
    rows = frames(11, 1, 4000, quiet, pause)
    want = plain(rows)
    monkeypatch.setattr(st, "_step", lambda *_: pytest.fail("a call for a frame"))
    detector = st.TurnDetector()
    detector._open, got = Held(), []
    for at in range(0, len(rows), batch):
        part = pd.DataFrame(rows[at:at + batch], columns=["session", "frame", "probability"])
        (packed,) = st.packed_frames(iter([part]))
        assert len(packed) == 1  # one row of a session for a batch
        for out in detector.handleInputRows((0,), iter([packed]), None):
            got += list(out.itertuples(index=False, name=None))
    assert [tuple(map(int, r)) for r in got] == want
