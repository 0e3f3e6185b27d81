"""States with an end: windows of hits and cooldowns, over batches, replays and late rows."""

import datetime as dt
import random

import pytest

from farewright.streaming import limits

START = dt.datetime(2026, 4, 18)


@pytest.fixture
def run(spark, tmp_path):
    def go(schema, batches, state, fresh_checkpoint=False):
        """Each batch is one more file; the stream is started again for each. Returns (rows, states kept) after each."""
        got = []
        for i, rows in enumerate(batches):
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = limits.to_files(state(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
            q.awaitTermination()
            kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
            got.append((sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr), kept[-1] if kept else None))
        return got

    return go


def second(n):
    return START + dt.timedelta(seconds=n)


def test_rate_limit(run):
    """The window begins at its first hit; a hit at the reset time is still in it, the next one begins another."""
    hits = [("ip", second(s), s) for s in (0, 1, 2, 3, 60, 61, 62)] + [("other", second(5), 5), (None, second(6), 6), (None, second(7), 7)]
    got = run("key string, at timestamp, id long", [hits], lambda s: limits.limited(s, limit=3))
    assert {(k, i): (a, r) for k, _, i, a, r in got[-1][0]} == {
        ("ip", 0): (True, 2), ("ip", 1): (True, 1), ("ip", 2): (True, 0), ("ip", 3): (False, 0), ("ip", 60): (False, 0), ("ip", 61): (True, 2), ("ip", 62): (True, 1),
        ("other", 5): (True, 2), (None, 6): (True, 2), (None, 7): (True, 1)}


def test_states_go_over_batches_and_end(run):
    """A window counts on in the next batch; a state whose time has passed is cleared; a file taken already is not taken again."""
    batches = [[("a", second(0), 1), ("b", second(1), 2)], [("a", second(30), 3), ("a", second(31), 4)], [], [("c", second(4000), 5)], [("d", second(8000), 6)]]
    got = run("key string, at timestamp, id long", batches, lambda s: limits.limited(s, limit=2, seconds=60, delay="10 seconds"))
    assert [(i, a) for _, _, i, a, _ in sorted(got[-1][0], key=lambda r: r[2])] == [(1, True), (2, True), (3, True), (4, False), (5, True), (6, True)]
    assert got[2][0] == got[1][0] and len(got[-1][0]) == 6
    kept = [n for _, n in got]
    assert kept[0] == kept[1] and kept[-1] <= kept[0]


def test_late_hits_are_dropped(run):
    got = run("key string, at timestamp, id long", [[("a", second(10_000), 1)], [("b", second(10_001), 2)], [("a", second(5), 3), ("a", second(10_002), 4)]], lambda s: limits.limited(s, delay="60 seconds"))
    assert [r[2] for r in sorted(got[-1][0], key=lambda r: r[2])] == [1, 2, 4]


def test_cooldown(run):
    hours = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, i, hours(h)) for i, h in enumerate((0, 24, 25, 30))] + [(2, 9, hours(1)), (2, 8, hours(1))]
    got = run("watch_id long, deal_id long, at timestamp", [rows, [(1, 7, hours(48)), (1, 6, hours(50))]], limits.cooled)
    assert sorted((w, d) for w, d, _ in got[-1][0]) == [(1, 0), (1, 2), (1, 6), (2, 8)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_windows_one_by_one(run, cuts):
    """Any cut into batches by time gives what one pass over all hits gives."""
    r = random.Random(cuts)
    hits = sorted((second(r.randrange(3000)), i, r.choice("abc")) for i in range(200))
    state, want = {}, {}
    for at, i, k in hits:
        count, reset = state.get(k, (0, START))
        if count == 0 or reset < at:
            count, reset = 0, at + dt.timedelta(seconds=60)
        state[k] = count + 1, reset
        want[i] = count + 1 <= 5
    size = len(hits) // cuts
    batches = [[(k, at, i) for at, i, k in hits[j * size : (j + 1) * size]] for j in range(cuts)]
    got = run("key string, at timestamp, id long", batches, lambda s: limits.limited(s, limit=5, tie="id"))
    assert {i: a for _, _, i, a, _ in got[-1][0]} == want
