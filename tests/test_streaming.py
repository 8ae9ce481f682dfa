"""Delayed release of corrected reports from a feed of several files."""

from datetime import datetime, timedelta

from downmark.streaming import revisions as ST

START = datetime(2026, 1, 1, 12, 0, 0)
DELAY = 10_000
SCHEMA = "event_id long, ts timestamp, game long, play string, at long, content string"


def rows():
    """(event, game, play, seconds after the start)."""
    plan = [(1, 1, "a", 0), (2, 1, "a", 5),       # corrected in time: only the second shows
            (3, 1, "b", 1), (4, 1, "b", 30),      # corrected after it was shown
            (5, 2, "a", 2), (6, 2, "a", 2),       # two reports at one moment: the later number shows
            (7, 2, "c", 3), (8, 2, "c", 12), (9, 2, "c", 21),  # a chain: each replaces the one before
            (10, 3, "z", 60)]                     # the last report of all
    zero = int(START.timestamp() * 1000)
    return [(e, START + timedelta(seconds=s), g, p, zero + s * 1000, f"r{e}") for e, g, p, s in plan]


def test_release_of_all_reports(spark, tmp_path):
    every = rows()
    folder = str(tmp_path / "feed")
    order = [[0, 2, 4, 6], [1, 5, 3], [7, 8, 9]]  # files do not follow the order of the reports
    for places in order:
        spark.createDataFrame([every[k] for k in places], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    feed = ST.read_feed(spark, folder, SCHEMA, files_per_trigger=1)
    got = ST.release_all(feed, DELAY, "1 minute", str(tmp_path / "run")).collect()
    zero = int(START.timestamp() * 1000)
    assert {(r["event_id"], r["released_at"] - zero, r["revised"]) for r in got} == {
        (2, 15_000, False), (3, 11_000, False), (4, 40_000, True), (6, 12_000, False), (9, 31_000, False), (10, 70_000, False)}
    assert len(got) == 6


def test_nothing_waits_for_ever(spark, tmp_path):
    folder = str(tmp_path / "feed")
    spark.createDataFrame(rows()[:1], SCHEMA).write.parquet(folder)
    got = ST.release_all(ST.read_feed(spark, folder, SCHEMA), DELAY, "0 seconds", str(tmp_path / "run")).collect()
    assert [r["event_id"] for r in got] == [1]


def test_parts_hold_many_plays(spark, tmp_path):
    """A part answers for all of its plays with one timer, whatever the number of parts."""
    folder = str(tmp_path / "feed")
    zero = int(START.timestamp() * 1000)
    plan = [(1, 1, "a", 0), (2, 2, "b", 1), (3, 1, "a", 5), (4, 1, "a", 200), (5, 3, None, 201)]
    for e, g, p, s in plan:
        spark.createDataFrame([(e, START + timedelta(seconds=s), g, p, zero + s * 1000, f"r{e}")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    feed = ST.read_feed(spark, folder, SCHEMA, files_per_trigger=2)
    released = ST.delayed_release(feed, DELAY, "1 minute", parts=1)
    assert "part" in released._jdf.queryExecution().analyzed().toString()
    got = ST.release_all(feed, DELAY, "1 minute", str(tmp_path / "run")).collect()
    assert {(r["event_id"], r["play"], r["released_at"] - zero, r["revised"]) for r in got} == {
        (2, "b", 11_000, False), (3, "a", 15_000, False), (4, "a", 210_000, True), (5, None, 211_000, False)}


def test_held_changes_outlast_packing():
    class Log(list):
        def get(self):
            return iter(list(self))

        def appendList(self, rows):
            self.extend(rows)

        def put(self, rows):
            self[:] = rows

    log = Log()
    handle = type("Handle", (), {"getListState": lambda self, *_: log})()
    expected = {}
    for k in range(40):
        held = ST.Held(handle, "x", most=4, size=3)
        known = held.read()
        assert known == expected
        changed = {k: k * k, k % 7: -k, k - 5: None}
        expected = {x: v for x, v in (expected | changed).items() if v is not None}
        held.write(expected, changed)
    assert len(log) <= 4 + len(expected) // 3
