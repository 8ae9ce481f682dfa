"""Live jobs over feeds of several files: corrections, picks, taps, boards, late rows and reruns."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from downmark.streaming import live as LV
from downmark.streaming import revisions as ST

START = datetime(2026, 1, 1)
ZERO = int(START.timestamp() * 1000)


def feed(spark, folder, slices, schema):
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return ST.read_feed(spark, str(folder), schema, 1)


def test_corrections_take_old_figures_off(spark, tmp_path):
    slices = [[(1, "a", 1, "home", 1, 5), (1, "b", 2, "home", 0, 3)], [(1, "a", 3, "away", 1, 7), (2, "z", 4, "home", 1, 1)], [(1, "b", 5, "home", 0, 3), (1, "a", 0, "home", 9, 9)]]
    stream = feed(spark, tmp_path / "in", slices, "game long, play string, event_id long, team string, passes long, points long")
    got = {(r["game"], r["team"]): (r["plays"], r["passes"], r["points"]) for r in LV.running_insights(stream, ["passes", "points"], str(tmp_path / "run"), parts=3).collect()}
    assert got == {(1, "home"): (1, 0, 3), (1, "away"): (1, 1, 7), (2, "home"): (1, 1, 1)}
    log = LV.read_batches(spark, str(tmp_path / "run"), "game long, team string, plays long, passes long, points long")
    # the second batch says only what it changed, the third nothing but an unchanged row of zeros at most
    assert {(r["game"], r["team"], r["plays"]) for r in log.filter("batch = 1").collect()} == {(1, "home", -1), (1, "away", 1), (2, "home", 1)}
    assert log.filter("batch = 2").agg(F.sum(F.abs("plays"))).first()[0] in (None, 0)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a", 1)], "game long, play string, version int")
    for _ in range(2):
        LV.write_batch(batch, str(tmp_path), 0)
        LV.write_batch(batch.withColumn("version", F.lit(2)), str(tmp_path), 1)
    log = LV.read_batches(spark, str(tmp_path), batch.schema)
    assert log.count() == 2
    once = LV.compact(log, 1)
    assert [tuple(r) for r in once.collect()] == [(1, "a", 2, 1)] == [tuple(r) for r in LV.compact(once, 1).collect()]


def test_picks_settle_void_and_close(spark, tmp_path):
    plan = [[(1, "a", 1, 0, "p", True), (1, "a", 2, 10, "x", False), (1, "b", 3, 11, "p", True)],           # a settled; b waits
            [(1, "a", 4, 20, "x", False), (1, "c", 5, 21, "p", True), (1, "c", 6, 22, "y", False)],         # the same again changes nothing
            [(1, "a", 7, 30, "z", False), (1, "c", 8, 500, "w", False), (1, "d", 9, 501, "p", True)]]       # a void; c too late to void
    rows = [[(g, p, e, START + timedelta(seconds=s), ZERO + 1000 * s, c, k) for g, p, e, s, c, k in part] for part in plan]
    stream = feed(spark, tmp_path / "in", rows, "game long, play string, event_id long, ts timestamp, at long, content string, is_pick boolean")
    log = LV.run_to_end(stream, lambda f: LV.settle_picks(f, 60_000, 300_000, "10 seconds"), str(tmp_path / "run"), "10 seconds")
    got = {(r["play"], r["pick_id"], r["status"], r["report_id"]) for r in LV.last_status(log).collect()}
    assert got == {("a", 1, "void", 2), ("b", 3, "closed", None), ("c", 5, "settled", 6), ("d", 9, "closed", None)}


def test_one_sample_per_tap(spark, tmp_path):
    plan = [[(1, "a", 1, 0, "receipt"), (1, "b", 2, 5, "receipt"), (1, "", 3, 9, "tap"), (1, "", 4, 10, "tap")],  # the first receipt holds; the second tap has none
            [(1, "c", 5, 20, "receipt"), (1, "c", 6, 21, "receipt"), (1, "", 7, 22, "tap")],                      # a new version takes it away
            [(1, "d", 8, 30, "receipt"), (1, "", 9, 31, "break"), (1, "", 10, 32, "tap"), (1, "e", 11, 40, "receipt")],
            [(1, "", 12, 47, "tap")]]                                                                              # held over the batches
    stream = feed(spark, tmp_path / "in", plan, "game long, play string, event_id long, at long, role string")
    got = {(r["tap_id"], r["receipt_id"], r["millis"]) for r in ST.run_available(LV.delay_samples(stream)).collect()}
    assert got == {(3, 1, 9), (12, 11, 7)}


@pytest.mark.parametrize("cuts", [(3, 6), (1, 2, 3, 4, 5, 6, 7, 8), ()])
def test_board_says_the_same_however_the_feed_is_cut(spark, tmp_path, cuts):
    """Delay 10, gap 20: superseded plays go, what is due together shows once, breaks are told."""
    rows = [(1, "a", 1, 0, "x"), (1, "b", 2, 4, "x"), (1, "b", 3, 6, "y"), (1, "c", 4, 16, "x"), (1, "d", 5, 16, "x"),
            (1, "e", 6, 70, "x"), (1, "f", 7, 75, "x"), (1, "f", 8, 76, "x"), (1, "g", 9, 79, "x")]
    rows = [(g, p, e, START + timedelta(seconds=s), ZERO + 1000 * s, c) for g, p, e, s, c in rows]
    edges = [0, *cuts, len(rows)]
    stream = feed(spark, tmp_path / "in", [rows[a:b] for a, b in zip(edges[:-1], edges[1:])], "game long, play string, event_id long, ts timestamp, at long, content string")
    got = LV.run_to_end(stream, lambda f: LV.board(f, 10_000, 20_000, "5 seconds"), str(tmp_path / "run"), "5 seconds").collect()
    shown = sorted((r["event_id"], r["kind"], (r["at"] - ZERO) // 1000, r["merged"]) for r in got if r["kind"] != "break")
    assert shown == [(3, "snap", 16, 2), (5, "snap", 46, 2), (9, "snap", 109, 3)]
    assert sorted((r["reason"], r["event_id"]) for r in got if r["kind"] == "break") == [("batch", 5), ("queue_catchup", 9), ("response_gap", 6)]


def test_old_reports_of_unseen_plays_are_late(spark, tmp_path):
    slices = [[(1, "a", 5, "x"), (1, "b", 3, "x")], [(1, "c", 4, "x"), (1, "a", 2, "y"), (1, "d", 9, "x"), (2, "a", 1, "x")]]
    stream = feed(spark, tmp_path / "in", slices, "game long, play string, event_id long, content string")
    got = {(r["game"], r["play"], r["event_id"], r["late"], r["first_poll"]) for r in ST.run_available(LV.split_late(stream)).collect()}
    assert got == {(1, "a", 5, False, True), (1, "b", 3, False, True), (1, "c", 4, True, False), (1, "a", 2, False, False), (1, "d", 9, False, False), (2, "a", 1, False, True)}


def test_a_part_holds_many_picks(spark, tmp_path):
    """All plays in one part: picks of several plays settle, void and close as those of one do, over triggers and timers."""
    plan = [[(1, "a", 1, 0, "p", True), (2, "a", 2, 1, "p", True), (1, "a", 3, 10, "x", False)],
            [(2, "a", 4, 70, "x", False), (1, None, 5, 71, "p", True), (1, "a", 6, 80, "y", False)],
            [(1, None, 7, 90, "x", False), (1, "a", 8, 1000, "z", False), (1, None, 9, 1001, "y", False)]]
    rows = [[(g, p, e, START + timedelta(seconds=s), ZERO + 1000 * s, c, k) for g, p, e, s, c, k in part] for part in plan]
    stream = feed(spark, tmp_path / "in", rows, "game long, play string, event_id long, ts timestamp, at long, content string, is_pick boolean")
    log = LV.run_to_end(stream, lambda f: LV.settle_picks(f, 60_000, 300_000, "10 seconds", parts=1), str(tmp_path / "run"), "10 seconds")
    got = {(r["game"], r["play"], r["pick_id"], r["status"], r["report_id"]) for r in LV.last_status(log).collect()}
    assert got == {(1, "a", 1, "void", 3), (2, "a", 2, "closed", None), (1, None, 5, "settled", 7)}


def test_a_part_holds_many_games(spark, tmp_path):
    rows = [(1, "a", 1, 0, "x"), (2, "a", 2, 4, "x"), (1, "b", 3, 6, "y"), (2, "a", 4, 16, "z"), (3, "q", 5, 17, "x"), (1, "e", 6, 70, "x"), (2, "f", 7, 75, "x")]
    rows = [(g, p, e, START + timedelta(seconds=s), ZERO + 1000 * s, c) for g, p, e, s, c in rows]
    stream = feed(spark, tmp_path / "in", [rows[:2], rows[2:5], rows[5:]], "game long, play string, event_id long, ts timestamp, at long, content string")
    got = LV.run_to_end(stream, lambda f: LV.board(f, 10_000, 20_000, "5 seconds", parts=1), str(tmp_path / "run"), "5 seconds").collect()
    shown = sorted((r["game"], r["event_id"], r["kind"], (r["at"] - ZERO) // 1000, r["merged"]) for r in got if r["kind"] != "break")
    assert shown == [(1, 3, "snap", 36, 2), (1, 6, "snap", 100, 1), (2, 2, "snap", 16, 1), (2, 4, "context", 46, 1), (2, 7, "snap", 105, 1), (3, 5, "snap", 47, 1)]
    assert sorted((r["game"], r["reason"], r["event_id"]) for r in got if r["kind"] == "break") == [(1, "queue_catchup", 3), (1, "response_gap", 6), (2, "response_gap", 7)]


@pytest.mark.parametrize("columns", [(("game", "play", "event_id"),), ()])
def test_slices_land_in_as_many_files(spark, tmp_path, columns):
    from downmark.plans import stream_queries as SQ
    events = spark.range(0, 100, 1, 3).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "id % 7 as user_id", "'view' as event_type", "double(id) as value",
                                                  """concat('{"k": ', id % 5, '}') as props""")
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = SQ.sliced_feed(spark, str(tmp_path), 3, "if(event_id < 60, 0, if(event_id < 90, 1, 2))", *columns, file_rows=5)
    out = str(tmp_path / "out")
    LV.append_batches(stream, out)
    got = LV.read_batches(spark, out, stream.schema).groupBy("batch").agg(F.min("event_id"), F.max("event_id"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 59, 60), (1, 60, 89, 30), (2, 90, 99, 10)]
