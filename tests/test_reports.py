"""Movement, end situation, hurries and receivers on hand-made reports."""

import pytest

from downmark.functions import reports as R

FIELDS = ("play_id int, text string, type string, is_penalty boolean, is_turnover boolean, scoring_play boolean, scoring string, score_value int, stat_yards int, "
          "own_abbr string, other_abbr string, start_team string, end_team string, start_down int, start_distance int, start_ytg int, start_spot string, "
          "end_down int, end_distance int, end_ytg int, end_spot string")


def report(i, text, end_ytg, kind="rush", stat=None, end_team="A", down=2, distance=6, spot=None):
    return (i, text, kind, False, False, False, "", 0, stat, "AAA", "BBB", "A", end_team, 1, 10, 60, "AAA 40", down, distance, end_ytg,
            spot or (f"AAA {100 - end_ytg}" if end_ytg > 50 else f"BBB {end_ytg}"))


CASES = [
    (report(1, "#2 R.Back rush middle for 4 yards", 56, stat=4), (4, 4, 0), "2nd & 6 at AAA 44"),
    (report(2, "#2 R.Back rush middle for 4 yards PENALTY BBB Holding 10 yards from AAA44", 46, stat=4), (14, 4, 10), "2nd & 6 at BBB 46"),
    (report(3, "#2 R.Back rush middle for 4 yards PENALTY BBB Holding 10 yards from AAA44", 45, stat=4), None, "2nd & 6 at BBB 45"),
    (report(4, "PENALTY AAA False Start 5 yards from AAA40. NO PLAY.", 65), (-5, 0, -5), "2nd & 6 at AAA 35"),
    (report(5, "#2 R.Back rush middle for 4 yards PENALTY BBB Holding declined", 56, stat=4), (4, 4, 0), "2nd & 6 at AAA 44"),
    (report(6, "#2 R.Back rush middle for 4 yards PENALTY BBB X 5 yards from AAA44 PENALTY AAA Y 5 yards from AAA44", 56, stat=4), None, "2nd & 6 at AAA 44"),
    (report(7, "#2 R.Back rush middle for 9 yards", 56, stat=4), None, "2nd & 6 at AAA 44"),
    (report(8, "#1 Q.Back sacked at AAA35 for loss of 5 yards", 65, kind="sack", stat=-5, distance=15), (-5, -5, 0), "2nd & 15 at AAA 35"),
    (report(9, "#2 R.Back rush middle for 55 yards", 5, stat=55, distance=5, down=1), (55, 55, 0), "1st & goal at BBB 5"),
    (report(10, "#2 R.Back rush middle for 4 yards", 56, stat=4, end_team="B"), None, "2nd & 6 at AAA 44"),
    (report(11, "#2 R.Back rush middle for 4 yards", 56, stat=4, down=5), (4, 4, 0), ""),
    (report(12, "#2 R.Back rush middle for 10 yards", 50, stat=10, spot="50", down=1, distance=10), (10, 10, 0), "1st & 10 at 50"),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([c[0] for c in CASES], FIELDS)
    out = R.with_movement(R.describe(df)).selectExpr("play_id", "movement", f"{R.end_situation()} as situation").collect()
    return {r["play_id"]: r for r in out}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0][1][:40])
def test_movement_and_end(read, case):
    row = read[case[0][0]]
    assert (tuple(row["movement"]) if row["movement"] else None) == case[1]
    assert row["situation"] == case[2]


@pytest.mark.parametrize(("text", "name"), [
    ("pass incomplete QB hurried by #55 D.End PENALTY BBB holding", "#55 D.End"), ("pass incomplete, QB hurried by D.End", "D.End"),
    ("QB hurried by D.End and thrown away", ""), ("QB hurried by #9 D.End Jr. (tipped)", "#9 D.End Jr."), ("QB hurried by D.End, TOUCHDOWN", "D.End"), ("no hurry", "")])
def test_hurries(spark, text, name):
    assert spark.createDataFrame([(text,)], "text string").selectExpr(R.named_hurry()).first()[0] == name


@pytest.mark.parametrize(("text", "actor", "receiver"), [
    ("#1 Q.Back pass complete short left to #80 W.Out, 1st down", "#1 Q.Back", "#80 W.Out"), ("#1 Q.Back pass complete deep right to #80 W.Out for 20 yards", "#1 Q.Back", "#80 W.Out"),
    ("#1 Q.Back pass incomplete to #80 W.Out (broken up)", "#1 Q.Back", "#80 W.Out"), ("#2 R.Back rush middle for 4 yards", "#2 R.Back", "")])
def test_players(spark, text, actor, receiver):
    df = spark.createDataFrame([(text, "pass reception")], "primary string, type string")
    row = R.with_players(df).first().asDict()
    assert row["actor"] == actor and (row["receiver"] or "") == receiver
