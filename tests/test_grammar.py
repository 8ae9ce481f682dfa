"""Sentence shapes of reports, and drives that hand-made reports make up."""

import pytest
from test_reports import FIELDS, report

from downmark.functions import grammar as GR
from downmark.functions import reports as R
from downmark.operators import games as G

SHAPES = [
    # text, run type, actor, receiver
    ("#1 Q.Back pass complete short left to #80 W.Out for 5 yards", False, "#1 Q.Back", "#80 W.Out"),
    ("Shotgun #1 Q.Back pass complete short left to #80 W.Out caught at AAA48, for 5 yards", False, "#1 Q.Back", "#80 W.Out"),
    ("(12:03) (Shotgun) Q.Back pass deep middle to W.Out for 22 yards", False, "Q.Back", "W.Out"),
    ("(1:03) (No Huddle, Shotgun) Q.Back pass short right to W.Out pushed ob at BBB20", False, "Q.Back", "W.Out"),
    ("No Huddle-Shotgun #4 M.Mads pass incomplete deep to #19 R.Jones thrown to ORE29", False, "#4 M.Mads", "#19 R.Jones"),
    ("#70 B.Tackle reported in as eligible. #1 Q.Back pass complete to #80 W.Out for 3 yards", False, "#1 Q.Back", "#80 W.Out"),
    ("Q.Back pass incomplete to W.Out [D.End].", False, "Q.Back", "W.Out"),
    ("Q.Back pass incomplete to W.Out. Penalty review", False, "Q.Back", "W.Out"),
    ("Q.Back pass to Amon-Ra St.Brown ran ob", False, None, None),
    ("Q.Back pass short to Amon-Ra St.Brown ran ob", False, "Q.Back", "Amon-Ra St.Brown"),
    ("Q.Back pass short to Odell de la Cruz Jr. for 9 yards", False, "Q.Back", "Odell de la Cruz Jr."),
    ("Q.Back pass incomplete, thrown away", False, "Q.Back", None),
    ("#1 Q.Back pass intercepted by X", False, "#1 Q.Back", None),
    ("#1 Q.Back sacked at AAA20 for loss of 5 yards", False, "#1 Q.Back", None),
    ("#22 R.Back rush middle for 4 yards gain", True, "#22 R.Back", None),
    ("Robert Back rush left for no gain", True, "Robert Back", None),
    ("R.Back scrambles right end for 9 yards", True, "R.Back", None),
    ("R.Back left tackle for 3 yards", True, "R.Back", None),
    ("R.Back left tackle for 3 yards", False, None, None),
    ("R.Back up the middle for 3 yards", True, "R.Back", None),
    ("R.Back right guard to BBB 20", True, "R.Back", None),
    ("R.Back up the field", True, None, None),
    ("Team rush for loss of 2 yards", True, "Team", None),
    ("fumbled snap by R.Back rush", True, None, None),
    ("Timeout AAA", False, None, None),
    ("", False, None, None),
    ("PENALTY BBB Offside 5 yards from AAA40", False, None, None),
    ("#1 Q.Back pass complete deep right to #80 W.Out TOUCHDOWN (kick)", False, "#1 Q.Back", "#80 W.Out"),
]


@pytest.mark.parametrize(("text", "run", "actor", "receiver"), SHAPES)
def test_players_of_a_sentence(spark, text, run, actor, receiver):
    row = spark.createDataFrame([(text, run)], "text string, run boolean").selectExpr(f"{GR.players('text', 'run')} as p").first()["p"]
    assert (row["actor"], row["receiver"] if row["actor"] else None) == (actor, receiver)


@pytest.mark.parametrize(("text", "yards"), [
    ("rush for 4 yards", 4), ("rush for -3 yards", -3), ("rush for 3 yards loss to AAA20", -3), ("rush for 3 yards gain", 3), ("sacked for loss of 7 yards", -7),
    ("sacked for a loss of 1 yard", -1), ("rush for no gain", 0), ("rush middle", None), ("for 4 yds", 4), ("for 4 yards PENALTY BBB 10 yards", 4), ("PENALTY for 10 yards", None),
    ("for 6 yards, for loss of 2 yards", -2), ("thrown for 3 at AAA20", None)])
def test_yards_of_a_sentence(spark, text, yards):
    assert spark.createDataFrame([(text,)], "primary string").selectExpr(f"{R.reported_yards()} as y").first()["y"] == yards


@pytest.mark.parametrize(("text", "name"), [
    ("x PENALTY BBB Pass Interference (#4 A.B) 15 yards from BSU32", "Pass Interference"), ("PENALTY AAA holding 10 yards from AAA20. NO PLAY.", "Holding"), ("x PENALTY BBB holding declined", ""),
    ("x PENALTY BBB Offside offsetting", ""), ("PENALTY A Hold 5 yards PENALTY B Hold 5 yards", ""), ("no ruling", ""), ("PENALTY BBB Roughing the Passer 15 yds", "Roughing the Passer"), ("PENALTY BBB", "")])
def test_the_one_ruling(spark, text, name):
    assert spark.createDataFrame([(text,)], "text string").selectExpr(f"{R.accepted_penalty()} as n").first()["n"] == name


@pytest.mark.parametrize(("text", "name"), [
    ("pass incomplete QB hurried by #1 B.Alexander PENALTY ORE", "#1 B.Alexander"), ("QB hurried by D.End #12 X", "D.End"), ("QB hurried by Dan End Original Play: y", "Dan End"),
    ("QB hurried by D.End and Y", ""), ("QB hurried by", ""), ("QB hurried", "")])
def test_hurries(spark, text, name):
    assert spark.createDataFrame([(text,)], "text string").selectExpr(f"{R.named_hurry()} as n").first()["n"] == name


@pytest.mark.parametrize(("text", "facts"), [
    ("Shotgun #1 Q.Back pass complete short left to X", ["Shotgun", "Short pass to the left"]), ("No Huddle-Shotgun Q pass incomplete deep middle", ["Shotgun", "No huddle", "Deep pass over the middle"]),
    ("R.Back rush right for 3 yards", ["Run to the right"]), ("R.Back rush middle", ["Run through the middle"]), ("pass complete short to X", ["Short pass"]), ("kick", [])])
def test_facts(spark, text, facts):
    assert spark.createDataFrame([(text,)], "primary string").selectExpr(f"{R.reported_facts()} as f").first()["f"] == facts


# --- drives ------------------------------------------------------------------------------------


def rush(i, start, gained, down=1, **more):
    row = list(report(i, f"#2 R.Back rush middle for {gained} yards", start - gained, stat=gained, down=down + 1))
    row[15], row[16] = start, f"AAA {100 - start}" if start > 50 else f"BBB {start}"
    row[13] = down
    for name, value in more.items():
        row[[f.split()[0] for f in FIELDS.split(", ")].index(name)] = value
    return tuple(row)


def ruled(i, start, end, text, kind="penalty", **more):
    return rush(i, start, start - end, text=text, type=kind, stat_yards=None, is_penalty=True, **more)


DRIVES = {
    "whole": [rush(1, 75, 2), ruled(2, 73, 68, "PENALTY BBB Offside 5 yards from AAA27. NO PLAY", start_down=2), rush(3, 68, 4, 2), rush(4, 64, 5, 3)],
    "broken": [rush(1, 75, 2), rush(2, 65, 4, 2)],
    "unknown": [rush(1, 75, 2), ruled(2, 73, 58, "PENALTY BBB Offside. NO PLAY", start_down=2), rush(3, 58, 4)],
    "partial": [rush(1, 75, 2, 2)],
    "kicked": [rush(1, 60, 0, text="kickoff", type="kickoff", start_team="B"), rush(2, 40, 40, text="K punt 40 yards", type="punt", start_team="B", end_team="A"), rush(3, 75, 2), rush(4, 73, 40, text="K punt 40 yards", type="punt", end_team="B", start_down=4)],
    "marked": [rush(1, 75, 2), rush(2, 75, 0, text="Timeout AAA", type="timeout"), rush(3, 73, 4, 2), rush(4, 1, 0, text="End of half", type="end of half")],
    "lost": [rush(1, 75, 2), rush(2, 73, 0, text="#1 Q.Back pass intercepted by X", type="pass interception", end_team="B")],
    "refused": [rush(1, 75, 2), rush(2, 73, 0, text="PENALTY BBB holding declined", type="rush", is_penalty=False), rush(3, 73, 4, 2)],
    "scored": [rush(1, 75, 2), rush(2, 73, 73, 2, end_ytg=0, end_spot="BBB 0", scoring_play=True, text="#2 R.Back rush middle for 73 yards TOUCHDOWN")],
}
WANT = {  # plays, verified, net, by plays, by penalties, ending
    "whole": (3, True, 16, 11, 5, None), "broken": (2, False, None, None, None, None), "unknown": (2, False, None, None, None, None), "partial": (1, False, None, None, None, None),
    "kicked": (1, True, 2, 2, 0, "punt"), "marked": (2, True, 6, 6, 0, "period"), "lost": (2, False, None, None, None, "turnover"), "refused": (2, True, 6, 6, 0, None),
    "scored": (2, True, 75, 75, 0, "touchdown"),
}


@pytest.fixture(scope="module")
def drives(spark):
    rows = [(name, k, *r) for name, rs in DRIVES.items() for k, r in enumerate(rs)]
    df = spark.createDataFrame(rows, f"drive_id string, position long, {FIELDS}").withColumn("block", R.F.expr("position div 2"))
    df = R.with_movement(R.with_players(R.describe(df)))
    return R.computed(df, {"action": R.action_code()})


def test_drive_summaries(drives):
    got = {r["drive_id"]: (r["plays"], r["verified"], r["net_yards"], r["play_yards"], r["penalty_yards"], r["ending"]) for r in G.drive_summary(drives).collect()}
    assert got == WANT


def test_segments_of_drives(drives):
    rows = G.drive_progress(drives).collect()
    of = lambda d: sorted((r["position"], r["from_yard"], r["to_yard"], r["kind"]) for r in rows if r["drive_id"] == d)
    assert of("whole") == [(0, 25, 27, "play"), (1, 27, 32, "penalty"), (2, 32, 36, "play"), (3, 36, 41, "play")]
    assert len(of("broken")) == 2 and of("lost") == [(0, 25, 27, "play")]


def test_review_moments_name_no_play_twice(spark):
    rows = [("g", "a", 1, 30, 10, 1, 10, 20), ("g", "b", 2, 9, 12, 3, 8, 1), ("g", "c", 3, 3, 8, 3, None, None), ("g", "d", 4, 40, 10, 1, None, None),
            ("h", "e", 1, -7, 10, 1, None, None), ("h", "f", 2, 5, 10, 2, 5, 0), ("h", "k", 3, None, 10, 1, None, None), ("i", "x", 1, None, None, 1, None, None)]
    df = spark.createDataFrame(rows, "game_id string, play_id string, position long, gained int, need int, start_down int, air int, after int")
    got = {(r["game_id"], r["slot"], r["play_id"]) for r in G.review_moments(df).collect()}
    assert got == {("g", "after", "a"), ("g", "air", "b"), ("g", "short", "c"), ("h", "air", "f"), ("h", "fill1", "k"), ("h", "fill2", "e")}
