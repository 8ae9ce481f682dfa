"""Queries for the report parser and the game summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports as R
from ..operators import games as G
from ..operators import joins as J
from . import views as V
from .oracle import on_plays
from .registry import query

POSITION = "bigint(datediff(shipped, date '1990-01-01')) * 100000000000 + ok * 10 + int(split(play_id, '-')[1])"


def rows(spark, sf):
    """Plays as flat reports, with planted touchdowns, penalties, sacks, fumbles and mirrored spots."""
    named = "regexp_replace(regexp_replace(play_text, 'R\\\\.Back[0-9]', concat('R.Back', substring('abcde', int(1 + sk % 5), 1))), 'W\\\\.Out[0-9]', concat('W.Out', substring('abcdefg', int(1 + sk % 7), 1)))"
    df = V.plays(spark, sf).withColumn("play_text", F.expr(named)).selectExpr("*", f"{POSITION} as position", "day as block", "upper(substr(offense, 1, 3)) as own_abbr", "'ZZZ' as other_abbr",
                                       "greatest(yards_to_goal - yards_gained, 0) as true_end")
    spot = lambda y: f"if({y} > 50, concat(upper(substr(offense, 1, 3)), ' ', string(100 - {y})), concat('ZZZ ', string({y})))"
    return df.selectExpr(
        "league", "season", "week", "game_id", "play_id", "offense", "defense", "period", "clock_seconds", "position", "block", "own_abbr", "other_abbr", "pk", "sk", "category", "yards_gained",
        """case pk % 40 when 0 then concat(play_text, ' TOUCHDOWN (K.Foot kick attempt good)') when 1 then concat(play_text, ' PENALTY BBB holding declined')
            when 2 then concat(play_text, ' PENALTY BBB Pass Interference (#4) 15 yards') when 3 then '#1 Q.Back sacked at AAA20 for loss of 5 yards' when 4 then concat(play_text, ' fumbled')
            when 5 then '#1 Q.Back pass intercepted by X' when 6 then concat(play_text, ' QB hurried by #55 D.End') else play_text end as text""",
        "case when pk % 59 = 0 then 'timeout' when category = 'penalty' then 'penalty' when category = 'special' then 'punt' when category = 'rush' then 'rush' when yards_gained > 0 then 'pass reception' else 'pass incompletion' end as type",
        "category = 'penalty' as is_penalty", "false as is_turnover", "pk % 40 = 0 as scoring_play", "'' as scoring", "0 as score_value", "yards_gained + if(pk % 43 = 0, 1, 0) as stat_yards",
        "offense as start_team", "if(pk % 25 = 0, defense, offense) as end_team", "down as start_down", "distance as start_distance", "yards_to_goal as start_ytg", f"{spot('yards_to_goal')} as start_spot",
        "if(yards_gained >= distance, 1, down + 1) as end_down", "if(yards_gained >= distance, 10, distance - yards_gained) as end_distance",
        "if(pk % 47 = 0, 100 - true_end, true_end) as end_ytg", f"{spot('true_end')} as end_spot",
        "if(pk % 40 = 0 and pk % 80 = 0, null, off_score_post) as home_score", "if(pk % 40 = 0 and pk % 80 = 0, null, def_score_post) as away_score",
        "concat(lpad(string(clock_seconds div 60), 2, '0'), ':', lpad(string(clock_seconds % 60), 2, '0')) as clock")


def described(spark, sf):
    df = R.asked(R.with_players(R.describe(rows(spark, sf))), {"facts": R.reported_facts()})
    return R.computed(df, {"action": R.action_code()})


REP = """r AS (SELECT *, date_diff('day', DATE '1990-01-01', CAST(shipped AS DATE)) * 100000000000 + ok * 10 + CAST(split_part(play_id, '-', 2) AS INT) AS position, upper(substr(offense, 1, 3)) AS own, greatest(yards_to_goal - yards_gained, 0) AS true_end,
  pk % 40 AS v, CASE WHEN pk % 59 = 0 THEN 'timeout' WHEN category = 'penalty' THEN 'penalty' WHEN category = 'special' THEN 'punt' WHEN category = 'rush' THEN 'rush' WHEN yards_gained > 0 THEN 'pass reception' ELSE 'pass incompletion' END AS type,
  CASE pk % 40 WHEN 0 THEN play_text || ' TOUCHDOWN (K.Foot kick attempt good)' WHEN 1 THEN play_text || ' PENALTY BBB holding declined' WHEN 2 THEN play_text || ' PENALTY BBB Pass Interference (#4) 15 yards' WHEN 3 THEN '#1 Q.Back sacked at AAA20 for loss of 5 yards'
   WHEN 4 THEN play_text || ' fumbled' WHEN 5 THEN '#1 Q.Back pass intercepted by X' WHEN 6 THEN play_text || ' QB hurried by #55 D.End' ELSE play_text END AS text FROM (SELECT * REPLACE (replace(replace(play_text, 'R.Back' || (sk % 5), 'R.Back' || substr('abcde', CAST(1 + sk % 5 AS INT), 1)), 'W.Out' || (sk % 7), 'W.Out' || substr('abcdefg', CAST(1 + sk % 7 AS INT), 1)) AS play_text) FROM plays))"""


@query("rpt01_primary_text", on_plays(REP, "SELECT play_id, CASE WHEN v = 0 THEN play_text || ' TOUCHDOWN (K.Foot ' ELSE text END AS txt FROM r"))
def primary_text(spark, sf):
    return rows(spark, sf).selectExpr("play_id", f"{R.primary_text()} as txt")


@query("rpt02_marker", on_plays(REP, "SELECT type = 'timeout' AS marker, COUNT(*) AS n FROM r GROUP BY 1"))
def marker(spark, sf):
    return rows(spark, sf).groupBy(F.expr(f"{R.is_marker()} as marker")).agg(F.count("*").alias("n"))


@query("rpt03_scrimmage", on_plays(REP, "SELECT play_id, category IN ('rush', 'pass') AND type <> 'timeout' AND (v IN (3, 5) OR (v NOT IN (1, 2) AND NOT contains(text, 'takes a knee'))) AS scrimmage FROM r"))
def scrimmage(spark, sf):
    return rows(spark, sf).selectExpr("play_id", f"{R.is_scrimmage()} as scrimmage")


@query("rpt04_penalties", on_plays(REP, """SELECT play_id, (category = 'penalty' AND v NOT IN (3, 5)) OR v = 2 AS accepted, category = 'penalty' AND v NOT IN (3, 5) AS wiped,
 v = 1 AND category <> 'penalty' AND NOT contains(text, 'takes a knee') AS declined_played FROM r"""))
def penalties(spark, sf):
    df = rows(spark, sf).withColumn("primary", F.expr(R.primary_text()))
    return df.selectExpr("play_id", *[f"{v} as {k}" for k, v in R.penalty_columns().items() if k != "penalties"])


@query("rpt05_accepted_penalty", on_plays(REP, "SELECT play_id, CASE WHEN v = 2 AND category <> 'penalty' THEN 'Pass Interference' WHEN category = 'penalty' AND v NOT IN (1, 2, 3, 5) THEN 'Holding' ELSE '' END AS ruling FROM r"))
def accepted(spark, sf):
    return rows(spark, sf).selectExpr("play_id", f"{R.accepted_penalty()} as ruling")


@query("rpt06_named_hurry", on_plays(REP, "SELECT play_id, CASE WHEN v = 6 THEN '#55 D.End' ELSE '' END AS hurry FROM r"))
def hurry(spark, sf):
    return rows(spark, sf).selectExpr("play_id", f"{R.named_hurry()} as hurry")


@query("rpt07_facts", on_plays(REP, """SELECT play_id, CASE WHEN v IN (3, 5) OR category IN ('penalty', 'special') OR contains(text, 'takes a knee') THEN '' WHEN category = 'rush' THEN 'Run through the middle'
 WHEN yards_gained > 0 THEN 'Shotgun;Short pass to the left' ELSE 'Deep pass to the right' END AS facts FROM r"""))
def facts(spark, sf):
    df = rows(spark, sf).withColumn("primary", F.expr(R.primary_text()))
    return df.selectExpr("play_id", f"array_join({R.reported_facts()}, ';') as facts")


@query("rpt08_players", on_plays(REP, """SELECT play_id, CASE WHEN v IN (3, 5) THEN '#1 Q.Back' WHEN category = 'pass' THEN '#1 Q.Back' WHEN category = 'rush' AND NOT contains(text, 'takes a knee') THEN '#' || (20 + sk % 5) || ' R.Back' || substr('abcde', CAST(1 + sk % 5 AS INT), 1) END AS actor,
 CASE WHEN category = 'pass' AND v NOT IN (3, 5) THEN '#' || (80 + sk % 7) || ' W.Out' || substr('abcdefg', CAST(1 + sk % 7 AS INT), 1) END AS receiver FROM r"""))
def players(spark, sf):
    return R.with_players(R.computed(rows(spark, sf), {"primary": R.primary_text()})).select("play_id", "actor", "receiver")


@query("rpt09_yards_to_goal", on_plays(REP, "SELECT play_id, CASE WHEN true_end BETWEEN 1 AND 99 THEN CAST(true_end AS INT) END AS ytg FROM r"))
def yards_to_goal(spark, sf):
    return R.with_spots(rows(spark, sf)).selectExpr("play_id", "end_yards_to_goal as ytg")


END_D = "CASE WHEN yards_gained >= distance THEN 10 ELSE distance - yards_gained END"


@query("rpt10_fix_situation", on_plays(REP, f"""SELECT play_id, CASE WHEN true_end NOT BETWEEN 1 AND 99 THEN NULL WHEN pk % 25 = 0 AND offense <> defense THEN 1 WHEN yards_gained >= distance THEN 1 ELSE down + 1 END AS next_down,
 CASE WHEN true_end NOT BETWEEN 1 AND 99 THEN NULL WHEN pk % 25 = 0 AND offense <> defense THEN least(10, true_end) ELSE least({END_D}, true_end) END AS next_distance FROM r"""))
def fix_situation(spark, sf):
    return R.with_spots(rows(spark, sf)).selectExpr("play_id", *[f"{v} as {k}" for k, v in R.fix_situation().items()])


NEXT = "CASE WHEN yards_gained >= distance THEN 1 ELSE down + 1 END"


@query("rpt11_end_situation", on_plays(REP, f"""SELECT play_id, CASE WHEN true_end BETWEEN 1 AND 99 AND {NEXT} <= 4 AND {END_D} BETWEEN 1 AND true_end THEN
  (['1st', '2nd', '3rd', '4th'])[{NEXT}] || ' & ' || CASE WHEN {END_D} = true_end THEN 'goal' ELSE CAST({END_D} AS VARCHAR) END || ' at ' || CASE WHEN true_end > 50 THEN own || ' ' || (100 - true_end) ELSE 'ZZZ ' || true_end END ELSE '' END AS situation FROM r"""))
def end_situation(spark, sf):
    return R.with_spots(rows(spark, sf)).selectExpr("play_id", f"{R.end_situation()} as situation")


@query("rpt11_known_ends", on_plays(REP, f"SELECT down AS start_down, COUNT(*) AS n FROM r WHERE true_end BETWEEN 1 AND 99 GROUP BY 1"))
def known_ends(spark, sf):
    df = R.with_spots(rows(spark, sf)).filter("end_yards_to_goal is not null")
    return df.groupBy("start_down").agg(F.count("*").alias("n"))


READ = "CASE WHEN v = 3 THEN -5 WHEN v = 5 THEN NULL WHEN category = 'rush' AND NOT contains(text, 'takes a knee') THEN yards_gained WHEN category = 'pass' AND yards_gained > 0 THEN yards_gained END"


@query("rpt12_reported_yards", on_plays(REP, f"SELECT play_id, CAST({READ} AS INT) AS yards FROM r"))
def reported_yards(spark, sf):
    df = rows(spark, sf).withColumn("primary", F.expr(R.primary_text()))
    return df.selectExpr("play_id", f"{R.reported_yards()} as yards")


SETTLE = f"""y AS (SELECT *, {READ} AS rd, yards_gained + CASE WHEN pk % 43 = 0 THEN 1 ELSE 0 END AS st, CASE WHEN (pk % 25 <> 0 OR offense = defense) AND true_end BETWEEN 1 AND 99 THEN yards_to_goal - true_end WHEN (pk % 25 <> 0 OR offense = defense) AND CASE WHEN pk % 47 = 0 THEN 100 - true_end ELSE true_end END = 0 AND v = 0 THEN yards_to_goal END AS mv FROM r),
s AS (SELECT *, CASE WHEN rd = mv OR rd = st THEN rd WHEN rd IS NOT NULL AND st IS NULL AND mv IS NULL THEN rd WHEN rd IS NULL AND st IS NOT NULL AND (mv IS NULL OR mv = st) THEN st END AS val,
  CASE WHEN rd = mv THEN false WHEN rd = st THEN COALESCE(mv <> rd, false) WHEN rd IS NULL AND (mv IS NULL OR mv = st) THEN false ELSE true END AS conflict FROM y)"""


@query("rpt13_settled_yards", on_plays(REP, SETTLE, "SELECT play_id, CAST(val AS INT) AS yards, conflict FROM s"))
def settled(spark, sf):
    df = R.computed(R.with_spots(R.computed(rows(spark, sf), {"primary": R.primary_text()})), {"read_yards": R.reported_yards()})
    moved = "if(start_team = end_team, start_yards_to_goal - coalesce(end_yards_to_goal, if(end_ytg = 0 and scoring_play, 0, null)), null)"
    df = R.computed(R.computed(df, {"moved": moved}), {"s": R.settle_yards()})
    return df.selectExpr("play_id", "s.value as yards", "s.conflict as conflict")


@query("rpt14_kick_result", on_plays("SELECT play_id, CASE WHEN pk % 3 = 0 THEN false WHEN pk % 3 = 1 THEN true END AS good FROM plays WHERE is_special"))
def kick_result(spark, sf):
    df = V.plays(spark, sf).filter("is_special").selectExpr("play_id", "case pk % 3 when 0 then 'field goal no good' when 1 then 'field goal good' else 'field goal' end as type", "'' as scoring", "play_text as primary")
    return df.selectExpr("play_id", f"{R.kick_good()} as good")


@query("rpt15_conversion", on_plays("SELECT play_id, CASE pk % 5 WHEN 0 THEN 'two_good' WHEN 1 THEN 'one_good' WHEN 2 THEN 'two_failed' WHEN 3 THEN 'one_failed' END AS result FROM plays"))
def conversion(spark, sf):
    df = V.plays(spark, sf).selectExpr("play_id", "case pk % 5 when 0 then 2 when 1 then 1 when 4 then null else 0 end as attempt_value", "if(pk % 5 = 2, 'Two-Point pass', 'Extra Point kick') as attempt_text")
    return df.selectExpr("play_id", f"{R.conversion_result()} as result")


SKIP = "(type = 'timeout' OR (category = 'penalty') OR v = 2 OR (contains(text, 'takes a knee') AND v NOT IN (3, 5)))"


@query("rpt16_describe", on_plays(REP, f"""SELECT play_id, CASE WHEN {SKIP} THEN 'other' WHEN category = 'special' THEN 'kick' WHEN v = 3 THEN 'other' WHEN v = 5 OR category = 'pass' THEN 'pass' ELSE 'run' END AS outcome,
 type <> 'timeout' AND category <> 'penalty' AND v NOT IN (2, 3, 5) AND contains(text, 'takes a knee') AS clock_play FROM r"""))
def describe(spark, sf):
    return R.describe(rows(spark, sf)).select("play_id", "outcome", "clock_play")


@query("rpt17_fourth_down", on_plays(REP, f"SELECT play_id FROM r WHERE down = 4 AND pk % 25 = 0 AND offense <> defense AND NOT {SKIP} AND category <> 'special' AND v NOT IN (0, 4, 5)"))
def fourth_down(spark, sf):
    return R.describe(rows(spark, sf)).filter("fourth_down_failure").select("play_id")


CHANGED = "(pk % 25 = 0 AND offense <> defense)"
ENDING = f"""CASE WHEN NOT {SKIP} AND (v = 5 OR (v = 4 AND {CHANGED})) THEN 'turnover' WHEN NOT {SKIP} AND down = 4 AND category <> 'special' AND v NOT IN (0, 4, 5) AND {CHANGED} THEN 'downs'
 WHEN NOT {SKIP} AND v = 0 THEN 'touchdown' WHEN type = 'punt' AND v <> 2 AND {CHANGED} THEN 'punt' ELSE '' END"""
#: Net yards of a report and what the play and a ruling did, by the planted class of the text.
MOVED = f"""nt AS (SELECT *, CASE WHEN NOT {CHANGED} AND true_end BETWEEN 1 AND 99 THEN yards_to_goal - true_end WHEN NOT {CHANGED} AND true_end = 0 AND pk % 47 <> 0 AND v = 0 AND NOT {SKIP} THEN yards_to_goal END AS net FROM s),
mo AS (SELECT *, CASE WHEN category = 'penalty' AND v NOT IN (2, 3, 5) AND abs(net) = 10 THEN 'ruling' WHEN NOT {SKIP} AND category <> 'special' AND v NOT IN (4, 5) AND NOT conflict AND val = net THEN 'play' END AS how FROM nt)"""


@query("rpt18_movement", on_plays(REP, SETTLE, MOVED, """SELECT play_id, CASE WHEN how IS NOT NULL THEN net END AS net, CASE how WHEN 'play' THEN net WHEN 'ruling' THEN 0 END AS play_part,
 CASE how WHEN 'play' THEN 0 WHEN 'ruling' THEN net END AS penalty_part FROM mo"""))
def movement(spark, sf):
    """All plays; net, play and penalty yards are null where nothing can be claimed."""
    return R.with_movement(R.describe(rows(spark, sf))).selectExpr("play_id", "movement.net as net", "movement.play as play_part", "movement.penalty as penalty_part")


@query("rpt19_catch_split", on_plays("SELECT play_id, CASE WHEN pk % 3 <> 0 THEN yards_gained - 2 END AS air, CASE WHEN pk % 3 <> 0 THEN 2 END AS after FROM plays WHERE is_pass AND yards_gained > 2"))
def catch_split(spark, sf):
    df = V.plays(spark, sf).filter("is_pass and yards_gained > 2").selectExpr("play_id", "yards_gained as g", "yards_gained - 2 as air", "if(pk % 3 = 0, 3, 2) as after")
    ok = "air + after = g"
    return df.selectExpr("play_id", f"if({ok}, air, null) as air", f"if({ok}, after, null) as after")


@query("rpt20_takeaway")
def takeaway(spark, sf):
    df = R.computed(R.describe(rows(spark, sf)), {"ruling": R.accepted_penalty(), "hurry": R.named_hurry("primary")})
    return df.selectExpr("play_id", "coalesce(if(ruling <> '', format_string('%s changed the play.', ruling), null), if(hurry <> '', format_string('%s hurried the passer.', hurry), null), "
                         "if(need >= 8 and gained >= need, format_string('Gained %d on a long need of %d.', gained, need), null)) as takeaway").filter("takeaway is not null")


@query("rpt21_verified_detail", on_plays(REP, "SELECT play_id, CASE WHEN pk % 6 <> 0 THEN yards_gained - 1 END AS air FROM r WHERE category = 'pass' AND yards_gained > 0 AND v >= 7 AND pk % 59 <> 0 AND pk % 43 <> 0 AND pk % 25 <> 0 AND true_end > 0"))
def verified(spark, sf):
    df = R.describe(rows(spark, sf)).filter("category = 'pass' and yards_gained > 0 and pk % 40 >= 7 and pk % 59 <> 0 and pk % 43 <> 0 and pk % 25 <> 0 and start_ytg > yards_gained")
    side = df.selectExpr("play_id as pid", "yards_gained as total", "yards_gained - 1 as air", "if(pk % 6 = 0, 2, 1) as after")
    ok = "outcome = 'pass' and void_reason is null and not turnover and air + after = total and gained = total"
    return df.join(side, df.play_id == side.pid).selectExpr("play_id", f"if({ok}, air, null) as air")


#: A sack is told by the words, so one in a punt's row is a sack too.
ACTION_RPT22 = f"CASE WHEN {SKIP} THEN 'none' WHEN v = 3 THEN 'sack' WHEN category = 'special' THEN 'none' WHEN v = 5 OR category = 'pass' THEN 'pass' ELSE 'run' END"


@query("rpt22_action", on_plays(REP, f"SELECT play_id, {ACTION_RPT22} AS action FROM r"))
def action(spark, sf):
    return R.describe(rows(spark, sf)).selectExpr("play_id", f"{R.action_code()} as action")


@query("rpt25_fingerprint")
def fingerprint(spark, sf):
    return rows(spark, sf).selectExpr("play_id", f"{R.fingerprint(['text', 'type', 'stat_yards', 'start_down', 'start_distance', 'end_spot', 'clock', 'period'])} as fingerprint")


@query("rpt26_clock_key", on_plays("SELECT play_id, period || ':' || lpad(CAST(clock_seconds // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(clock_seconds % 60 AS VARCHAR), 2, '0') AS clock_key FROM plays"))
def clock_key(spark, sf):
    return rows(spark, sf).selectExpr("play_id", f"{R.clock_key()} as clock_key")


@query("rpt27_grade")
def grade(spark, sf):
    df = R.describe(rows(spark, sf)).withColumns({"question": F.expr("if(pk % 2 = 0, 'call', 'gain')"), "answer": F.expr("if(pk % 2 = 0, if(pk % 3 = 0, 'run', 'pass'), if(pk % 3 = 0, 'yes', 'no'))")})
    return R.computed(df, {"g": R.grade()}).groupBy("question", "g.void").agg(F.count("*").alias("picks"), F.expr("count_if(g.ok)").alias("right"))


@query("rpt32_board", on_plays("SELECT play_id, CASE WHEN pk % 7 = 0 THEN NULL ELSE CAST(pk % 41 AS INT) END AS score, CASE WHEN period = 4 AND pk % 3 = 0 THEN 'OT' ELSE 'Q' || period END AS label FROM plays"))
def board(spark, sf):
    df = V.plays(spark, sf).selectExpr("play_id", "if(pk % 7 = 0, 'n/a', string(pk % 41)) as raw", "if(period = 4 and pk % 3 = 0, 5, period) as q")
    return df.selectExpr("play_id", "if(try_cast(raw as int) >= 0, try_cast(raw as int), null) as score", "if(q > 4, 'OT', concat('Q', string(q))) as label")


TERMS = {"take a knee": "kneel", "takes a knee": "kneel", "pass complete": "completion", "pass incomplete": "incompletion", "pass": "pass", "rush": "rush", "punt": "punt", "shotgun": "shotgun", "holding": "penalty"}


@query("rpt33_terms", on_plays("""SELECT term, COUNT(*) AS uses FROM (SELECT unnest(CASE category WHEN 'penalty' THEN ['penalty'] WHEN 'special' THEN ['punt'] WHEN 'rush' THEN [CASE WHEN qty = 50 THEN 'kneel' ELSE 'rush' END]
 ELSE CASE WHEN yards_gained > 0 THEN ['shotgun', 'completion'] ELSE ['incompletion'] END END) AS term FROM plays) GROUP BY 1"""))
def terms(spark, sf):
    return R.term_counts(V.plays(spark, sf).select("play_text"), TERMS, "play_text")


# --- game summaries ---------------------------------------------------------------------


@query("agg35_team_insights")
def insights(spark, sf):
    return G.team_insights(described(spark, sf))


#: Carries and targets by the planted names; yards as the reports settle them.
USES = f"""ac AS (SELECT *, NOT {SKIP} AND category <> 'special' AND v NOT IN (3, 5) AND NOT (v = 4 AND {CHANGED}) AND NOT (down = 4 AND {CHANGED} AND v NOT IN (0, 4)) AND NOT (conflict AND v <> 4) AS counts, {ACTION_RPT22} AS action FROM s),
us AS (SELECT game_id, offense, play_id, 'carrier' AS role, '#' || (20 + sk % 5) || ' R.Back' || substr('abcde', CAST(1 + sk % 5 AS INT), 1) AS name, CASE WHEN counts AND v <> 4 THEN val END AS gained, true AS done FROM ac WHERE action = 'run'
 UNION ALL SELECT game_id, offense, play_id, 'target', '#' || (80 + sk % 7) || ' W.Out' || substr('abcdefg', CAST(1 + sk % 7 AS INT), 1), CASE WHEN counts AND v <> 4 THEN val END, coalesce(CASE WHEN counts AND v <> 4 THEN val END > 0, false) FROM ac WHERE action = 'pass' AND category = 'pass' AND v <> 5),
ug AS (SELECT game_id, offense, role, name, COUNT(*) AS uses, COUNT(*) FILTER (done) AS completed, CAST(CASE WHEN COUNT(*) = COUNT(gained) THEN SUM(gained) END AS BIGINT) AS yards, MIN(play_id) AS first_play, MAX(play_id) AS last_play FROM us GROUP BY ALL)"""


@query("agg36_named_usage", on_plays(REP, SETTLE, USES, "SELECT * FROM ug"))
def usage(spark, sf):
    return G.named_usage(described(spark, sf))


@query("agg36_named_plays", on_plays(REP, SETTLE, USES, "SELECT game_id, offense, role, name, play_id FROM us"))
def usage_plays(spark, sf):
    """Every play id behind the counts, as rows."""
    return G.named_plays(described(spark, sf)).select("game_id", "offense", "role", "name", "play_id")


@query("agg38_leaders", on_plays(REP, SETTLE, USES, """tt AS (SELECT game_id, offense, role, SUM(uses) AS total, MAX(uses) AS top FROM ug GROUP BY ALL),
ti AS (SELECT ug.game_id, ug.offense, ug.role, COUNT(*) AS n, MIN(name) AS name, MAX(uses) AS uses, MAX(total) AS total FROM ug JOIN tt ON tt.game_id = ug.game_id AND tt.offense = ug.offense AND tt.role = ug.role AND uses = top GROUP BY ALL)""", """
SELECT game_id, offense, role, name, uses, CAST(total AS BIGINT) AS total FROM ti WHERE n = 1 AND uses >= 3 AND uses >= 0.4 * total"""))
def leaders(spark, sf):
    return G.leaders(G.named_usage(described(spark, sf)))


@query("agg39_observations")
def observations(spark, sf):
    df = G.kept_snaps(described(spark, sf))
    return G.observations(G.team_insights(df), G.leaders(G.named_usage(df)))


def drive_reports(spark, sf):
    """Described reports in drives of five days of a game, with planted kickoffs and conversions; blocks are finer than drives."""
    df = R.with_movement(described(spark, sf))
    return df.withColumns({"drive_id": F.expr("concat(game_id, '/', string(position div 500000000000))"), "block": F.expr("position div 1000000"),
                           "kickoff": F.expr("pk % 61 = 0"), "conversion": F.expr("pk % 67 = 0")})


DRIVES = f"""dr AS (SELECT *, game_id || '/' || CAST(position // 500000000000 AS VARCHAR) AS drive_id, {ACTION_RPT22} AS action, {ENDING} AS ending, category = 'special' AND NOT {SKIP} AS kick,
 type <> 'timeout' AND category <> 'penalty' AND v NOT IN (2, 3, 5) AND contains(text, 'takes a knee') AS clock_play FROM mo WHERE pk % 61 <> 0 AND pk % 67 <> 0),
dm AS (SELECT *, type <> 'timeout' AND NOT kick AS counted, how IS NOT NULL AND type <> 'timeout' AND NOT kick AS moved FROM dr),
pe AS (SELECT *, LAST_VALUE(CASE WHEN moved THEN yards_to_goal - net END IGNORE NULLS) OVER (PARTITION BY drive_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM dm),
ds AS (SELECT drive_id, COUNT(*) FILTER (counted) AS reports, COUNT(*) FILTER (counted AND (action <> 'none' OR clock_play)) AS plays, COUNT(*) FILTER (counted AND action = 'sack') AS sacks,
 COUNT(*) FILTER (counted AND action = 'run') AS runs, COUNT(*) FILTER (counted AND action = 'pass') AS passes, COUNT(*) FILTER (moved) AS movements, COUNT(*) FILTER (counted AND NOT moved) AS unverified,
 NOT coalesce(bool_or(prev_end IS NOT NULL AND (moved OR kick) AND prev_end <> yards_to_goal), false) AS continuous, coalesce(arg_min(down, position) FILTER (counted) = 1, false) AS first_down,
 CAST(SUM(CASE WHEN how = 'play' AND moved THEN net ELSE 0 END) AS BIGINT) AS py, CAST(SUM(CASE WHEN how = 'ruling' AND moved THEN net ELSE 0 END) AS BIGINT) AS ry,
 arg_max(ending, position) FILTER (ending <> '') AS ending, COUNT(*) FILTER (type <> 'timeout') AS leads FROM pe GROUP BY 1),
dv AS (SELECT *, movements > 0 AND unverified = 0 AND continuous AND first_down AS verified FROM ds WHERE leads > 0)"""


@query("win08_drive_continuity", on_plays(REP, SETTLE, MOVED, DRIVES, "SELECT drive_id, reports, movements, unverified, continuous, first_down FROM dv"))
def drives(spark, sf):
    return G.drive_summary(drive_reports(spark, sf)).select("drive_id", "reports", "movements", "unverified", "continuous", "first_down")


@query("agg37_drive_summary", on_plays(REP, SETTLE, MOVED, DRIVES, """SELECT drive_id, plays, runs, passes, sacks, verified, CASE WHEN verified THEN py + ry END AS net_yards, CASE WHEN verified THEN py END AS play_yards,
 CASE WHEN verified THEN ry END AS penalty_yards, ending FROM dv"""))
def drive_summary(spark, sf):
    return G.drive_summary(drive_reports(spark, sf)).select("drive_id", "plays", "runs", "passes", "sacks", "verified", "net_yards", "play_yards", "penalty_yards", "ending")


@query("agg37_drive_progress", on_plays(REP, SETTLE, MOVED, DRIVES, """SELECT drive_id, play_id, CASE how WHEN 'play' THEN 'play' ELSE 'penalty' END AS kind, CAST(100 - yards_to_goal AS BIGINT) AS from_yard,
 CAST(100 - yards_to_goal + net AS BIGINT) AS to_yard FROM pe WHERE moved"""))
def drive_progress(spark, sf):
    return G.drive_progress(drive_reports(spark, sf)).selectExpr("drive_id", "play_id", "kind", "bigint(from_yard) as from_yard", "bigint(to_yard) as to_yard")


@query("agg60_review_moments", on_plays(REP, SETTLE, f"""ac AS (SELECT *, NOT {SKIP} AND category <> 'special' AND v NOT IN (3, 5) AND NOT (v = 4 AND {CHANGED}) AND NOT (down = 4 AND {CHANGED} AND v NOT IN (0, 4)) AND NOT (conflict AND v <> 4) AS counts FROM s),
c1 AS (SELECT game_id, play_id, position, pk, category, down, distance, CASE WHEN v <> 4 THEN val END AS gained FROM ac WHERE counts),
c2 AS (SELECT *, CASE WHEN category = 'pass' AND gained > 0 AND pk % 6 <> 0 THEN pk % (gained + 1) END AS aft, gained - CASE WHEN category = 'pass' AND gained > 0 AND pk % 6 <> 0 THEN pk % (gained + 1) END AS air FROM c1),
s1 AS (SELECT game_id, 'after' AS slot, arg_min(play_id, (-aft, position)) AS play_id FROM c2 WHERE aft > air GROUP BY 1),
s2 AS (SELECT game_id, 'air' AS slot, arg_min(play_id, (-air, position)) AS play_id FROM c2 WHERE air > aft GROUP BY 1),
s3 AS (SELECT game_id, 'short' AS slot, arg_min(play_id, position) AS play_id FROM c2 WHERE down >= 3 AND gained >= 0 AND gained < distance AND play_id NOT IN (SELECT play_id FROM s1 UNION ALL SELECT play_id FROM s2) GROUP BY 1),
own AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), have AS (SELECT game_id, COUNT(*) AS n FROM own GROUP BY 1),
rest AS (SELECT game_id, play_id, row_number() OVER (PARTITION BY game_id ORDER BY coalesce(gained, 0) DESC, position) AS k FROM c2 WHERE play_id NOT IN (SELECT play_id FROM own))""", """
SELECT game_id, slot, play_id FROM own UNION ALL SELECT r.game_id, 'fill' || k, play_id FROM rest r LEFT JOIN have h ON h.game_id = r.game_id WHERE k <= 3 - coalesce(n, 0)"""))
def review(spark, sf):
    """Three plays of every game; the catch is split by planted figures that agree on five of six passes."""
    caught = "action = 'pass' and gained > 0 and pk % 6 <> 0"
    df = described(spark, sf).withColumn("after", F.expr(f"if({caught}, pk % (gained + 1), null)")).withColumn("air", F.expr("gained - after"))
    return G.review_moments(df)


@query("win05_last_revision", """WITH e AS (SELECT user_id AS game_id, json_extract_string(props, '$.k') AS play_id, event_id, event_type FROM events)
SELECT game_id, play_id, MIN(event_id) AS first_position, COUNT(*) AS revisions, arg_max(event_type, event_id) AS event_type FROM e GROUP BY 1, 2""")
def last_revision(spark, sf):
    e = V.events(spark, sf).selectExpr("game as game_id", "play as play_id", "event_id as position", "event_type")
    return G.last_revisions(e)


EV = "e AS (SELECT *, user_id AS game, json_extract_string(props, '$.k') AS play FROM events)"


def ordered_events(spark, sf):
    return V.events(spark, sf).selectExpr("game as game_id", "event_id as position", "event_id div 500 as block", "event_type", "value", "play")


@query("win09_streaks", f"""WITH {EV}, c AS (SELECT *, CASE WHEN event_type = LAG(event_type) OVER (PARTITION BY game ORDER BY event_id) THEN 0 ELSE 1 END AS nw FROM e), i AS (SELECT *, SUM(nw) OVER (PARTITION BY game ORDER BY event_id) AS isl FROM c),
l AS (SELECT game, isl, COUNT(*) AS n FROM i GROUP BY 1, 2) SELECT game AS game_id, MAX(n) AS longest, COUNT(*) AS runs FROM l GROUP BY 1""")
def streaks(spark, sf):
    return G.streaks(ordered_events(spark, sf), "event_type")


@query("win10_repeated_clocks", f"""WITH {EV}, k AS (SELECT *, CAST(FLOOR(value / 25) AS INT) AS ck FROM e), c AS (SELECT *, CASE WHEN ck = LAG(ck) OVER (PARTITION BY game ORDER BY event_id) THEN 0 ELSE 1 END AS nw FROM k),
i AS (SELECT *, SUM(nw) OVER (PARTITION BY game ORDER BY event_id) AS isl FROM c) SELECT game AS game_id, ck AS clock_key, COUNT(*) AS reports, MIN(event_id) AS first_position FROM i GROUP BY game, isl, ck HAVING COUNT(*) >= 3""")
def repeated(spark, sf):
    return G.repeated_clocks(ordered_events(spark, sf).withColumn("clock_key", F.expr("int(floor(value / 25))")))


@query("win11_known_score", f"""WITH {EV}, m AS (SELECT *, CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 1 WHEN event_type IN ('purchase', 'view') THEN 2 END AS st, CAST(FLOOR(value) AS INT) AS h FROM e),
w AS (SELECT *, LAST_VALUE(CASE WHEN st IS NOT NULL THEN event_id END IGNORE NULLS) OVER (PARTITION BY game ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ref FROM m)
SELECT w.event_id AS position, CASE WHEN b.st = 2 THEN b.h END AS known_home FROM w LEFT JOIN m b ON b.event_id = w.ref""")
def known_score(spark, sf):
    df = ordered_events(spark, sf).selectExpr("*", "event_type = 'purchase' as scoring_play", "if(event_type = 'view' or (event_type = 'purchase' and position % 4 <> 0), int(floor(value)), null) as home_score").withColumn("away_score", F.col("home_score"))
    return G.known_score(df).select("position", "known_home")


@query("win12_since_involved", f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY event_id) AS k, COUNT(*) OVER (PARTITION BY game) AS n FROM e)
SELECT game AS game_id, play AS player, CAST(MAX(n) - MAX(k) AS BIGINT) AS actions_since FROM p GROUP BY 1, 2""")
def since(spark, sf):
    return G.since_involved(ordered_events(spark, sf).selectExpr("*", "0 as offense", "play as player"), "player").select("game_id", "player", "actions_since")


@query("win17_replay_steps", f"""WITH {EV}, x AS (SELECT *, CAST(value AS INT) % 4 AS period FROM e WHERE event_type <> 'signup') SELECT event_id AS position, row_number() OVER (PARTITION BY game ORDER BY event_id) AS step,
 event_id = MIN(event_id) OVER (PARTITION BY game, period) AS opens_period FROM (SELECT *, CAST(FLOOR(value) AS INT) % 4 AS period2 FROM x) y""".replace("PARTITION BY game, period)", "PARTITION BY game, period2)"))
def replay(spark, sf):
    df = ordered_events(spark, sf).selectExpr("*", "event_type = 'signup' as marker", "int(floor(value)) % 4 as period")
    return G.replay_steps(df).select("position", "step", "opens_period")


@query("agg62_prefix_totals", f"""WITH {EV} SELECT event_id AS position, COUNT(*) OVER w AS plays_so_far, CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS passes_so_far FROM e WINDOW w AS (PARTITION BY game ORDER BY event_id)""")
def prefix(spark, sf):
    df = ordered_events(spark, sf).selectExpr("*", "if(event_type = 'click', 'pass', 'run') as action", "play as actor")
    return G.prefix_totals(df).select("position", "plays_so_far", "passes_so_far")


RULES = [("r1", 10, 3, 3, 7, None, None, None), ("r2", 20, 4, 4, None, None, None, None), ("r3", 30, None, None, None, 3, 1, 10), ("r4", 5, None, None, None, None, None, None), ("r5", 40, None, None, 10, None, 50, None)]


@query("jn20_rule_cards", on_plays("""SELECT play_id, CASE WHEN distance >= 10 AND yards_to_goal >= 50 THEN 'r5' WHEN distance <= 3 AND yards_to_goal BETWEEN 1 AND 10 THEN 'r3' WHEN down = 4 THEN 'r2' WHEN down = 3 AND distance >= 7 THEN 'r1' ELSE 'r4' END AS rule_id FROM plays"""))
def rule_cards(spark, sf):
    empty = {f"{m}_{c}": None for c in J.RULE_BOUNDS for m in ("min", "max")}
    table = [(i, p, *{**empty, "min_down": a, "max_down": b, "min_distance": c, "max_distance": d, "min_yards_to_goal": e, "max_yards_to_goal": f}.values()) for i, p, a, b, c, d, e, f in RULES]
    rules = spark.createDataFrame(table, "rule_id string, priority int, " + ", ".join(f"{k} int" for k in empty))
    return J.best_rule(V.plays(spark, sf), rules).select("play_id", "rule_id")


@query("jn25_topics", on_plays("""SELECT play_id, CASE WHEN down = 4 THEN ['fourth', 'punt'][1 + (down * 11 + distance * 7 + yards_to_goal + period * 3) % 2] WHEN yards_to_goal <= 20 THEN ['red', 'goal', 'fade'][1 + (down * 11 + distance * 7 + yards_to_goal + period * 3) % 3] ELSE 'base' END AS topic FROM plays"""))
def topics(spark, sf):
    ids = "case when down = 4 then array('fourth', 'punt') when yards_to_goal <= 20 then array('red', 'goal', 'fade') else array('base') end"
    return V.plays(spark, sf).selectExpr("play_id", f"{ids} as ids", "down * 11 + distance * 7 + yards_to_goal + period * 3 as n").selectExpr("play_id", "element_at(ids, int(1 + pmod(n, size(ids)))) as topic")


@query("rpt23_drive_ending", on_plays(REP, f"SELECT play_id, {ENDING} AS ending FROM r"))
def drive_ending(spark, sf):
    return R.describe(rows(spark, sf)).selectExpr("play_id", f"{R.drive_ending()} as ending")


@query("rpt28_pre_snap", on_plays(REP, f"""l AS (SELECT game_id, arg_max(struct_pack(e := true_end, d := {END_D}, n := CASE WHEN yards_gained >= distance THEN 1 ELSE down + 1 END, c := pk % 25 = 0 AND offense <> defense), position) AS x FROM r WHERE type <> 'timeout' GROUP BY 1)""",
    "SELECT game_id, CASE WHEN x.e NOT BETWEEN 1 AND 99 THEN NULL WHEN x.c THEN 1 ELSE x.n END AS next_down, CASE WHEN x.e NOT BETWEEN 1 AND 99 THEN NULL WHEN x.c THEN least(10, x.e) ELSE least(x.d, x.e) END AS next_distance FROM l"))
def pre_snap(spark, sf):
    """The next legal situation after the last real report of a game."""
    df = R.with_spots(rows(spark, sf)).filter(f"not {R.is_marker()}")
    df = R.computed(df, R.fix_situation())
    return df.groupBy("game_id").agg(F.expr("max_by(struct(next_down, next_distance), position) as s")).select("game_id", "s.*")


@query("rpt29_player_labels", on_plays("SELECT play_id, replace(play_text, 'Q.Back', 'Quincy Back') AS txt FROM plays"))
def player_labels(spark, sf):
    aliases = "array(struct('Q.Back' as alias, 'Quincy Back' as label), struct('Back' as alias, 'x' as label), struct('Back' as alias, 'y' as label))"
    return V.plays(spark, sf).selectExpr("play_id", "play_text as text", f"{aliases} as aliases").selectExpr("play_id", f"{R.substitute_labels()} as txt")


@query("rpt30_prefix_score", f"WITH {EV}, m AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'view' THEN 2 END AS st, CAST(FLOOR(value) AS INT) AS h FROM e), x AS (SELECT game, arg_max(struct_pack(s := st, h := h), event_id) FILTER (st IS NOT NULL) AS v FROM m GROUP BY 1) SELECT game AS game_id, CASE WHEN v.s = 2 THEN v.h END AS home FROM x")
def prefix_score(spark, sf):
    df = ordered_events(spark, sf).selectExpr("*", "event_type = 'purchase' as scoring_play", "if(event_type = 'view', int(floor(value)), null) as home_score").withColumn("away_score", F.col("home_score"))
    return G.known_score(df).groupBy("game_id").agg(F.max_by("known_home", "position").alias("home"))


@query("rpt31_report_rules", on_plays(REP, "SELECT game_id, 0::BIGINT AS missing_id, COUNT(*) FILTER (type = 'timeout') AS missing_type, COUNT(*) FILTER (pk % 31 = 0) AS bad_period, 0::BIGINT AS duplicate_ids FROM r GROUP BY 1"))
def report_rules(spark, sf):
    df = rows(spark, sf).withColumns({"type": F.expr("if(type = 'timeout', '', type)"), "period": F.expr("if(pk % 31 = 0, 11, period)")})
    return R.report_errors(df)


@query("top03_leaders", f"WITH {EV}, c AS (SELECT game, play, COUNT(*) AS uses FROM e GROUP BY 1, 2) SELECT game AS game_id, arg_min(play, (-uses, play)) AS name, MAX(uses) AS uses FROM c GROUP BY 1")
def top_leaders(spark, sf):
    c = ordered_events(spark, sf).groupBy("game_id", "play").agg(F.count("*").alias("uses"))
    return c.groupBy("game_id").agg(F.expr("min_by(play, struct(-uses, play)) as name"), F.max("uses").alias("uses"))
