"""Queries for schema conformance, profiles and integrity rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import situation as S
from ..operators import quality as Q
from ..sources import plays as P
from . import views as V
from .oracle import on_eligible, on_plays
from .registry import query
from .situation_queries import r6
from .source_queries import PAYLOAD_SQL


def unified(spark, sf):
    return V.plays(spark, sf).selectExpr(
        "league", "season", "week", "game_id", "play_id", "int(0) as play_index", "offense", "defense", "period", "clock_seconds", "down", "distance",
        "yards_to_goal", "play_type_raw", "is_pass", "is_rush", "is_special", "is_penalty_only", "yards_gained", "yards_gained * 0.25D as value", "success",
        "score_diff", "play_text")


@query("val01_conform", on_plays("""
SELECT play_id, CAST(season AS SMALLINT) AS season, CAST(week AS TINYINT) AS week, CAST(down AS TINYINT) AS down, CAST(clock_seconds AS SMALLINT) AS clock_seconds,
 TRY_CAST(yards_gained * 20 AS TINYINT) AS yards_gained, CAST(yards_gained * 0.25 AS FLOAT) AS value FROM plays"""))
def conform(spark, sf):
    df = unified(spark, sf).withColumn("yards_gained", F.expr("yards_gained * 20"))
    return P.conform(df).select("play_id", "season", "week", "down", "clock_seconds", "yards_gained", "value")


@query("val02_validate", on_plays("""
v AS (SELECT *, CASE WHEN pk % 101 = 0 THEN NULL WHEN pk % 103 = 0 THEN 'xfl' ELSE league END AS lg, season - 2 AS s2, clock_seconds * 2 AS c2, distance - 3 AS d3, yards_to_goal + 1 AS y1 FROM plays)""", """
SELECT * FROM (SELECT unnest(['league_null', 'season_null', 'game_id_null', 'play_id_null', 'play_index_null', 'offense_null', 'defense_null', 'period_null', 'league_domain', 'season_range', 'week_range',
 'period_range', 'clock_seconds_range', 'down_range', 'distance_range', 'yards_to_goal_range', 'yards_gained_range', 'score_diff_range']) AS rule,
 unnest([COUNT(*) FILTER (lg IS NULL), 0, 0, 0, 0, 0, 0, 0, COUNT(*) FILTER (lg NOT IN ('cfb', 'nfl')), COUNT(*) FILTER (s2 NOT BETWEEN 1999 AND 2099), 0, 0, COUNT(*) FILTER (c2 > 900), 0,
 COUNT(*) FILTER (d3 < 0), COUNT(*) FILTER (y1 NOT BETWEEN 1 AND 99), 0, 0]) AS violations FROM v)"""))
def validate(spark, sf):
    df = V.plays(spark, sf).selectExpr(
        "case when pk % 101 = 0 then null when pk % 103 = 0 then 'xfl' else league end as league", "season - 2 as season", "week", "game_id", "play_id",
        "0 as play_index", "offense", "defense", "period", "clock_seconds * 2 as clock_seconds", "down", "distance - 3 as distance",
        "yards_to_goal + 1 as yards_to_goal", "yards_gained", "score_diff")
    return P.violations(df)


@query("val03_profile", on_plays(f"""
SELECT COUNT(*) AS plays, COUNT(DISTINCT league) AS leagues, COUNT(DISTINCT season) AS seasons, COUNT(DISTINCT game_id) AS games, COUNT(*) FILTER (NOT is_special AND NOT is_penalty_only) AS eligible,
 0::BIGINT AS null_down, {r6('AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END) FILTER (NOT is_special AND NOT is_penalty_only)', 4)} AS pass_rate,
 {r6('AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END) FILTER (NOT is_special AND NOT is_penalty_only)', 4)} AS success_rate,
 (SELECT COUNT(DISTINCT t) FROM (SELECT offense AS t FROM plays UNION SELECT defense FROM plays)) AS teams FROM plays"""))
def profile(spark, sf):
    return Q.profile(V.plays(spark, sf))


@query("val04_duplicates", on_plays("SELECT game_id, clock_seconds, COUNT(*) AS copies FROM copies GROUP BY ALL HAVING COUNT(*) > 1"))
def duplicates(spark, sf):
    return Q.duplicates(V.copies(spark, sf), ["game_id", "clock_seconds"])


@query("val05_complete", on_eligible("""
SELECT * FROM (SELECT unnest(['offense', 'distance', 'yards_gained', 'bucket']) AS feature, unnest([COUNT(*) FILTER (pk % 71 = 0), 0, COUNT(*) FILTER (yards_gained = 7), COUNT(*) FILTER (yards_to_goal = 1)]) AS missing FROM el)"""))
def complete(spark, sf):
    df = S.eligible(V.plays(spark, sf)).withColumns({"offense": F.expr("if(pk % 71 = 0, null, offense)"),
        "yards_gained": F.expr("nullif(yards_gained, 7)"), "yards_to_goal": F.expr("yards_to_goal - if(yards_to_goal = 1, 1, 0)")})
    return Q.missing(df, ["offense", "distance", "yards_gained"])


@query("val06_season_profile", on_plays(f"""
p AS (SELECT *, (is_pass OR is_rush) AND NOT contains(play_text, 'takes a knee') AS fit FROM plays)""", f"""
SELECT league, season, COUNT(*) AS plays, COUNT(*) FILTER (fit) AS eligible, COUNT(DISTINCT game_id) AS games, COUNT(DISTINCT offense) AS teams, {r6('AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END) FILTER (fit)')} AS pass_rate FROM p GROUP BY 1, 2"""))
def season_profile(spark, sf):
    return Q.season_profile(V.plays(spark, sf))


PART = "CASE WHEN season < 1998 THEN 1 WHEN season = 1998 AND week <= 9 THEN 2 WHEN season = 1998 THEN 3 ELSE 4 END + CASE WHEN season = 1997 AND pk % 500 = 0 THEN 1 ELSE 0 END"


@query("val07_disjoint_parts", on_plays(f"p AS (SELECT *, {PART} AS part FROM plays)", """
SELECT game_id, COUNT(DISTINCT part) AS parts, MIN(part) AS first_part, MAX(part) AS last_part FROM p GROUP BY 1 HAVING COUNT(DISTINCT part) > 1"""))
def disjoint(spark, sf):
    return Q.shared_groups(V.plays(spark, sf).withColumn("part", F.expr(PART)))


@query("val07_part_order", on_plays(f"p AS (SELECT *, {PART} AS part FROM plays), s AS (SELECT part, MIN(season*100+week) AS low, MAX(season*100+week) AS high FROM p GROUP BY 1)", """
SELECT *, COALESCE(low > LAG(high) OVER (ORDER BY part), true) AS after_previous FROM s"""))
def part_order(spark, sf):
    return Q.part_order(V.plays(spark, sf).withColumn("part", F.expr(PART)))


@query("val08_flag_overlap", on_plays("""
SELECT play_type_raw, COUNT(*) AS plays, COUNT(*) FILTER (CASE WHEN is_rush AND pk % 11 = 0 THEN 1 ELSE 0 END = 1) AS unflagged, COUNT(*) FILTER (is_special AND pk % 13 = 0) AS overlapping FROM plays GROUP BY 1"""))
def flag_overlap(spark, sf):
    df = V.plays(spark, sf).withColumns({"is_rush": F.expr("is_rush and pk % 11 <> 0"), "is_pass": F.expr("is_pass or (is_special and pk % 13 = 0)")})
    return Q.flag_overlap(df)


@query("val09_classification_table", on_plays(
    "k AS (SELECT game_id, period, clock_seconds, play_type_raw, play_text, down, distance, yards_to_goal, MIN(pk) AS pk, MIN(play_id) AS play_id, 0 AS season, 0 AS week, MIN(offense) AS offense, MIN(defense) AS defense, MIN(yards_gained) AS yards_gained FROM copies GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY game_id, period, clock_seconds, play_type_raw, play_text, down, distance, yards_to_goal"),
    PAYLOAD_SQL.format(src="(SELECT * REPLACE (1 AS pk) FROM k)"), "t AS (SELECT play_type_raw, COUNT(*) AS received FROM copies GROUP BY 1)", """
SELECT kind AS play_type_raw, category, how, COUNT(*) AS kept, any_value(received) AS received, CAST(any_value(received) - SUM(COUNT(*)) OVER (PARTITION BY kind) AS BIGINT) AS copies_removed
FROM c JOIN t ON c.kind = t.play_type_raw GROUP BY kind, category, how"""))
def classification_table(spark, sf):
    return Q.classification_table(V.copies(spark, sf))


@query("val10_sanity_rates", on_plays("ok AS (SELECT * FROM plays WHERE NOT is_special AND NOT is_penalty_only)", " UNION ALL ".join(
    f"SELECT league, '{n}' AS situation, COUNT(*) AS n, {r6('AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END)')} AS pass_rate FROM ok WHERE {c} GROUP BY 1" for n, c in Q.SITUATIONS.items())))
def sanity(spark, sf):
    return Q.sanity_rates(V.plays(spark, sf))


@query("val11_align_sources", on_plays("""
x AS (SELECT *, CASE WHEN pk % 9 = 0 THEN (clock_seconds + 60) % 900 ELSE clock_seconds END AS stored, (is_pass OR is_rush) AND NOT contains(play_text, 'takes a knee') AS fit FROM plays),
c AS (SELECT *, stored <> clock_seconds AS moved, CASE WHEN play_type_raw IN ('Pass Reception', 'Pass Incompletion') THEN 'pass' WHEN play_type_raw = 'Rush' THEN 'rush' WHEN play_type_raw = 'Timeout' THEN CASE WHEN contains(play_text, 'NO PLAY') THEN 'penalty' ELSE 'drop' END
   WHEN contains(play_text, 'NO PLAY') THEN 'penalty' WHEN play_type_raw = 'Punt' THEN 'special' WHEN contains(play_text, ' pass ') THEN 'pass' WHEN contains(play_text, ' rush ') THEN 'rush' WHEN contains(play_text, ' punt ') THEN 'special' ELSE 'drop' END AS cat FROM x)""", """
SELECT league, COUNT(*) FILTER (is_pass <> (cat = 'pass') OR is_rush <> (cat = 'rush') OR is_penalty_only <> (cat = 'penalty')) AS labels, COUNT(*) FILTER (fit) AS explicit_clocks,
 COUNT(*) FILTER (fit AND moved) AS clocks, COUNT(*) FILTER (fit AND moved AND ((period = 4 AND ((stored <= 120) <> (clock_seconds <= 120) OR (stored <= 300) <> (clock_seconds <= 300))) OR (period = 2 AND (stored <= 120) <> (clock_seconds <= 120)))) AS phases FROM c GROUP BY 1"""))
def align(spark, sf):
    df = V.plays(spark, sf).withColumn("clock_seconds", F.expr("if(pk % 9 = 0, (clock_seconds + 60) % 900, clock_seconds)"))
    return Q.alignment_report(df)


BANK = """e AS (SELECT DISTINCT league, game_id, CAST(ok % 5000 AS VARCHAR) AS id FROM plays WHERE down = 1 AND week = 3),
q AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 5000 AS VARCHAR) AS worked, CAST((o_orderkey + 1) % 5000 AS VARCHAR) AS tested,
  CASE WHEN o_orderkey % 9 = 0 THEN ['a', 'a', 'b'] ELSE ['a', 'b', 'c'] END AS choices, CASE WHEN o_orderkey % 7 = 0 THEN 'z' ELSE 'b' END AS answer FROM orders WHERE o_orderstatus = 'P')"""


@query("val17_bank_references", on_plays(BANK, "one AS (SELECT id, MIN(league) AS league, MIN(game_id) AS game_id FROM e GROUP BY id)", """
SELECT 'missing_example' AS rule, q.id FROM q LEFT JOIN one w ON w.id = worked LEFT JOIN one t ON t.id = tested WHERE w.id IS NULL OR t.id IS NULL
UNION ALL SELECT 'same_game', q.id FROM q JOIN one w ON w.id = worked JOIN one t ON t.id = tested WHERE w.league = t.league AND w.game_id = t.game_id
UNION ALL SELECT 'bad_answer', q.id FROM q WHERE answer = 'z' OR o9(q.id)""".replace(" OR o9(q.id)", " OR len(list_distinct(choices)) <> len(choices)") + """
UNION ALL SELECT 'duplicate_practice', id FROM q GROUP BY id HAVING COUNT(*) > 1"""))
def bank(spark, sf):
    df = V.plays(spark, sf).filter("down = 1 and week = 3").selectExpr("league", "game_id", "string(ok % 5000) as id").distinct()
    examples = df.groupBy("id").agg(F.min("league").alias("league"), F.min("game_id").alias("game_id"))
    practice = V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "string(o_orderkey) as id", "string(o_orderkey % 5000) as worked", "string((o_orderkey + 1) % 5000) as tested",
        "if(o_orderkey % 9 = 0, array('a', 'a', 'b'), array('a', 'b', 'c')) as choices", "if(o_orderkey % 7 = 0, 'z', 'b') as answer")
    return Q.bank_violations(examples, practice)
