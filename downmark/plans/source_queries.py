"""Queries for readers, ingest rules and document flattening."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import situation as S
from ..operators import cells as C
from ..operators import quality as Q
from ..sources import documents as D
from ..sources import plays as P
from ..sources import sinks
from . import views as V
from .oracle import on_eligible, on_plays
from .registry import query
from .situation_queries import r6


@query("src01_season_scan", """SELECT CAST(year(l_shipdate) AS INT) AS season, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1""")
def season_scan(spark, sf):
    df = P.read_season_plays(spark, [f"{sf}/lineitem.parquet"], ["l_shipdate", "l_quantity"])
    return df.groupBy(F.year("l_shipdate").alias("season")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))


PAYLOAD_SQL = """p AS (SELECT season, week, play_id, game_id, CASE WHEN pk % 3 = 0 THEN substr(play_text, 9) ELSE play_text END AS txt, play_type_raw AS kind, period, clock_seconds, pk,
  offense, defense, down, distance - CASE WHEN pk % 11 = 0 THEN 20 ELSE 0 END AS distance, yards_to_goal - CASE WHEN pk % 13 = 0 THEN 50 ELSE 0 END AS ytg,
  yards_gained * CASE WHEN pk % 17 = 0 THEN 10 ELSE 1 END AS gained, (clock_seconds // 60) * 60 + clock_seconds % 60 + CASE WHEN pk % 5 = 0 THEN 1 ELSE 0 END AS struct_clock FROM {src}),
c AS (SELECT *, CASE WHEN regexp_matches(txt, '(?i)\\bno play\\b') THEN 'penalty' WHEN kind IN ('Pass Reception', 'Pass Incompletion') THEN 'pass' WHEN kind = 'Rush' THEN 'rush'
    WHEN kind = 'Punt' THEN 'special' WHEN kind = 'Penalty' THEN 'penalty' WHEN kind = 'Timeout' THEN 'drop'
    WHEN contains(txt, ' pass ') THEN 'pass' WHEN contains(txt, ' rush ') THEN 'rush' WHEN contains(txt, ' punt ') THEN 'special' ELSE 'drop' END AS category,
  CASE WHEN regexp_matches(txt, '(?i)\\bno play\\b') THEN 'explicit-no-play' WHEN kind IN ('Pass Reception', 'Pass Incompletion', 'Rush', 'Punt', 'Penalty') THEN 'table' WHEN kind = 'Timeout' THEN 'admin'
    ELSE CASE WHEN kind = 'Mystery' THEN 'unknown-type-' ELSE '' END || CASE WHEN contains(txt, ' pass ') OR contains(txt, ' rush ') OR contains(txt, ' punt ') THEN 'text' ELSE 'unresolved' END END AS how FROM p)"""
PAY = PAYLOAD_SQL.format(src="plays")


@query("src02_week_payloads", on_plays(PAY, """
SELECT game_id, play_id, season, week, COALESCE(CASE WHEN pk % 3 <> 0 THEN clock_seconds END, CASE WHEN struct_clock <= 900 THEN struct_clock END) AS clock_seconds,
  down, CASE WHEN distance BETWEEN 0 AND 99 THEN distance END AS distance, CASE WHEN ytg BETWEEN 1 AND 99 THEN ytg END AS yards_to_goal, kind AS play_type_raw,
  category, greatest(-99, least(99, gained)) AS yards_gained, abs(gained) > 99 AS clamped FROM c WHERE category <> 'drop'"""))
def week_payloads(spark, sf):
    """Source records through JSON text, as the landed files hold them."""
    text = V.payload(spark, sf).selectExpr("season", "week", "to_json(array(struct(*))) as body")
    rows = text.selectExpr("season", "week", f"from_json(body, 'array<struct<{P.PAYLOAD}>>') as a").selectExpr("season", "week", "inline(a)")
    return P.shape_payload(rows).selectExpr("game_id", "play_id", "season", "week", "clock_seconds", "down", "distance", "yards_to_goal",
                                            "play_type_raw", "category", "yards_gained", "clamped")


@query("src03_game_summary", on_plays("""
d AS (SELECT ok, play_id, yards_gained, CAST(split_part(play_id, '-', 2) AS INT) AS line FROM plays),
g AS (SELECT *, CASE WHEN line <= 3 THEN 1 WHEN line <= 5 THEN 2 ELSE 3 END AS drive FROM d)""", """
SELECT CAST(ok AS VARCHAR) AS game_id, ok || '-' || drive AS drive_id, CAST(dense_rank() OVER (PARTITION BY ok ORDER BY drive) - 1 AS INT) AS drive_at,
 CAST(row_number() OVER (PARTITION BY ok, drive ORDER BY line) - 1 AS INT) AS play_at, play_id, yards_gained AS stat_yards FROM g"""))
def game_summary(spark, sf):
    rows = D.game_reports(D.parse_json(V.game_documents(spark, sf), D.SUMMARY))
    return rows.selectExpr("game_id", "drive_id", "drive_at", "play_at", "report.id as play_id", "report.statYardage as stat_yards")


COACH_SQL = """cs AS (SELECT school, year, coach_id, COUNT(*) AS games FROM (SELECT n_name AS school, y.year, c_custkey % 7 + y.year // 3 AS coach_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INT) AS year) y) GROUP BY ALL),
coach_year AS (SELECT school, year, coach_id, games, (year - coach_id % 2) || '-' || lpad(CAST(1 + coach_id % 12 AS VARCHAR), 2, '0') || '-01' AS hire_date, 'Coach ' || coach_id AS coach FROM cs)"""


@query("src04_coaches", f"""WITH {COACH_SQL} SELECT school, year, coach_id, coach, CAST(games AS INT) AS games, '1990-01-0' || (1 + coach_id % 9) AS hire_date FROM coach_year WHERE year = 1999""")
def coaches(spark, sf):
    rows = D.coach_seasons(D.parse_json(V.coach_documents(spark, sf), D.COACH), "1999")
    return rows.select("school", "year", "coach_id", "coach", "games", "hire_date")


@query("src05_rosters", """WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS team_id, CAST(c_custkey - CASE WHEN c_custkey % 97 = 0 THEN 25 ELSE 0 END AS VARCHAR) AS athlete_id, c_name,
  CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 150 < 100 THEN CAST(c_custkey % 150 AS VARCHAR) END AS jersey FROM customer),
f AS (SELECT team_id, athlete_id, COUNT(DISTINCT c_name || '|' || COALESCE(jersey, '')) > 1 AS conflict FROM a GROUP BY ALL)
SELECT a.team_id, a.athlete_id, 'Player ' || c_name AS full_name, jersey, conflict FROM a JOIN f ON a.team_id = f.team_id AND a.athlete_id = f.athlete_id""")
def rosters(spark, sf):
    a = D.roster_athletes(D.parse_json(V.roster_documents(spark, sf), D.ROSTER))
    bad = D.roster_conflicts(a).withColumn("conflict", F.lit(True))
    return (a.join(bad, ["team_id", "season", "athlete_id"], "left")
            .selectExpr("team_id", "athlete_id", "full_name", "jersey", "coalesce(conflict, false) as conflict"))


@query("src06_journals", """WITH e AS (SELECT *, user_id || '/' || (event_id // 1000) AS game_key FROM events)
SELECT game_key, COUNT(*) AS revisions, COUNT(*) AS releases, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS shown,
 SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS observations FROM e GROUP BY 1""")
def journals(spark, sf):
    t = D.journal_tables(D.parse_json(V.journal_documents(spark, sf), D.JOURNAL))
    rows = None
    for name, df in t.items():
        part = df.select("game_key", F.lit(name).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("game_key").agg(*[F.expr(f"count_if(kind = '{k}') as {a}") for k, a in (
        ("sources", "revisions"), ("releases", "releases"), ("shown", "shown"), ("observations", "observations"))])


@query("src09_changed_rows", on_eligible("""
n AS (SELECT league, offense AS team, COUNT(*) AS plays FROM el GROUP BY ALL), o AS (SELECT league, offense AS team, COUNT(*) AS plays FROM el WHERE NOT (season = 2001 AND league = 'nfl' AND offense < 'F') GROUP BY ALL)""",
    """SELECT *, 'new' AS side FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'old' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""))
def changed_rows(spark, sf):
    df = S.eligible(V.plays(spark, sf))
    count = lambda d, g: d.groupBy("league", F.col("offense").alias("team")).agg(F.count("*").alias("plays")).withColumn("generated", F.lit(g))
    return sinks.changed(count(df, "b"), count(df.filter("not (season = 2001 and league = 'nfl' and offense < 'F')"), "a"))


@query("src11_upsert_reviews", on_plays("""
a AS (SELECT game_id AS key, MAX(day) AS reviewed_at, COUNT(*) AS plays FROM (SELECT *, CAST(shipped AS DATE) AS day FROM plays WHERE week <= 8) GROUP BY 1
  UNION ALL SELECT game_id, MAX(CAST(shipped AS DATE)) + 1, COUNT(*) FROM plays WHERE week >= 5 GROUP BY 1)""", """
SELECT key, CAST(MAX(reviewed_at) AS DATE) AS reviewed_at, arg_max(plays, reviewed_at) AS plays FROM a GROUP BY key"""))
def upsert_reviews(spark, sf):
    df = V.plays(spark, sf)
    index = df.filter("week <= 8").groupBy(F.col("game_id").alias("key")).agg(F.max("day").alias("reviewed_at"), F.count("*").alias("plays"))
    new = (df.filter("week >= 5").groupBy(F.col("game_id").alias("key"))
           .agg(F.date_add(F.max("day"), 1).alias("reviewed_at"), F.count("*").alias("plays")))
    return sinks.upsert(index, new)


@query("src15_split_partitions", on_plays("""
c AS (SELECT season, week, MIN(shipped) AS start_at, MAX(shipped) AS end_at, COUNT(*) AS plays FROM plays GROUP BY 1, 2)""", """
SELECT season, week, plays, CASE WHEN end_at <= TIMESTAMP '2000-08-10 00:00:00' THEN 'final' ELSE 'live' END AS state FROM c WHERE season BETWEEN 1998 AND 2000 AND start_at <= TIMESTAMP '2000-08-10 00:00:00'"""))
def partitions(spark, sf):
    now = "2000-08-10 00:00:00"
    window = P.season_window(now, 3)
    cal = (V.plays(spark, sf).filter(F.col("season").isin(window)).groupBy("season", "week")
           .agg(F.min("shipped").alias("start_at"), F.max("shipped").alias("end_at"), F.count("*").alias("plays")))
    return P.split_partitions(cal, now).select("season", "week", "plays", "state")


@query("src16_present_seasons", on_plays("SELECT DISTINCT season FROM plays WHERE season IN (1994, 1996, 2001, 2005)"))
def present(spark, sf):
    return P.present_seasons(V.plays(spark, sf), [1994, 1996, 2001, 2005])


@query("src17_scoreboard", on_plays("""
g AS (SELECT game_id, offense, defense, season, MAX(off_score_post) AS o, MAX(def_score_post) AS d FROM plays GROUP BY ALL)""", """
SELECT game_id || '/' || defense AS game_id, CASE WHEN season < 2001 THEN 'post' ELSE 'in' END AS state, CAST(o AS INT) AS home_score, CAST(d AS INT) AS away_score
FROM g WHERE contains(lower(offense || ' ' || defense), 'ni') AND contains(lower(offense || ' ' || defense), 'ra')"""))
def scoreboard(spark, sf):
    games = D.scoreboard_games(D.parse_json(V.scoreboard_documents(spark, sf), D.SCOREBOARD))
    return D.search_games(games, "Ní RA").select("game_id", "state", "home_score", "away_score")


SRC_SQL = """s AS (SELECT *, CASE WHEN pk % 59 = 0 THEN NULL WHEN category = 'pass' THEN 'pass' WHEN category = 'rush' THEN 'run' WHEN category = 'special' THEN 'punt' ELSE 'no_play' END AS play_type,
 CAST(ok * 10 + CAST(split_part(play_id, '-', 2) AS INT) AS VARCHAR) AS pid FROM plays),
live AS (SELECT * FROM s WHERE play_type IS NOT NULL AND NOT (play_type = 'no_play' AND pk % 7 = 0))"""


@query("prj09_source_flags", on_plays(SRC_SQL, """
SELECT pid AS play_id, play_type = 'pass' AND pk % 61 <> 0 AS is_pass, play_type = 'run' AND pk % 61 <> 0 AS is_rush,
 play_type <> 'no_play' AND (play_type = 'punt' OR pk % 61 = 0) AS is_special, play_type = 'no_play' AS is_penalty_only FROM live"""))
def source_flags(spark, sf):
    return P.shape_source(V.source_rows(spark, sf)).select("play_id", "is_pass", "is_rush", "is_special", "is_penalty_only")


@query("prj10_sentinel_distance", on_plays(SRC_SQL, """
SELECT pid AS play_id, CASE WHEN pk % 19 = 0 THEN NULL ELSE down END AS down, CASE WHEN pk % 19 = 0 THEN NULL ELSE distance END AS distance FROM live"""))
def sentinel(spark, sf):
    return P.shape_source(V.source_rows(spark, sf)).select("play_id", "down", "distance")


@query("prj11_plain_ids", """SELECT COALESCE(CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END, '') AS id, COUNT(*) AS n FROM lineitem GROUP BY 1""")
def plain_ids(spark, sf):
    df = V.table(spark, sf, "lineitem").selectExpr(f"{L.plain_id('if(l_partkey % 5 = 0, null, double(l_orderkey))')} as id")
    return df.groupBy("id").agg(F.count("*").alias("n"))


CLASS_SQL = PAYLOAD_SQL.format(src="plays")


@query("prj12_classify", on_plays(PAY, "SELECT play_id, category, how FROM c"))
def classify(spark, sf):
    return L.classified(V.payload(spark, sf), "playType", "playText").selectExpr("id as play_id", "category", "how")


@query("prj13_resolve_text", on_plays("""
t AS (SELECT play_id, CASE WHEN pk % 4 = 0 THEN play_text || ' (K.Foot kick)' WHEN pk % 4 = 1 THEN 'fumble. ' || play_text || ', punt follows' ELSE play_text END AS txt, category, qty FROM plays)""", """
SELECT play_id, CASE WHEN contains(txt, ' pass ') THEN 'pass' WHEN contains(txt, ' rush ') THEN 'rush' WHEN contains(txt, ' punt ') OR contains(txt, ', punt') THEN 'special' END AS category FROM t"""))
def resolve_text(spark, sf):
    text = "case pk % 4 when 0 then concat(play_text, ' (K.Foot kick)') when 1 then concat('fumble. ', play_text, ', punt follows') else play_text end"
    return V.plays(spark, sf).selectExpr("play_id", f"{text} as txt").transform(L.with_verb, "txt", "category").select("play_id", "category")


@query("prj14_no_down_types", on_plays("""
SELECT play_id, CASE WHEN play_type_raw = 'Punt' AND pk % 3 = 0 THEN NULL ELSE down END AS down, CASE WHEN play_type_raw = 'Punt' AND pk % 3 = 0 THEN NULL ELSE distance END AS distance
FROM plays"""))
def no_down(spark, sf):
    df = V.plays(spark, sf).withColumn(
        "t", F.expr("if(play_type_raw = 'Punt' and pk % 3 = 0, 'Kickoff Return Touchdown', play_type_raw)"))
    hit = f"t in ({L.quoted(L.NO_DOWN)})"
    return df.selectExpr("play_id", f"if({hit}, null, down) as down", f"if({hit}, null, distance) as distance")


@query("prj15_range_guard", on_plays(PAY, """
SELECT CASE WHEN distance BETWEEN 0 AND 99 THEN distance END AS distance, COUNT(*) AS n, SUM(CASE WHEN abs(gained) > 99 THEN 1 ELSE 0 END)::BIGINT AS clamped,
 MAX(greatest(-99, least(99, gained))) AS top FROM c GROUP BY 1"""))
def range_guard(spark, sf):
    return (V.payload(spark, sf).selectExpr(f"{L.in_range('string(distance)', 0, 99)} as distance", "yardsGained as y").groupBy("distance")
            .agg(F.count("*").alias("n"), F.expr("count_if(abs(y) > 99) as clamped"), F.expr("max(greatest(-99, least(99, y))) as top")))


@query("prj16_structured_clock", on_plays(PAY, "SELECT play_id, CASE WHEN struct_clock <= 900 THEN struct_clock END AS clock FROM c"))
def structured_clock(spark, sf):
    return V.payload(spark, sf).selectExpr("id as play_id", f"bigint({L.structured_clock()}) as clock")


@query("prj17_text_clock", on_plays(PAY, "SELECT play_id, CASE WHEN pk % 3 <> 0 THEN clock_seconds END AS clock FROM c"))
def text_clock(spark, sf):
    return V.payload(spark, sf).selectExpr("id as play_id", f"{L.text_clock('playText')} as clock")


@query("prj28_college_conversion", on_plays("""
SELECT play_id, CASE WHEN contains(play_text, 'PENALTY') OR play_type_raw LIKE 'Fumble%' THEN NULL WHEN pk % 43 = 0 THEN false WHEN pk % 47 = 0 THEN true
 WHEN play_type_raw = 'Pass Incompletion' THEN false WHEN play_type_raw IN ('Pass Reception', 'Rush') THEN yards_gained >= distance END AS converted FROM plays"""))
def college_conversion(spark, sf):
    df = V.plays(spark, sf).withColumn("kind", F.expr("case when play_type_raw like 'Fumble%' then play_type_raw when pk % 43 = 0 then 'Pass Interception Return' when pk % 47 = 0 then 'Rushing Touchdown' else play_type_raw end"))
    return df.selectExpr("play_id", f"{L.college_conversion('kind')} as converted")


@query("prj29_clear_yards", on_plays("""
SELECT play_id, CASE WHEN contains(play_text, 'PENALTY') OR play_type_raw LIKE 'Fumble%' OR pk % 41 = 0 THEN NULL ELSE yards_gained END AS yards FROM plays"""))
def clear_yards(spark, sf):
    text = "case when pk % 41 = 0 then concat(play_text, ' intercepted') when pk % 37 = 0 then concat(play_text, ' Original Play: fumbled') else play_text end"
    return V.plays(spark, sf).withColumn("t", F.expr(text)).selectExpr("play_id", f"{L.clear_yards('play_type_raw', 't')} as yards")


@query("prj33_final_label", on_plays("""
SELECT play_id, CASE WHEN contains(play_text, 'takes a knee') OR contains(play_text, 'NO PLAY') THEN NULL WHEN play_type_raw IN ('Pass Reception', 'Pass Incompletion') THEN 1 WHEN play_type_raw = 'Rush' THEN 0
 WHEN play_type_raw IN ('Punt', 'Penalty', 'Timeout') THEN NULL WHEN contains(play_text, ' pass ') THEN 1 WHEN contains(play_text, ' rush ') THEN 0 END AS label FROM plays"""))
def final_label(spark, sf):
    return L.classified(V.plays(spark, sf).drop("category")).selectExpr("play_id", f"{L.final_label()} as label")


@query("prj34_passer", on_plays("""
SELECT play_id, CASE WHEN pk % 3 = 0 THEN 'Nation ' || upper(substr(offense, 1, 1)) || lower(substr(offense, 2, 2)) WHEN pk % 3 = 1 THEN 'Q.Back' END AS passer FROM plays WHERE is_pass"""))
def passer(spark, sf):
    name = "concat('Nation ', upper(substr(offense, 1, 1)), lower(substr(offense, 2, 2)))"
    text = f"case pk % 3 when 0 then concat({name}, ' pass complete to X') when 1 then 'Shotgun, pass from Q.Back to W.Out' else play_text end"
    return V.plays(spark, sf).filter("is_pass").selectExpr("play_id", f"{text} as t").selectExpr("play_id", f"{L.passer('t')} as passer")


@query("prj36_norm_name", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'etat ' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ' state and co'
 WHEN 1 THEN 'customer a and b' ELSE trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) END AS name FROM customer""")
def norm_name(spark, sf):
    raw = "case c_custkey % 3 when 0 then concat('État  ', c_name, ' St. & Co') when 1 then 'Cústomer A&B' else c_name end"
    return V.table(spark, sf, "customer").selectExpr("c_custkey", f"{raw} as n").selectExpr("c_custkey", f"{L.norm_name('n')} as name")


@query("prj37_resolve_team", """SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE n_name END AS team FROM nation""")
def resolve_team(spark, sf):
    from ..operators.joins import resolve_team as run

    nation = V.table(spark, sf, "nation")
    asked = nation.selectExpr("n_nationkey as k", "if(n_nationkey % 4 = 0, lower(n_name), 'nowhere') as location", "if(n_nationkey % 4 = 1, initcap(n_name), null) as short_name",
                              "if(n_nationkey % 4 = 2, concat(n_name, '.'), '?') as display_name", "cast(null as string) as name")
    return run(asked, nation.selectExpr("n_name as team")).select("k", "team")


@query("set01_season_union", on_plays("SELECT season, league, COUNT(*) AS plays FROM plays GROUP BY ALL"))
def season_union(spark, sf):
    df = V.plays(spark, sf).select("season", "league", "play_id")
    seasons = sorted(r["season"] for r in df.select("season").distinct().collect())  # a few values
    frames = [df.filter(f"season = {s}") for s in seasons]
    return functools.reduce(DataFrame.unionByName, frames).groupBy("season", "league").agg(F.count("*").alias("plays"))


@query("set03_shared_schools", f"WITH {COACH_SQL} SELECT DISTINCT school FROM coach_year WHERE year = 1996 AND coach_id % 2 = 0 INTERSECT SELECT DISTINCT school FROM coach_year WHERE year = 1997 AND games > 5")
def shared_schools(spark, sf):
    c = V.coach_seasons(spark, sf)
    return c.filter("year = 1996 and coach_id % 2 = 0").select("school").intersect(c.filter("year = 1997 and games > 5").select("school"))


@query("set04_unseen_teams", on_plays("SELECT DISTINCT defense AS team FROM plays WHERE season = 2000 EXCEPT SELECT DISTINCT offense FROM plays WHERE season < 1997 AND offense > 'F'"))
def unseen(spark, sf):
    df = V.plays(spark, sf)
    seen = df.filter("season < 1997 and offense > 'F'").select(F.col("offense").alias("team")).distinct()
    return df.filter("season = 2000").select(F.col("defense").alias("team")).distinct().join(seen, "team", "left_anti")


@query("win01_play_order", on_plays("SELECT play_id, game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY shipped, play_id) - 1 AS INT) AS play_index FROM plays"))
def play_order(spark, sf):
    return P.with_play_index(V.plays(spark, sf), "day", ["shipped", "play_id"]).select("play_id", "game_id", "play_index")


@query("win02_presnap_score", on_plays("""
s AS (SELECT *, CASE WHEN offense = least(offense, defense) THEN off_score_post ELSE def_score_post END AS h, CASE WHEN offense = least(offense, defense) THEN def_score_post ELSE off_score_post END AS a FROM plays),
b AS (SELECT *, COALESCE(LAG(h) OVER w, 0) AS ph, COALESCE(LAG(a) OVER w, 0) AS pa FROM s WINDOW w AS (PARTITION BY game_id ORDER BY shipped, play_id))""", """
SELECT play_id, CASE WHEN offense <= defense THEN ph - pa ELSE pa - ph END AS presnap_diff FROM b"""))
def presnap(spark, sf):
    df = V.plays(spark, sf).selectExpr("*", "least(offense, defense) as home")
    return P.with_presnap_score(df, "day", ["shipped", "play_id"], off_score="off_score_post", def_score="def_score_post").select("play_id", "presnap_diff")


@query("win04_exact_copies", on_plays("""
SELECT game_id, play_text, MIN(play_id) AS play_id, COUNT(*) AS copies FROM copies GROUP BY game_id, period, clock_seconds, play_type_raw, play_text, down, distance, yards_to_goal"""))
def exact_copies(spark, sf):
    df = V.copies(spark, sf).select(*P.EXACT_COPY, "play_id")
    return P.first_copies(df, order=("play_id",)).select("game_id", "play_text", "play_id", "copies")


@query("top01_total_order", on_plays("SELECT play_id, row_number() OVER (ORDER BY season, week, game_id, shipped, play_id) AS position FROM plays"))
def total_order(spark, sf):
    from ..scale import with_total_position

    df = V.plays(spark, sf).select("play_id", "season", "week", "game_id", "shipped", F.expr("season * 100 + week").alias("turn"), F.struct("game_id", "day").alias("block"))
    return with_total_position(df, "turn", "block", ["season", "week", "game_id", "shipped", "play_id"]).select("play_id", "position")
