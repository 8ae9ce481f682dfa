"""Queries for journals, links, comparisons and audit counts over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports as R
from ..functions import situation as S
from ..functions.numbers import r
from ..operators import audit as A
from ..operators import joins as J
from ..operators.scoring import loss
from ..sources import documents as D
from . import views as V
from .oracle import on_eligible, on_plays
from .registry import query
from .scoring_queries import SC, scored
from .scoring_queries import loss as loss_sql
from .situation_queries import r6

EV = "e AS (SELECT *, user_id AS game, json_extract_string(props, '$.k') AS play, epoch_us(ts) // 1000 AS tm, event_type || '|' || CAST(FLOOR(value / 50) AS INT) AS content FROM events)"


def ev(spark, sf):
    return V.events(spark, sf).selectExpr("event_id", "game", "play", "event_type", "value", "at", "event_id div 500 as block",
                                          "concat(event_type, '|', string(int(floor(value / 50)))) as content")


@query("jn15_as_of_state", f"WITH {EV}, m AS (SELECT event_id AS id, game, tm FROM e WHERE event_type = 'view'), l AS (SELECT m.id, m.game, r.play, COUNT(*) AS revs, arg_max(r.event_type, r.event_id) AS et FROM m JOIN e r ON r.game = m.game AND r.tm + 45000 <= m.tm GROUP BY ALL)" + """
SELECT m.game, m.id, COUNT(l.play) AS plays, COALESCE(SUM(revs), 0)::BIGINT AS revisions, COALESCE(SUM(CASE WHEN et = 'click' THEN 1 ELSE 0 END), 0)::BIGINT AS counted FROM m LEFT JOIN l ON l.id = m.id AND l.game = m.game GROUP BY 1, 2""")
def as_of(spark, sf):
    e = ev(spark, sf)
    releases = e.selectExpr("game", "play", "at + 45000 as at", "event_id as id", "int(event_type = 'click') as counts", "event_id div 500 as block").withColumn("block", F.expr(f"at div {A.DAY}"))
    return A.released_state(releases, e.filter("event_type = 'view'").selectExpr("game", "at", "event_id as id"))


TARGET = f"{EV}, t AS (SELECT *, LEAD(play) OVER (PARTITION BY game ORDER BY event_id) AS target FROM e), fa AS (SELECT game, play, MIN(tm) AS first_at FROM e GROUP BY 1, 2)"


def forecasts(spark, sf):
    from ..scale import with_previous
    e = with_previous(ev(spark, sf), ["game"], "block", ["event_id"], {"target": "play"}, forward=True)
    return e.filter("event_type = 'view'").selectExpr("event_id as id", "game", "target as play", "at as shown_at", "play as own")


@query("jn16_last_forecast", f"WITH {TARGET}, x AS (SELECT t.event_id AS id, t.game, t.target AS play, t.tm AS shown_at, first_at FROM t LEFT JOIN fa ON fa.game = t.game AND fa.play = t.target WHERE event_type = 'view')" + """
SELECT id, game, play, CASE WHEN first_at IS NULL THEN 'no_target' WHEN shown_at >= first_at THEN 'late' WHEN id = MAX(CASE WHEN shown_at < first_at THEN id END) OVER (PARTITION BY game, play) THEN 'kept' ELSE 'superseded' END AS status FROM x""")
def last_forecast(spark, sf):
    arrivals = ev(spark, sf).groupBy("game", "play").agg(F.min("at").alias("first_at"))
    return A.last_forecasts(forecasts(spark, sf), arrivals)


@query("jn17_target_links", f"WITH {TARGET}, l AS (SELECT event_id AS id, target FROM t WHERE event_type = 'view' AND target IS NOT NULL AND event_id % 3 > 0 UNION ALL SELECT event_id, play FROM t WHERE event_type = 'view' AND event_id % 7 = 0), n AS (SELECT id, COUNT(DISTINCT target) AS k, MIN(target) AS target FROM l GROUP BY 1)" + """
SELECT e.event_id AS id, CASE WHEN COALESCE(k, 0) = 0 THEN 'missing' WHEN k = 1 THEN 'linked' ELSE 'conflict' END AS status, CASE WHEN k = 1 THEN n.target END AS target FROM e LEFT JOIN n ON n.id = e.event_id WHERE event_type = 'view'""")
def target_links(spark, sf):
    f = forecasts(spark, sf)
    links = f.filter("play is not null and id % 3 > 0").selectExpr("id", "play as target").unionByName(f.filter("id % 7 = 0").selectExpr("id", "own as target"))
    return A.link_status(links, f)


@query("jn19_roster_names", """WITH a AS (SELECT c_custkey, c_nationkey, c_name, CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 150 < 100 THEN c_custkey % 150 END AS jersey FROM customer)
SELECT c_custkey AS mention_id, CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CASE WHEN jersey IS NULL OR jersey = 7 THEN CAST(c_custkey AS VARCHAR) END ELSE CAST(c_custkey AS VARCHAR) END AS athlete_id FROM a""")
def roster_names(spark, sf):
    c = V.table(spark, sf, "customer")
    athletes = c.selectExpr("string(c_nationkey) as team_id", "string(c_custkey) as athlete_id", "concat('Player ', c_name) as full_name", "c_name as display_name", "concat('P. ', string(c_custkey)) as short_name",
                            "if(c_custkey % 10 <> 3 and c_custkey % 150 < 100, string(c_custkey % 150), null) as jersey")
    mentions = c.selectExpr("c_custkey as mention_id", "string(c_nationkey) as team_id", "case c_custkey % 4 when 3 then 'Nobody' when 2 then concat('#07 ', c_name) when 1 then concat('P. ', string(c_custkey)) else concat('plàyer ', c_name) end as reported")
    return J.resolve_roster(mentions, athletes).select("mention_id", "athlete_id")


@query("jn22_field_changes", f"WITH {EV}, f AS (SELECT game, play, arg_min(event_type, event_id) AS a, arg_min(floor(value / 100), event_id) AS b FROM e WHERE event_id % 5 <> 0 GROUP BY 1, 2), l AS (SELECT game, play, arg_max(event_type, event_id) AS a, arg_max(floor(value / 100), event_id) AS b FROM e WHERE event_id % 4 <> 0 GROUP BY 1, 2)" + """
SELECT COALESCE(f.game, l.game) AS game, COALESCE(f.play, l.play) AS play, CASE WHEN f.game IS NULL OR l.game IS NULL THEN 'unmatched' WHEN f.a <> l.a OR f.b <> l.b THEN 'changed' ELSE 'consistent' END AS status,
 CASE WHEN f.game IS NULL OR l.game IS NULL THEN 0 ELSE CAST(f.a <> l.a AS INT) + CAST(f.b <> l.b AS INT) END AS changes FROM f FULL JOIN l ON f.game = l.game AND f.play = l.play""")
def field_changes(spark, sf):
    e = ev(spark, sf).withColumn("band", F.expr("floor(value / 100)"))
    shown = e.filter("event_id % 5 <> 0").groupBy("game", "play").agg(F.min_by("event_type", "event_id").alias("a"), F.min_by("band", "event_id").alias("b"))
    final = e.filter("event_id % 4 <> 0").groupBy("game", "play").agg(F.max_by("event_type", "event_id").alias("a"), F.max_by("band", "event_id").alias("b"))
    return A.field_changes(shown, final, ["a", "b"])


ATT = "a AS (SELECT o_orderkey AS id, o_custkey % 40 AS target, o_orderdate AS opened_at, o_orderstatus = 'F' AS right_, o_orderpriority AS pair, o_custkey % 3 AS level, o_orderkey % 11 = 0 AS other_version FROM orders)"


def attempts(spark, sf):
    return V.table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_custkey % 40 as target", "o_orderdate as opened_at", "o_orderstatus = 'F' as right", "o_orderpriority as pair",
                                                   "o_custkey % 3 as level", "o_orderkey % 11 = 0 as other_version", "date_trunc('MONTH', o_orderdate) as block")


@query("win19_prior_exposure", f"WITH {ATT} SELECT id, COUNT(*) OVER w - 1 AS prior_attempts, CAST(SUM(CASE WHEN right_ THEN 1 ELSE 0 END) OVER w - CASE WHEN right_ THEN 1 ELSE 0 END AS BIGINT) AS prior_right FROM a WINDOW w AS (PARTITION BY target ORDER BY opened_at, id ROWS UNBOUNDED PRECEDING)")
def prior_exposure(spark, sf):
    return A.practice_exposure(attempts(spark, sf)).select("id", "prior_attempts", "prior_right")


@query("agg58_practice_groups", f"WITH {ATT} SELECT pair, level, COUNT(*) AS attempts, COUNT(*) FILTER (right_) AS right_count, COUNT(*) FILTER (other_version) AS other_version FROM a GROUP BY 1, 2")
def practice_groups(spark, sf):
    return attempts(spark, sf).groupBy("pair", "level").agg(F.count("*").alias("attempts"), F.expr("count_if(right) as right_count"), F.expr("count_if(other_version) as other_version"))


@query("jn23_practice_bank", f"WITH {ATT}, b AS (SELECT DISTINCT target, target % 2 AS content FROM a WHERE target < 30) SELECT a.id, CASE WHEN b.target IS NULL THEN 'unknown' WHEN b.content <> level % 2 THEN 'different' ELSE 'same' END AS status FROM a LEFT JOIN b ON a.target = b.target")
def practice_bank(spark, sf):
    a = attempts(spark, sf)
    bank = a.filter("target < 30").selectExpr("target", "to_json(struct(target % 2 as content)) as content").distinct()
    return a.join(bank, "target", "left").selectExpr("id", "case when content is null then 'unknown' when content <> to_json(struct(level % 2 as content)) then 'different' else 'same' end as status")


CALLS = """c AS (SELECT play_id AS call_id, game_id AS game, defense AS team, down, distance, yards_to_goal AS ytg, ok AS at FROM plays WHERE pk % 3 = 0),
rs AS (SELECT play_id AS result_id, game_id AS game, defense AS team, down, distance + 1 AS distance, yards_to_goal - 2 AS ytg, ok AS at FROM plays WHERE pk % 3 <> 0)"""


@query("jn24_call_links", on_plays(CALLS, """SELECT c.call_id, arg_min(rs.result_id, (rs.at, rs.result_id)) AS result_id FROM c LEFT JOIN rs ON c.game = rs.game AND c.team = rs.team AND c.down = rs.down AND abs(c.distance - rs.distance) <= 5 AND abs(c.ytg - rs.ytg) <= 5 AND rs.at > c.at GROUP BY 1"""))
def call_links(spark, sf):
    df = V.plays(spark, sf)
    calls = df.filter("pk % 3 = 0").selectExpr("play_id as call_id", "game_id as game", "defense as team", "down", "distance", "yards_to_goal as ytg", "ok as at")
    results = df.filter("pk % 3 <> 0").selectExpr("play_id as result_id", "game_id as game", "defense as team", "down", "distance + 1 as distance", "yards_to_goal - 2 as ytg", "ok as at")
    return A.link_calls(calls, results)


@query("rpt24_same_snap", on_plays("SELECT play_id, pk % 8 <= 5 AND pk % 9 <= 5 AS same FROM plays"))
def same_snap(spark, sf):
    df = V.plays(spark, sf).selectExpr("play_id", "yards_to_goal as a_ytg", "distance as a_distance", "yards_to_goal + int(pk % 8) as b_ytg", "distance - int(pk % 9) as b_distance")
    return df.selectExpr("play_id", f"{R.same_snap('a', 'b')} as same")


@query("agg56_forecast_cohorts", on_eligible(SC, """x AS (SELECT e.league, CASE WHEN e.week < 8 THEN 'development' ELSE 'prospective' END AS cohort, e.game_id, power(sc.pred - CASE WHEN e.is_pass THEN 1 ELSE 0 END, 2) AS l FROM el e JOIN sc ON e.league = sc.league AND e.offense = sc.team AND 'd' || e.down || '_' || e.band || '_' || e.zone = sc.key WHERE e.season = 2000)""", f"""
SELECT league, cohort, COUNT(*) AS plays, COUNT(DISTINCT game_id) AS games, CASE WHEN COUNT(*) >= 2000 AND COUNT(DISTINCT game_id) >= 20 THEN {r6('AVG(l)')} END AS brier FROM x GROUP BY 1, 2"""))
def cohorts(spark, sf):
    held = S.eligible(V.plays(spark, sf).filter("season = 2000")).selectExpr("league", "if(week < 8, 'development', 'prospective') as cohort", "game_id", "offense as team", f"{S.bucket_sql()} as key", "int(is_pass) as p")
    counted = held.groupBy("league", "cohort", "game_id", "team", "key").agg(F.count("*").alias("plays"), F.sum("p").alias("passes"))
    t = counted.join(scored(spark, sf).select("league", "team", "key", "pred"), ["league", "team", "key"]).withColumn("loss", F.expr(loss("pred")))
    return A.forecast_cohorts(t, least_plays=2000).selectExpr("league", "cohort", "plays", "games", f"{r('brier')} as brier")


@query("agg57_exclusions", on_plays("SELECT reason, COUNT(*) AS n FROM (SELECT unnest([CASE WHEN is_special THEN 'special' END, CASE WHEN is_penalty_only THEN 'penalty' END, CASE WHEN contains(play_text, 'takes a knee') THEN 'kneel' END, CASE WHEN pk % 9 = 0 THEN 'late' END]) AS reason FROM plays) WHERE reason IS NOT NULL GROUP BY 1"))
def exclusions(spark, sf):
    reasons = "array_compact(array(if(is_special, 'special', null), if(is_penalty_only, 'penalty', null), if(play_text like '%takes a knee%', 'kneel', null), if(pk % 9 = 0, 'late', null)))"
    return V.plays(spark, sf).selectExpr(f"explode({reasons}) as reason").groupBy("reason").agg(F.count("*").alias("n"))


@query("agg59_journal_audit", f"WITH {EV} SELECT game, COUNT(*) FILTER (event_type = 'view') AS moments, COUNT(DISTINCT CASE WHEN event_type = 'click' THEN play END) AS rated, arg_max(value, event_id) FILTER (event_type = 'click') AS last_rating FROM e GROUP BY 1")
def journal_audit(spark, sf):
    e = ev(spark, sf)
    plays_rated = e.filter("event_type = 'click'").groupBy("game", "play").agg(F.max(F.struct("event_id", "value")).alias("v"))
    rated = plays_rated.groupBy("game").agg(F.count("*").alias("rated"), F.max("v").alias("v"))
    return e.groupBy("game").agg(F.expr("count_if(event_type = 'view') as moments")).join(rated, "game", "left").selectExpr("game", "moments", "coalesce(rated, 0) as rated", "v.value as last_rating")


@query("win16_repetition", f"WITH {EV} SELECT event_id, COALESCE(list_contains(list(event_type) OVER (PARTITION BY game ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), event_type), false) AS repeated FROM e")
def repetition(spark, sf):
    return A.repeated_keys(ev(spark, sf), "event_type").select("event_id", "repeated")


@query("agg61_concept_totals", f"WITH {EV} SELECT event_type AS concept, COUNT(*) AS exposures, MAX(tm) AS last_at, COUNT(*) FILTER (value > 25) AS right_count FROM e GROUP BY 1")
def concepts(spark, sf):
    return ev(spark, sf).groupBy(F.col("event_type").alias("concept")).agg(F.count("*").alias("exposures"), F.max("at").alias("last_at"), F.expr("count_if(value > 25) as right_count"))


@query("agg67_sessions", f"WITH {EV} SELECT game, COUNT(*) AS revisions, COUNT(*) FILTER (event_type = 'view') AS shown, COUNT(*) FILTER (event_type = 'click') AS observations, MAX(tm) AS last_at FROM e GROUP BY 1")
def sessions(spark, sf):
    return ev(spark, sf).groupBy("game").agg(F.count("*").alias("revisions"), F.expr("count_if(event_type = 'view') as shown"), F.expr("count_if(event_type = 'click') as observations"), F.max("at").alias("last_at"))


@query("agg68_delay_summary", f"WITH {EV}, d AS (SELECT event_type, CAST(FLOOR(value) AS INT) - 10 AS d FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS rn, COUNT(*) OVER (PARTITION BY event_type) AS n FROM d) SELECT event_type, any_value(n) AS n, MAX(CASE WHEN rn = n // 2 + 1 THEN d END) AS median, MIN(d) AS low, MAX(d) AS high, COUNT(*) FILTER (d < 0) AS ahead FROM k GROUP BY 1")
def delays(spark, sf):
    """Upper-middle median from the counts per whole second, not from a sorted list."""
    d = ev(spark, sf).selectExpr("event_type", "int(floor(value)) - 10 as d").groupBy("event_type", "d").agg(F.count("*").alias("c"))
    run = d.selectExpr("*", "sum(c) over (partition by event_type order by d) as upto", "sum(c) over (partition by event_type) as n")
    return run.groupBy("event_type").agg(F.max("n").alias("n"), F.expr("min(if(upto >= n div 2 + 1, d, null)) as median"), F.min("d").alias("low"), F.max("d").alias("high"), F.expr("sum(if(d < 0, c, 0)) as ahead"))


@query("str02_revision_log", f"WITH {EV}, x AS (SELECT *, LAG(content) OVER (PARTITION BY game, play ORDER BY event_id) AS pc FROM e) SELECT event_id, game, play, content FROM x WHERE pc IS NULL OR pc <> content")
def revision_log(spark, sf):
    return A.with_revision(ev(spark, sf)).select("event_id", "game", "play", "content")


@query("str05_timing_breaks", f"WITH {EV}, x AS (SELECT *, tm - LAG(tm) OVER (PARTITION BY game ORDER BY event_id) AS gap FROM e) SELECT game, COUNT(*) FILTER (gap > 14400000) AS breaks, MAX(gap) AS longest FROM x GROUP BY 1")
def timing_breaks(spark, sf):
    from ..scale import with_previous
    e = with_previous(ev(spark, sf), ["game"], "block", ["event_id"], {"before": "at"})
    return e.groupBy("game").agg(F.expr("count_if(at - before > 14400000) as breaks"), F.expr("max(at - before) as longest"))


@query("str11_poll_compaction", f"WITH {EV}, c AS (SELECT *, CASE WHEN event_type = LAG(event_type) OVER w THEN 0 ELSE 1 END AS nw, tm - LAG(tm) OVER w AS gap FROM e WINDOW w AS (PARTITION BY game ORDER BY event_id)), i AS (SELECT *, SUM(nw) OVER (PARTITION BY game ORDER BY event_id) AS isl FROM c)" + """
SELECT game, event_type, COUNT(*) AS polls, MIN(tm) AS first_at, MAX(tm) AS last_at, MAX(CASE WHEN nw = 0 THEN gap END) AS max_gap FROM i GROUP BY game, isl, event_type""")
def compaction(spark, sf):
    from ..scale import with_island, with_previous
    e = with_previous(ev(spark, sf), ["game"], "block", ["event_id"], {"before": "at", "kind_before": "event_type"})
    runs = with_island(e, ["game"], "block", ["event_id"], ["event_type"])
    return runs.groupBy("game", "island", "event_type").agg(F.count("*").alias("polls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.expr("max(if(kind_before = event_type, at - before, null)) as max_gap")).drop("island")
