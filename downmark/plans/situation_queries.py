"""Queries for the per-play situation functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import rnd
from .oracle import on_eligible, on_plays, values
from .registry import query
from .views import plays


def r6(sql: str, digits: int = 6) -> str:
    scale = 10 ** digits
    return f"floor(({sql})*{scale}.0+0.5)/{scale}.0"


BAND = "CASE WHEN {d} < 0 THEN NULL WHEN {d} <= 3 THEN 'short' WHEN {d} <= 7 THEN 'medium' WHEN {d} > 7 THEN 'long' END"
ZONE = ("CASE WHEN {y} BETWEEN 80 AND 99 THEN 'own_deep' WHEN {y} BETWEEN 60 AND 79 THEN 'own' "
        "WHEN {y} BETWEEN 40 AND 59 THEN 'mid' WHEN {y} BETWEEN 20 AND 39 THEN 'opp' WHEN {y} BETWEEN 1 AND 19 THEN 'red' END")


@query("prj01_success_flag", on_plays("""
SELECT play_id, CASE WHEN down = 4 OR distance = 12 OR yards_gained = -5 THEN false
  WHEN down = 1 THEN yards_gained*10 >= distance*5 WHEN down = 2 THEN yards_gained*10 >= distance*7
  ELSE yards_gained >= distance END AS success FROM plays"""))
def success(spark, sf):
    flag = S.success_flag("nullif(down, 4)", "nullif(distance, 12)", "nullif(yards_gained, -5)")
    return plays(spark, sf).select("play_id", flag.alias("success"))


@query("prj02_distance_band", on_plays(f"""
SELECT play_id, {BAND.format(d='(NULLIF(distance, 12) - 2)')} AS band FROM plays"""))
def band(spark, sf):
    return plays(spark, sf).select("play_id", S.distance_band("nullif(distance, 12) - 2").alias("band"))


@query("prj03_field_zone", on_plays(f"""
SELECT play_id, {ZONE.format(y='(yards_to_goal + 1 - 2*(yards_to_goal % 2))')} AS zone FROM plays"""))
def zone(spark, sf):
    return plays(spark, sf).select("play_id", S.field_zone("yards_to_goal + 1 - 2 * (yards_to_goal % 2)").alias("zone"))


@query("prj04_bucket", on_plays(f"""
SELECT play_id, 'd' || down || '_' || ({BAND.format(d='(distance - 2)')}) || '_' || ({ZONE.format(y='(yards_to_goal - 1)')}) AS key FROM plays"""))
def bucket(spark, sf):
    return plays(spark, sf).select(
        "play_id", S.bucket("down", "distance - 2", "yards_to_goal - 1").alias("key"))


@query("prj05_widened_keys", on_eligible("""
SELECT play_id, 'd' || down || '_' || band || '_~' || zone AS pooled, 'd' || down || '_' || band AS by_distance,
  'd' || down AS by_down FROM el"""))
def widened_keys(spark, sf):
    return S.eligible(plays(spark, sf)).select(
        "play_id", S.pooled_key().alias("pooled"), S.distance_key().alias("by_distance"), S.down_key().alias("by_down"))


ZONE_ROWS = [(z, t) for z in S.ZONES for t in S.neighbors(z)]


@query("prj06_zone_neighbors", on_eligible(
    values(ZONE_ROWS, "zone, tzone", "zmap"),
    "SELECT tzone, COUNT(*) AS plays FROM el JOIN zmap USING (zone) GROUP BY tzone"))
def neighbors(spark, sf):
    df = S.eligible(plays(spark, sf)).select(S.field_zone().alias("zone"))
    return df.join(F.broadcast(S.zone_neighbors(spark)), "zone").groupBy("tzone").agg(F.count("*").alias("plays"))


@query("prj07_eligible", on_eligible("""
SELECT league, offense, COUNT(*) AS eligible, CAST(SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS BIGINT) AS passes
FROM el GROUP BY 1, 2"""))
def eligible(spark, sf):
    return (S.eligible(plays(spark, sf)).groupBy("league", "offense")
            .agg(F.count("*").alias("eligible"), F.count_if("is_pass").alias("passes")))


@query("prj08_explosive", on_plays("""
SELECT play_id, (is_pass AND yards_gained >= 15) OR (is_rush AND yards_gained >= 10) AS explosive FROM plays"""))
def explosive(spark, sf):
    return plays(spark, sf).select("play_id", S.explosive().alias("explosive"))


@query("prj18_recency_weight", on_plays(f"""
SELECT season, COUNT(*) AS plays, {r6('pow(0.5, (2001 - season) / 1.0)', 9)} AS one_year, {r6('pow(0.5, (2001 - season) / 2.0)', 9)} AS two_years,
  1.0::DOUBLE AS endless FROM plays GROUP BY season"""))
def recency(spark, sf):
    return (plays(spark, sf).groupBy("season").agg(F.count("*").alias("plays"))
            .select("season", "plays", rnd(S.recency_weight(2001, 1.0), 9).alias("one_year"),
                    rnd(S.recency_weight(2001, 2.0), 9).alias("two_years"),
                    S.recency_weight(2001, float("inf")).alias("endless")))


TEAM_COUNTS = """t AS (SELECT league, offense, 'd' || down || '_' || band || '_' || zone AS key, COUNT(*) AS n,
  SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS s FROM el GROUP BY 1, 2, 3),
l AS (SELECT league, key, SUM(s)::DOUBLE / SUM(n) AS league_rate FROM t GROUP BY 1, 2),
j AS (SELECT t.*, s::DOUBLE / n AS raw, l.league_rate, n::DOUBLE / (n + 60.0) AS w FROM t JOIN l USING (league, key))"""


def team_counts(spark, sf):
    t = (S.eligible(plays(spark, sf)).groupBy("league", "offense", S.bucket().alias("key"))
         .agg(F.count("*").alias("n"), F.count_if("is_pass").alias("s")))
    lg = t.groupBy("league", "key").agg((F.sum("s") / F.sum("n")).alias("league_rate"))
    return (t.join(lg, ["league", "key"]).withColumn("raw", F.col("s") / F.col("n"))
            .withColumn("w", S.shrink_weight("n")))


@query("prj19_shrink_weight", on_eligible(TEAM_COUNTS, f"""
SELECT league, offense, key, {r6('w')} AS weight, 1.0::DOUBLE AS no_prior, 0.0::DOUBLE AS prior_only FROM j"""))
def weight(spark, sf):
    return team_counts(spark, sf).select("league", "offense", "key", rnd(F.col("w")).alias("weight"),
                                         S.shrink_weight("n", 0).alias("no_prior"),
                                         S.shrink_weight("n", float("inf")).alias("prior_only"))


@query("prj20_shrink", on_eligible(TEAM_COUNTS, f"""
SELECT league, offense, key, {r6('CASE WHEN n % 7 = 0 THEN league_rate WHEN n % 5 = 0 THEN raw ELSE w*raw + (1.0 - w)*league_rate END')} AS rate FROM j"""))
def shrink(spark, sf):
    df = team_counts(spark, sf)
    raw, target = "if(n % 7 <> 0, raw, null)", "if(n % 5 <> 0 or n % 7 = 0, league_rate, null)"
    return df.select("league", "offense", "key", rnd(S.shrink(raw, "w", target)).alias("rate"))


@query("prj21_confidence", on_eligible(TEAM_COUNTS, """
SELECT league, CASE WHEN w >= 0.5 THEN 'high' WHEN w >= 0.35 THEN 'medium' ELSE 'low' END AS confidence,
  COUNT(*) AS cells, CAST(SUM(n) AS BIGINT) AS plays FROM j GROUP BY 1, 2"""))
def confidence(spark, sf):
    return (team_counts(spark, sf).groupBy("league", S.confidence("w").alias("confidence"))
            .agg(F.count("*").alias("cells"), F.sum("n").alias("plays")))


ATTRIBUTE = "w >= 0.35 AND abs(floor(raw*1000.0+0.5) - floor(league_rate*1000.0+0.5)) >= 30"


@query("prj22_can_attribute", on_eligible(TEAM_COUNTS, f"SELECT league, offense, key, {ATTRIBUTE} AS can_attribute FROM j"))
def attribute(spark, sf):
    return team_counts(spark, sf).select("league", "offense", "key",
                                         S.can_attribute("raw", "league_rate", "w").alias("can_attribute"))


@query("prj23_printed_rate", on_eligible(TEAM_COUNTS, f"""
SELECT league, offense, key, {r6(f'CASE WHEN {ATTRIBUTE} THEN raw ELSE league_rate END')} AS printed FROM j"""))
def printed(spark, sf):
    return team_counts(spark, sf).select("league", "offense", "key",
                                         rnd(S.printed_rate("raw", "league_rate", "w")).alias("printed"))


@query("prj24_score_band", on_eligible("SELECT score_band, COUNT(*) AS plays, MIN(score_diff) AS low, MAX(score_diff) AS high FROM el GROUP BY 1"))
def score_band(spark, sf):
    return (S.eligible(plays(spark, sf)).groupBy(S.score_band().alias("score_band"))
            .agg(F.count("*").alias("plays"), F.min("score_diff").alias("low"), F.max("score_diff").alias("high")))


@query("prj25_phase", on_plays("""
SELECT play_id, CASE WHEN period + (down % 2) > 4 THEN 'overtime' WHEN period + (down % 2) = 4 AND clock_seconds <= 120 THEN 'last_2min'
  WHEN period + (down % 2) = 4 AND clock_seconds <= 300 THEN 'last_5min' WHEN period + (down % 2) = 4 THEN 'fourth'
  WHEN period + (down % 2) = 2 AND clock_seconds <= 120 THEN 'half_2min' ELSE 'ordinary' END AS phase FROM plays"""))
def phase(spark, sf):
    return plays(spark, sf).select("play_id", S.phase("period + down % 2").alias("phase"))


@query("prj26_context", on_eligible("""
SELECT play_id, 'd' || down || '_' || band || '_' || zone || '|' || score_band || '|' || phase AS context, 'd' || down || '_' || band AS identity_bucket
FROM el WHERE score_diff <> 3"""))
def context(spark, sf):
    df = S.eligible(plays(spark, sf)).withColumn("score_diff", F.nullif("score_diff", F.lit(3)))
    return (df.select("play_id", S.context().alias("context"), S.distance_key().alias("identity_bucket"))
            .filter(F.col("context").isNotNull()))


HISTORY_KEY = """CASE WHEN distance <= yards_to_goal THEN concat('d', down, '|', CASE WHEN distance <= 3 THEN 'short' WHEN distance <= 6 THEN 'medium' ELSE 'long' END, '|',
  CASE WHEN distance = yards_to_goal THEN 'goal' WHEN yards_to_goal <= 20 THEN 'red' ELSE 'open' END, '|',
  CASE WHEN score_diff >= 9 THEN 'ahead' WHEN score_diff <= -9 THEN 'behind' ELSE 'close' END, '|',
  CASE WHEN period = 4 AND clock_seconds <= 300 THEN 'late' WHEN period = 2 AND clock_seconds <= 120 THEN 'half' ELSE 'ordinary' END) END"""


@query("prj27_history_context", on_plays(f"SELECT play_id, {HISTORY_KEY} AS context FROM plays"))
def history_context(spark, sf):
    return plays(spark, sf).select("play_id", S.history_context().alias("context"))


@query("prj31_stamp", on_plays("""
SELECT COALESCE(season, 0) * 100 + COALESCE(NULLIF(week, 7), 0) AS stamp, COUNT(*) AS plays FROM plays GROUP BY 1"""))
def stamp(spark, sf):
    return (plays(spark, sf).groupBy(S.stamp("season", "nullif(week, 7)").alias("stamp"))
            .agg(F.count("*").alias("plays")))


@query("prj32_sigmoid", on_eligible(TEAM_COUNTS, f"""
SELECT league, offense, key, {r6("1.0 / (1.0 + exp(-(0.9 * ln(greatest(0.001, least(0.999, raw)) / (1.0 - greatest(0.001, least(0.999, raw)))) + 0.05)))")} AS calibrated FROM j"""))
def sigmoid(spark, sf):
    return team_counts(spark, sf).select("league", "offense", "key",
                                         rnd(S.calibrated("raw", "0.9D", "0.05D")).alias("calibrated"))


@query("prj35_sample_bin", on_eligible(TEAM_COUNTS, """
SELECT CASE WHEN n < 30 THEN NULL WHEN n < 50 THEN '30-49' WHEN n < 75 THEN '50-74' WHEN n < 125 THEN '75-124' WHEN n < 250 THEN '125-249'
  WHEN n < 500 THEN '250-499' ELSE '500+' END AS sample_bin, COUNT(*) AS cells FROM j GROUP BY 1"""))
def sample_bin(spark, sf):
    return team_counts(spark, sf).groupBy(S.sample_bin("n").alias("sample_bin")).agg(F.count("*").alias("cells"))


@query("prj40_probe", on_eligible("""keys AS (SELECT DISTINCT down, band, zone, 'd' || down || '_' || band || '_' || zone AS key FROM el)""", """
SELECT el.league, keys.key, CASE keys.band WHEN 'short' THEN 2 WHEN 'medium' THEN 6 ELSE 10 END AS distance,
  CASE keys.zone WHEN 'own_deep' THEN 90 WHEN 'own' THEN 70 WHEN 'mid' THEN 50 WHEN 'opp' THEN 30 ELSE 10 END AS yards_to_goal,
  true AS round_trip, COUNT(*) AS plays FROM el JOIN keys ON el.down = keys.down AND el.band = keys.band AND el.zone = keys.zone GROUP BY ALL"""))
def probe(spark, sf):
    used = S.eligible(plays(spark, sf)).groupBy("league", S.bucket().alias("key")).agg(F.count("*").alias("plays"))
    dim = S.bucket_table(spark).select("key", "distance", "yards_to_goal", (S.bucket() == F.col("key")).alias("round_trip"))
    return used.join(F.broadcast(dim), "key").select("league", "key", "distance", "yards_to_goal", "round_trip", "plays")
