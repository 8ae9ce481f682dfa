"""Queries for context models, caller assignments, protocols and season profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import situation as S
from ..functions.numbers import r
from ..operators import context as X
from ..operators import history as H
from ..operators import quality as Q
from ..operators.scoring import brier as brier_of
from ..operators.scoring import calibration_error, over_grid, reliability
from . import views as V
from .oracle import on_eligible, on_plays
from .registry import query
from .scoring_queries import brier, out
from .situation_queries import HISTORY_KEY, r6
from .source_queries import COACH_SQL

YEAR = 2000
W = "pow(0.5, (1999 - season) / 2.0)"
CELLS = """cc AS (SELECT league, season, week, offense AS identity, 'd' || down || '_' || band || '_' || zone AS bucket, 'd' || down || '_' || band || '_' || zone || '|' || score_band || '|' || phase AS context,
  'd' || down || '_' || band AS ib, phase, score_band, COUNT(*) AS plays, SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS passes FROM el GROUP BY ALL)"""


def fit_sql(tag, where, ref, ck="100.0"):
    w = f"pow(0.5, ({ref} - season) / 2.0)"
    return f"""tr{tag} AS (SELECT *, {w} AS w FROM cc WHERE {where}),
ov{tag} AS (SELECT league, SUM(passes * w) / SUM(plays * w) AS overall FROM tr{tag} GROUP BY 1),
pr{tag} AS (SELECT t.league, bucket, (SUM(passes * w) + 60.0 * any_value(overall)) / (SUM(plays * w) + 60.0) AS prior FROM tr{tag} t JOIN ov{tag} o ON t.league = o.league GROUP BY 1, 2),
ct{tag} AS (SELECT league, context, SUM(plays * w) AS cn, SUM(passes * w) AS ct FROM tr{tag} GROUP BY 1, 2)"""


def base_sql(src, tag, ck="100.0"):
    return f"""(SELECT c.*, (COALESCE(ct, 0.0) + {ck} * COALESCE(prior, overall)) / (COALESCE(cn, 0.0) + {ck}) AS base FROM {src} c LEFT JOIN pr{tag} p ON c.league = p.league AND c.bucket = p.bucket
 LEFT JOIN ct{tag} t ON c.league = t.league AND c.context = t.context LEFT JOIN ov{tag} o ON c.league = o.league)"""


FIT = fit_sql("", f"season < {YEAR}", YEAR - 1)
IDENT = f"""rb AS {base_sql('tr', '')}, io AS (SELECT league, identity, ib, SUM(plays * w) AS i_n, SUM((passes - plays * base) * w) AS i_total, SUM(plays) AS i_plays FROM rb GROUP BY ALL)"""
HELD = f"hb AS {base_sql(f'(SELECT * FROM cc WHERE season = {YEAR})', '')}, hp AS (SELECT hb.*, greatest(0.001, least(0.999, base + COALESCE(i_total / (i_n + 200.0), 0.0))) AS pred FROM hb LEFT JOIN io ON hb.league = io.league AND hb.identity = io.identity AND hb.ib = io.ib)"


def cells(spark, sf, cond, extra=()):
    return X.context_cells(V.plays(spark, sf).filter(cond), extra=extra)


@query("agg25_fit_context", on_eligible(CELLS, FIT, f"SELECT ct.league, context, {r6('cn')} AS n, {r6('ct')} AS total FROM ct"))
def fit_context(spark, sf):
    m = X.fit_context(cells(spark, sf, f"season < {YEAR}"), YEAR - 1)
    return m["table"].selectExpr("league", "context", f"{r('c_n')} as n", f"{r('c_total')} as total")


@query("agg26_predict_context", on_eligible(CELLS, FIT, f"hb AS {base_sql(f'(SELECT * FROM cc WHERE season = {YEAR})', '')}",
    f"SELECT league, context, SUM(plays)::BIGINT AS plays, {r6('MAX(base)')} AS base FROM hb GROUP BY 1, 2"))
def predict_context(spark, sf):
    m = X.fit_context(cells(spark, sf, f"season < {YEAR}"), YEAR - 1)
    df = X.predict_context(m, cells(spark, sf, f"season = {YEAR}"))
    return df.groupBy("league", "context").agg(F.sum("plays").alias("plays"), F.expr(f"{r('max(base)')} as base"))


def identity_fit(spark, sf):
    train = cells(spark, sf, f"season < {YEAR}")
    m = X.fit_context(train, YEAR - 1)
    return m, X.fit_identity(X.predict_context(m, train), YEAR - 1)


@query("agg27_identity_offsets", on_eligible(CELLS, FIT, IDENT, f"SELECT league, identity, ib AS identity_bucket, i_plays::BIGINT AS plays, {r6('i_total / (i_n + 200.0)', 5)} AS pull FROM io"))
def identity_offsets(spark, sf):
    _, offsets = identity_fit(spark, sf)
    return offsets.selectExpr("league", "identity", "identity_bucket", "i_plays as plays", f"{r('i_total / (i_n + 200.0D)', 5)} as pull")


TUNE_FIT = fit_sql("", "season < 1999", 1998)
TUNE = [CELLS, TUNE_FIT, "g1 AS (SELECT unnest([10.0, 30.0, 100.0, 300.0, 1000.0])::DOUBLE AS ck)", "v AS (SELECT * FROM cc CROSS JOIN g1 WHERE season = 1999)", f"vb AS {base_sql('v', '', 'ck')}",
        f"c1 AS (SELECT league, ck, {brier('base')} AS b FROM vb GROUP BY ALL), best AS (SELECT league, arg_min(ck, (floor(b*1e12+0.5), -ck)) AS ck FROM c1 GROUP BY 1)",
        f"tb AS {base_sql('(SELECT tr.*, best.ck FROM tr JOIN best ON tr.league = best.league)', '', 'ck')}, io AS (SELECT league, identity, ib, SUM(plays * w) AS i_n, SUM((passes - plays * base) * w) AS i_total FROM tb GROUP BY ALL)",
        "g2 AS (SELECT unnest([30.0, 60.0, 200.0, 600.0, 2000.0, 'inf'::DOUBLE])::DOUBLE AS ik)",
        "v2 AS (SELECT vb.*, ik FROM vb JOIN best ON vb.league = best.league AND vb.ck = best.ck CROSS JOIN g2)",
        "v3 AS (SELECT v2.*, greatest(0.001, least(0.999, base + CASE WHEN isinf(ik) OR i_n IS NULL THEN 0.0 ELSE i_total / (i_n + ik) END)) AS pred FROM v2 LEFT JOIN io ON v2.league = io.league AND v2.identity = io.identity AND v2.ib = io.ib)",
        f"c2 AS (SELECT league, ik, {brier('pred')} AS b FROM v3 GROUP BY ALL)"]


@query("agg28_two_stage_tuning", on_eligible(*TUNE, "SELECT c2.league, arg_min(ik, (floor(b*1e12+0.5), -ik)) AS ik, any_value(best.ck) AS ck FROM c2 JOIN best ON c2.league = best.league GROUP BY 1"))
def tuning(spark, sf):
    return X.tune(cells(spark, sf, "season < 1999"), cells(spark, sf, "season = 1999"), 1998)


ASSIGN = f"""{COACH_SQL},
pc AS (SELECT school, year, arg_max(coach_id, (games, -CAST(replace(hire_date, '-', '') AS BIGINT), -coach_id)) AS caller FROM coach_year GROUP BY 1, 2)"""


def callers(spark, sf):
    from ..operators.shifts import primary_coaches

    pc = primary_coaches(V.coach_seasons(spark, sf))
    assignments = pc.groupBy("school", "coach_id").agg(F.collect_set("year").alias("seasons")).selectExpr(
        "school as team", "seasons", "string(coach_id) as caller", "concat(string(coach_id), '_', school) as tenure")
    exceptions = V.plays(spark, sf).filter("season = 1998 and week = 3").selectExpr("game_id", "offense as team").distinct()
    return assignments, exceptions


@query("jn10_caller_assignment", on_plays(ASSIGN, """
SELECT p.play_id, CASE WHEN p.season = 1998 AND p.week = 3 THEN NULL ELSE CAST(caller AS VARCHAR) END AS caller, CASE WHEN p.season = 1998 AND p.week = 3 THEN NULL ELSE caller || '_' || school END AS tenure
FROM plays p LEFT JOIN pc ON p.offense = pc.school AND p.season = pc.year"""))
def caller_assignment(spark, sf):
    return X.assign_callers(V.plays(spark, sf), *callers(spark, sf)).select("play_id", "caller", "tenure")


@query("win18_first_transfer", f"""WITH {ASSIGN}, s AS (SELECT CAST(caller AS VARCHAR) AS caller, caller || '_' || school AS tenure, school AS team, MIN(year) AS start FROM pc GROUP BY ALL)
SELECT * FROM s WHERE EXISTS (SELECT 1 FROM s e WHERE e.caller = s.caller AND e.team <> s.team AND e.start < s.start)""")
def transfers(spark, sf):
    return X.transfer_starts(callers(spark, sf)[0])


@query("agg29_blend", on_eligible(CELLS, FIT, IDENT, HELD, f"""
SELECT league, SUM(plays)::BIGINT AS n, {r6(brier('pred'))} AS team, {r6(brier('base'))} AS context, {r6(brier('CASE WHEN identity < ' + "'M'" + ' THEN (pred + base) / 2 ELSE pred END'))} AS blend FROM hp GROUP BY 1"""))
def blend(spark, sf):
    m, offsets = identity_fit(spark, sf)
    held = X.predict_identity(offsets, X.predict_context(m, cells(spark, sf, f"season = {YEAR}")))
    t = held.groupBy("league").agg(F.sum("plays").alias("n"), F.expr(f"{brier_of('pred')} as team"), F.expr(f"{brier_of('base')} as context"),
                                   F.expr(brier_of("if(identity < 'M', (pred + base) / 2, pred)") + " as blend"))
    return out(t, "team", "context", "blend", keep=("league", "n"))


@query("agg30_model_export", on_eligible("SELECT league, 'd' || down || '_' || band || '_' || zone || '|' || score_band || '|' || phase AS context, COUNT(*) AS n, COUNT(DISTINCT game_id) AS games FROM el GROUP BY 1, 2"))
def model_export(spark, sf):
    return X.export_model(V.plays(spark, sf))


@query("agg31_subgroup_gates", on_eligible(CELLS, FIT, IDENT, HELD, f"""
SELECT league, phase, score_band, SUM(plays)::BIGINT AS n, {r6(brier('pred'))} AS candidate, {r6(brier('base'))} AS baseline, SUM(plays) < 200 OR ({brier('pred')}) - ({brier('base')}) <= 0.01 AS passes_gate FROM hp GROUP BY 1, 2, 3"""))
def gates(spark, sf):
    m, offsets = identity_fit(spark, sf)
    extra = (f"{S.phase_sql()} as phase", f"{S.score_band_sql()} as score_band")
    held = X.predict_identity(offsets, X.predict_context(m, cells(spark, sf, f"season = {YEAR}", extra)))
    return out(X.subgroup_gates(held, "pred", "base"), "candidate", "baseline", keep=("league", "phase", "score_band", "n", "passes_gate"))


@query("sim10_sigmoid_fit")
def sigmoid_fit(spark, sf):
    m, offsets = identity_fit(spark, sf)
    held = X.predict_identity(offsets, X.predict_context(m, cells(spark, sf, f"season = {YEAR}")))
    return out(X.fit_sigmoid(held), "slope", "intercept", keep=("league",))


@query("sim11_protocol")
def protocol(spark, sf):
    t = X.protocol(V.plays(spark, sf), YEAR).groupBy("league").agg(
        F.sum("plays").alias("n"), F.expr(f"{brier_of('pred')} as uncalibrated"), F.expr(f"{brier_of('calibrated')} as calibrated"))
    return out(t, "uncalibrated", "calibrated", keep=("league", "n"))


FOLDS = [on for y in (1998, 1999, 2000) for on in (fit_sql(f"_{y}", f"season < {y}", y - 1), f"f_{y} AS {base_sql(f'(SELECT * FROM cc WHERE season = {y})', f'_{y}')}")]


@query("sim12_expanding_folds", on_eligible(CELLS, *FOLDS, "f AS (" + " UNION ALL ".join(f"SELECT league, season, plays, passes, base FROM f_{y}" for y in (1998, 1999, 2000)) + ")", f"""
SELECT league, CASE WHEN GROUPING(season) = 1 THEN 'pooled' ELSE CAST(season AS VARCHAR) END AS fold, SUM(plays)::BIGINT AS n, {r6(brier('base'))} AS brier FROM f GROUP BY GROUPING SETS ((league, season), (league))"""))
def folds(spark, sf):
    """All folds in one job: the cells are copied per later holdout year."""
    every = cells(spark, sf, "season <= 2000")
    grid = over_grid(every, (1998, 1999, 2000), "fold").withColumn("fold", F.expr("int(fold)"))
    by = ("league", "fold")
    train = grid.filter("season < fold").withColumn("season", F.expr("season + 2000 - fold"))  # shift so one reference serves all folds
    model = X.fit_context(train, 1999, by=by)
    held = X.predict_context(model, grid.filter("season = fold"), by=by)
    t = held.groupBy("league", "fold").agg(F.sum("plays").alias("n"), F.expr(f"sum({_loss('base')}) as loss"))
    t = t.groupingSets([["league", "fold"], ["league"]], "league", "fold").agg(F.sum("n").alias("n"), F.expr("sum(loss) / sum(n) as brier"))
    return t.selectExpr("league", "coalesce(string(fold), 'pooled') as fold", "n", f"{r('brier')} as brier")


def _loss(p):
    from ..operators.scoring import loss
    return loss(p)


@query("sim13_refit", on_eligible(CELLS, fit_sql("", "season <= 2000", 2000), "SELECT league, COUNT(*) AS contexts, (SELECT COUNT(*) FROM el WHERE season > 2000) > 0 AS future_rows FROM ct GROUP BY 1"))
def refit(spark, sf):
    df = V.plays(spark, sf)
    m = X.fit_context(X.context_cells(df.filter("season <= 2000")), 2000)
    late = S.eligible(df).agg(F.expr("count_if(season > 2000) > 0 as future_rows"))
    return m["table"].groupBy("league").agg(F.count("*").alias("contexts")).join(F.broadcast(late))


@query("sim14_read_parity", on_eligible(CELLS, FIT, IDENT, HELD, """
SELECT league, COUNT(*) AS inputs, 0::BIGINT AS above_limit FROM (SELECT DISTINCT league, identity, bucket, context, ib FROM hp) GROUP BY 1"""))
def read_parity(spark, sf):
    """Distinct inputs predicted by joins and by the literal formula over the stored sums."""
    m, offsets = identity_fit(spark, sf)
    held = cells(spark, sf, f"season = {YEAR}")
    a = X.predict_identity(offsets, X.predict_context(m, held))
    key = ["league", "identity", "bucket", "context", "identity_bucket"]
    stored = (held.select(*key).distinct().join(m["prior"], ["league", "bucket"], "left").join(m["table"], ["league", "context"], "left")
              .join(m["overall"], "league").join(offsets, ["league", "identity", "identity_bucket"], "left"))
    direct = stored.selectExpr(*key, "nvl(prior, o_rate) as q", "nvl(c_n, 0D) as n", "nvl(c_total, 0D) as t", "nvl(i_total / (200D + i_n), 0D) as off").selectExpr(
        *key, "least(0.999D, greatest(0.001D, off + n / (n + 100D) * nvl(t / nullif(n, 0D), 0D) + 100D / (n + 100D) * q)) as other")
    return (a.groupBy(*key).agg(F.max("pred").alias("pred")).join(direct, key).groupBy("league")
            .agg(F.count("*").alias("inputs"), F.expr("count_if(abs(pred - other) > 1e-12) as above_limit")))


# --- outcomes and season profiles -------------------------------------------------------

OUT_SQL = """o AS (SELECT *, CASE WHEN pk % 23 = 0 THEN defense ELSE offense END AS posteam, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS first_down, CASE WHEN is_penalty_only OR pk % 37 = 0 THEN 1 ELSE 0 END AS pen,
   yards_to_goal <= 9 AND (CASE WHEN pk % 2 = 0 THEN offense ELSE defense END) = (CASE WHEN pk % 23 = 0 THEN defense ELSE offense END) AS own_td, pk % 29 = 0 AS lost, pk % 31 = 0 AS picked FROM plays),
oc AS (SELECT *, CASE WHEN first_down IS NOT NULL AND pen = 0 AND posteam = offense THEN (first_down = 1 OR own_td) AND NOT lost AND NOT picked END AS converted, CASE WHEN pen = 0 AND posteam = offense THEN yards_gained END AS y FROM o)"""


@query("prj30_flag_conversion", on_plays(OUT_SQL, "SELECT play_id, converted FROM oc"))
def flag_conversion(spark, sf):
    return V.outcomes(spark, sf).join(V.plays(spark, sf).select("play_id", "offense"), "play_id").selectExpr("play_id", f"{L.flag_conversion()} as converted")


def with_outcomes(spark, sf):
    return H.attach_outcomes(V.plays(spark, sf), V.outcomes(spark, sf))


@query("jn05_outcomes", on_plays(OUT_SQL, "SELECT league, offense, COUNT(*) AS n, COUNT(converted) AS known, COUNT(*) FILTER (converted) AS converted, COUNT(y) AS clear FROM oc GROUP BY 1, 2"))
def outcome_join(spark, sf):
    return with_outcomes(spark, sf).groupBy("league", "offense").agg(F.count("*").alias("n"), F.count("converted").alias("known"),
        F.expr("count_if(converted) as converted"), F.count("clear_yards").alias("clear"))


PROFILE = [OUT_SQL, f"h AS (SELECT *, {HISTORY_KEY} AS context FROM oc WHERE (is_pass OR is_rush) AND NOT contains(play_text, 'takes a knee'))",
    "u AS (SELECT league, season, 'offense' AS side, offense AS team, context, game_id, converted, is_rush, is_pass, y FROM h WHERE context IS NOT NULL UNION ALL SELECT league, season, 'defense', defense, context, game_id, converted, is_rush, is_pass, y FROM h WHERE context IS NOT NULL)",
    "pc AS (SELECT league, season, side, team, context, COUNT(*) AS n, COUNT(DISTINCT game_id) AS games, COUNT(converted) AS known, COUNT(*) FILTER (converted) AS conversions, " + ", ".join(
        f"COUNT(*) FILTER ({f}) AS {a}_n, COUNT(*) FILTER ({f} AND y IS NOT NULL) AS {a}_known, COUNT(*) FILTER ({f} AND y <= 2) AS {a}_two_or_less, COUNT(*) FILTER ({f} AND y >= 5) AS {a}_five_plus, COUNT(*) FILTER ({f} AND y >= 10) AS {a}_ten_plus, median(y) FILTER ({f}) AS {a}_median"
        for a, f in (("run", "is_rush"), ("pass", "is_pass"))) + " FROM u GROUP BY ALL HAVING COUNT(*) >= 3 AND COUNT(DISTINCT game_id) >= 2)"]


def profile_cells(spark, sf, **least):
    """The cells that the small test tables fill; the operator's own floors ask for more."""
    return H.profile_cells(S.eligible(with_outcomes(spark, sf)), **(least or {"min_plays": 3, "min_games": 2}))


@query("agg32_history_profiles", on_plays(*[p.replace(">= 3 AND COUNT(DISTINCT game_id) >= 2", ">= 20 AND COUNT(DISTINCT game_id) >= 5") for p in PROFILE], "SELECT * FROM pc"))
def history_profiles(spark, sf):
    return profile_cells(spark, sf, min_plays=20, min_games=5)


@query("agg32_history_profiles_small", on_plays(*PROFILE, "SELECT * FROM pc"))
def small_history_profiles(spark, sf):
    """The same cells from three plays in two games on, for tables that are too small for more."""
    return profile_cells(spark, sf)


@query("agg33_usable_profiles", on_plays(*PROFILE, """
SELECT league, season, side, team, context, known >= 20 AND known >= 0.9 * n AS conversion_usable, run_known >= 15 AND run_known >= 0.9 * run_n AS run_usable,
 CASE WHEN context LIKE 'd3|%' AND known >= 20 AND known >= 0.9 * n THEN 'third_down' WHEN context LIKE '%|short|%' AND run_known >= 15 AND run_known >= 0.9 * run_n THEN 'short_run' END AS reading FROM pc"""))
def usable(spark, sf):
    return H.usable(profile_cells(spark, sf)).select("league", "season", "side", "team", "context", "conversion_usable", "run_usable", "reading")


@query("agg34_profile_coverage", on_plays(*PROFILE, "SELECT league, season, side, COUNT(DISTINCT team) AS teams, COUNT(*) AS cells, SUM(n)::BIGINT AS covered FROM pc GROUP BY 1, 2, 3"))
def coverage(spark, sf):
    return H.coverage(profile_cells(spark, sf))


@query("jn18_prior_season", on_plays(*PROFILE, f"s AS (SELECT DISTINCT league, season, offense, defense, {HISTORY_KEY} AS context FROM plays WHERE season = 1999)", """
SELECT s.league, s.season, s.offense, s.defense, s.context, o.n AS offense_n, o.conversions AS offense_conversions, d.n AS defense_n FROM s
LEFT JOIN pc o ON o.side = 'offense' AND o.league = s.league AND o.season = s.season - 1 AND o.team = s.offense AND o.context = s.context
LEFT JOIN pc d ON d.side = 'defense' AND d.league = s.league AND d.season = s.season - 1 AND d.team = s.defense AND d.context = s.context"""))
def prior_season(spark, sf):
    asked = V.plays(spark, sf).filter("season = 1999").selectExpr("league", "season", "offense", "defense", f"{S.HISTORY_CONTEXT} as context").distinct()
    return H.prior_season(asked, profile_cells(spark, sf)).select("league", "season", "offense", "defense", "context", "offense_n", "offense_conversions", "defense_n")


@query("jn06_checked_join", on_plays(OUT_SQL, "SELECT season, COUNT(*) AS joined, COUNT(*) FILTER (posteam <> offense) AS other_team, 0::BIGINT AS unmatched, 0::BIGINT AS repeated FROM o GROUP BY 1"))
def checked_join(spark, sf):
    df, side = V.plays(spark, sf), V.outcomes(spark, sf)
    keys = ["game_id", "play_id"]
    side = side.withColumn("hit", F.lit(True))
    repeated = Q.duplicates(side, keys).agg(F.count("*").alias("repeated"))
    t = df.join(side, keys, "left").groupBy("season").agg(F.count("*").alias("joined"), F.expr("count_if(posteam <> offense) as other_team"),
                                                        F.expr("count_if(hit is null) as unmatched"))
    return t.join(F.broadcast(repeated))


@query("jn08_enrichment", on_plays("""k AS (SELECT play_id, COUNT(*) AS n, MIN(offense) AS team, MIN(qty) AS quantity FROM copies GROUP BY 1)""", """
SELECT p.play_id, k.n = 1 AND (p.pk % 17 = 0 OR p.pk % 5 <> 0) AS matched, CASE WHEN k.n = 1 AND (p.pk % 17 = 0 OR p.pk % 5 <> 0) THEN quantity END AS quantity FROM plays p JOIN k ON p.play_id = k.play_id"""))
def enrichment(spark, sf):
    side = V.copies(spark, sf).selectExpr("play_id", "case when pk % 17 = 0 then null when pk % 5 = 0 then 'other' else offense end as source_team", "qty as quantity")
    return H.enrich(V.plays(spark, sf).select("play_id", "offense"), side).select("play_id", "matched", "quantity")


@query("jn09_final_labels", on_plays("""
SELECT p.game_id, COUNT(*) FILTER (pk % 23 <> 0) AS joined, COUNT(*) FILTER (pk % 23 = 0) AS rejected, COUNT(*) FILTER (pk % 23 <> 0 AND is_pass) AS passes FROM plays p GROUP BY 1"""))
def final_labels(spark, sf):
    df = V.plays(spark, sf)
    final = df.selectExpr("game_id", "play_id", "if(pk % 23 = 0, 'other', offense) as offense", "is_pass as final_pass")
    t = df.select("game_id", "play_id", "offense").join(final.withColumn("hit", F.lit(1)), ["game_id", "play_id", "offense"], "left")
    return t.groupBy("game_id").agg(F.count("hit").alias("joined"), F.expr("count_if(hit is null) as rejected"), F.expr("count_if(final_pass) as passes"))


@query("set05_rejected_rows", on_plays("SELECT play_id, offense FROM plays WHERE pk % 23 = 0"))
def rejected(spark, sf):
    df = V.plays(spark, sf)
    final = df.selectExpr("play_id", "if(pk % 23 = 0, 'other', offense) as offense")
    return df.select("play_id", "offense").join(final, ["play_id", "offense"], "left_anti")


@query("jn07_charting", on_plays("""
SELECT play_id, CASE WHEN pk % 9 = 0 THEN 'missing' WHEN pk % 10 = 0 THEN 'other_week' WHEN pk % 12 >= 6 THEN 'changed' ELSE 'ok' END AS status FROM plays"""))
def charting(spark, sf):
    df = V.plays(spark, sf)
    chart = df.filter("pk % 9 <> 0").selectExpr("game_id", "play_id", "season as c_season", "week + if(pk % 10 = 0, 1, 0) as c_week", "pk % 12 < 6 as motion")
    t = df.join(chart, ["game_id", "play_id"], "left")
    return t.selectExpr("play_id", "case when c_season is null then 'missing' when c_season <> season or c_week <> week then 'other_week' when not motion then 'changed' else 'ok' end as status")
