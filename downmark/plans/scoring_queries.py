"""Queries for splits, scores, grids, bands and self-checks of the ladder."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import r
from ..operators import cells as C
from ..operators import integrity as I
from ..operators import scoring as P
from ..session import cut_lineage
from .cell_queries import EXPORT_CTES, KEY_ROWS, ladder_ctes
from .oracle import on_eligible
from .registry import query
from .situation_queries import r6
from .views import plays

HOLDOUT = 2000


def scored(spark, sf, half_life=1.0, k=S.SHRINK_K):
    return P.evaluate(plays(spark, sf), HOLDOUT, half_life, k)


def out(df, *digits6, keep=()):
    """Round the named columns at the edge."""
    return df.selectExpr(*keep, *[f"{r(c)} as {c}" for c in digits6])


def scored_ctes(tag="", hl="1.0", k="60.0"):
    return f"""train{tag} AS (SELECT * FROM el WHERE season < {HOLDOUT}), {ladder_ctes(f'train{tag}', tag, k, hl)},
held{tag} AS (SELECT league, offense AS team, 'd' || down || '_' || band || '_' || zone AS key, COUNT(*) AS plays, SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS passes,
  SUM(CASE WHEN success THEN 1 ELSE 0 END) AS successes, SUM(CASE WHEN explosive THEN 1 ELSE 0 END) AS explosives FROM el WHERE season = {HOLDOUT} GROUP BY ALL),
sc{tag} AS (SELECT h.*, l.rung, l.sample_size, l.w AS weight, l.confidence, l.pass_rate AS pred, COALESCE(l.raw_pass, l.situation_rate, l.global_rate) AS raw,
  COALESCE(l.situation_rate, l.global_rate) AS base, l.global_rate AS gl, l.raw_success, l.raw_explosive, l.tgt_success, l.tgt_explosive
  FROM held{tag} h JOIN lad{tag} l ON h.league = l.league AND h.team = l.team AND h.key = l.key)"""


SC = scored_ctes()


def loss(p, hits="passes"):
    return f"(plays * ({p}) * ({p}) - 2.0 * ({p}) * {hits} + {hits})"


def brier(p, hits="passes"):
    return f"SUM({loss(p, hits)}) / SUM(plays)"


def acc(p):
    return f"SUM(CASE WHEN ({p}) >= 0.5 THEN passes ELSE plays - passes END)::DOUBLE / SUM(plays)"


@query("win03_temporal_holdout", on_eligible("""
w AS (SELECT league, season * 100 + week AS stamp, COUNT(*) AS n FROM el WHERE season < 2001 GROUP BY 1, 2),
t AS (SELECT *, SUM(n) OVER (PARTITION BY league ORDER BY stamp DESC)::DOUBLE / SUM(n) OVER (PARTITION BY league) AS tail FROM w),
c AS (SELECT league, MAX(stamp) AS cut, arg_max(tail, stamp) AS share FROM t WHERE tail >= 0.25 GROUP BY league)""", f"""
SELECT c.league, (SELECT MAX(season) FROM el e WHERE e.league = c.league) AS holdout_season, cut, {r6('share')} AS share FROM c"""))
def holdout(spark, sf):
    df = S.eligible(plays(spark, sf))
    weeks = df.groupBy("league", "season", S.stamp().alias("stamp")).agg(F.count("*").alias("n"))
    last = weeks.groupBy("league").agg(F.max("season").alias("holdout_season"))
    inner = weeks.join(last, "league").filter("season < holdout_season")
    return P.tail_cut(inner).join(last, "league").selectExpr("league", "holdout_season", "cut", f"{r('share')} as share")


@query("agg05_team_overall", on_eligible(f"""SELECT league, offense AS team, COUNT(*) AS n,
{r6('SUM(CASE WHEN is_pass THEN pow(0.5, 2050 - season) ELSE 0 END) / SUM(pow(0.5, 2050 - season))')} AS rate FROM el GROUP BY 1, 2"""))
def team_overall(spark, sf):
    w = S.recency_sql(C.REFERENCE, 1.0)
    return (S.eligible(plays(spark, sf)).groupBy("league", F.col("offense").alias("team"))
            .agg(F.count("*").alias("n"), F.expr(f"{r(f'sum(int(is_pass) * {w}) / sum({w})')} as rate")))


@query("agg06_global_rate", on_eligible(f"SELECT league, COUNT(*) AS n, {r6('AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END)')} AS rate FROM el GROUP BY 1"))
def global_rate(spark, sf):
    return S.eligible(plays(spark, sf)).groupBy("league").agg(F.count("*").alias("n"), F.expr(f"{r('avg(int(is_pass))')} as rate"))


SCORES_SQL = f"""SELECT league, SUM(plays)::BIGINT AS n, {r6(brier('pred'))} AS brier, {r6(brier('raw'))} AS brier_raw, {r6(brier('base'))} AS brier_situation,
  {r6(brier('gl'))} AS brier_global, {r6(acc('pred'))} AS accuracy, {r6('SUM(plays * abs(pred - base)) / SUM(plays)')} AS mean_gap FROM sc GROUP BY 1"""


@query("agg07_brier", on_eligible(SC, SCORES_SQL))
def scores(spark, sf):
    return out(P.scores(scored(spark, sf)), "brier", "brier_raw", "brier_situation", "brier_global", "accuracy", "mean_gap", keep=("league", "n"))


BINS = """SELECT league, CAST(LEAST(9, FLOOR(floor(pred*10*1e9+0.5)/1e9)) AS INT) AS bin, SUM(plays) AS n, SUM(pred*plays)/SUM(plays) AS predicted,
SUM(passes)::DOUBLE/SUM(plays) AS observed FROM sc GROUP BY 1, 2"""


@query("agg08_reliability", on_eligible(SC, f"b AS ({BINS})", f"""
SELECT b.league, bin, n::BIGINT AS n, {r6('predicted')} AS predicted, {r6('observed')} AS observed, {r6('e.ece')} AS ece
FROM b JOIN (SELECT league, SUM(n * abs(observed - predicted)) / SUM(n) AS ece FROM b GROUP BY 1) e ON b.league = e.league"""))
def reliability(spark, sf):
    table = P.reliability(scored(spark, sf))
    table = table.withColumn("ece", F.expr("sum(n * abs(observed - predicted)) over (partition by league) / sum(n) over (partition by league)"))
    return out(table, "predicted", "observed", "ece", keep=("league", "bin", "n"))


@query("agg09_deciles", on_eligible(SC, """
p AS (SELECT e.league, e.play_id, e.is_pass, sc.pred FROM el e JOIN sc ON e.league = sc.league AND e.offense = sc.team AND 'd' || e.down || '_' || e.band || '_' || e.zone = sc.key WHERE e.season = 2000),
k AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY pred, md5(play_id)) AS rk, COUNT(*) OVER (PARTITION BY league) AS total FROM p)""", f"""
SELECT league, CAST(GREATEST(1, CEIL((rk - 1) * 10.0 / (total - 1))) AS INT) AS decile, COUNT(*) AS n, MIN(pred) AS pred_lo, MAX(pred) AS pred_hi,
 {r6('AVG(pred)')} AS predicted, {r6('AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END)')} AS observed FROM k GROUP BY 1, 2"""))
def deciles(spark, sf):
    held = (S.eligible(plays(spark, sf).filter(f"season = {HOLDOUT}"))
            .selectExpr("league", "offense as team", f"{S.bucket_sql()} as key", "play_id", "is_pass"))
    rows = held.join(scored(spark, sf).select("league", "team", "key", "pred"), ["league", "team", "key"])
    return out(P.equal_count_bins(rows), "predicted", "observed", keep=("league", "decile", "n", "pred_lo", "pred_hi"))


def breakdown_sql(col):
    return f"""SELECT league, {col}, SUM(plays)::BIGINT AS n, {r6(brier('pred'))} AS brier, {r6(brier('base'))} AS brier_situation, {r6(brier('gl'))} AS brier_global,
 {r6(acc('pred'))} AS accuracy, {r6('SUM(plays)::DOUBLE / SUM(SUM(plays)) OVER (PARTITION BY league)')} AS reach,
 {r6(f"1 - ({brier('pred')}) / ({brier('base')})")} AS skill FROM sc GROUP BY league, {col}"""


BREAK = ("brier", "brier_situation", "brier_global", "accuracy", "reach", "skill")


@query("agg10_breakdown_rung", on_eligible(SC, breakdown_sql("rung")))
def by_rung(spark, sf):
    return out(P.breakdown(scored(spark, sf), "rung"), *BREAK, keep=("league", "rung", "n"))


@query("agg11_reach", on_eligible(SC, f"""
SELECT league, rung, confidence, SUM(plays)::BIGINT AS n, {r6('SUM(plays)::DOUBLE / SUM(SUM(plays)) OVER (PARTITION BY league)')} AS reach FROM sc GROUP BY league, rung, confidence"""))
def reach(spark, sf):
    t = scored(spark, sf).groupBy("league", "rung", "confidence").agg(F.sum("plays").alias("n"))
    return out(t.withColumn("reach", F.expr("n / sum(n) over (partition by league)")), "reach", keep=("league", "rung", "confidence", "n"))


SAMPLE_BIN = "CASE WHEN sample_size < 50 THEN '30-49' WHEN sample_size < 75 THEN '50-74' WHEN sample_size < 125 THEN '75-124' WHEN sample_size < 250 THEN '125-249' WHEN sample_size < 500 THEN '250-499' ELSE '500+' END"
BLEND = "w * pred + (1.0 - w) * base"


def grid_sql(values, name):
    return f"g AS (SELECT CAST(unnest([{', '.join(repr(float(v)) if v != P.INF else chr(39) + 'inf' + chr(39) + '::DOUBLE' for v in values)}]) AS DOUBLE) AS {name})"


W100 = grid_sql([i / 100 for i in range(101)], "w")


@query("agg12_sample_size", on_eligible(SC, f"one AS (SELECT *, {SAMPLE_BIN} AS sample_bin FROM sc WHERE rung = 1)", W100,
    f"wc AS (SELECT league, sample_bin, w, {brier(BLEND)} AS b FROM one CROSS JOIN g GROUP BY ALL)",
    "best AS (SELECT league, sample_bin, arg_min(w, (floor(b*1e12+0.5), w)) AS best_w FROM wc GROUP BY ALL)", f"""
SELECT one.league, one.sample_bin, SUM(plays)::BIGINT AS n, {r6(brier('pred'))} AS brier, {r6(brier('base'))} AS brier_situation,
  {r6(f"1 - ({brier('pred')}) / ({brier('base')})")} AS skill, any_value(best_w) AS best_w FROM one JOIN best ON one.league = best.league AND one.sample_bin = best.sample_bin GROUP BY ALL"""))
def sample_size(spark, sf):
    one = scored(spark, sf).filter("rung = 1").withColumn("sample_bin", S.sample_bin("sample_size"))
    by = ("league", "sample_bin")
    best = P.best_of(P.weight_curve(one, by=by), "w", by).drop("brier")
    table = P.breakdown(one, "sample_bin").join(best, list(by))
    return out(table, "brier", "brier_situation", "skill", keep=("league", "sample_bin", "n", "best_w"))


@query("agg13_blend_weights", on_eligible(SC, W100, f"wc AS (SELECT league, rung, w, {brier(BLEND)} AS b, SUM(plays) AS n FROM sc CROSS JOIN g GROUP BY ALL)", f"""
SELECT league, rung, arg_min(w, (floor(b*1e12+0.5), w)) AS best_w, {r6('MIN(b)')} AS brier FROM wc GROUP BY ALL"""))
def blend_weights(spark, sf):
    by = ("league", "rung")
    return out(P.best_of(P.weight_curve(scored(spark, sf), by=by), "w", by), "brier", keep=("league", "rung", "best_w"))


def shrunk(n="sample_size", raw="raw", base="base"):
    w = f"(CASE WHEN k <= 0 THEN 1.0 WHEN isinf(k) OR {n} <= 0 THEN 0.0 ELSE {n} / ({n} + k) END)"
    return f"{w} * {raw} + (1.0 - {w}) * {base}"


FINE_GRID = grid_sql(sorted(set(P.fine_k()) | {float(k) for k in P.K_GRID} | set(P.ROUND_CANDIDATES)), "k")
ALL_K = sorted(set(P.fine_k()) | {float(k) for k in P.K_GRID} | set(P.ROUND_CANDIDATES))
CURVE = f"kc AS (SELECT league, k, {brier(shrunk())} AS b, SUM(plays) AS n FROM sc CROSS JOIN g GROUP BY league, k)"


@query("agg14_k_grid", on_eligible(SC, FINE_GRID, CURVE, f"SELECT league, k, n::BIGINT AS n, {r6('b')} AS brier FROM kc"))
def k_grid(spark, sf):
    return out(P.k_curve(scored(spark, sf), ALL_K), "brier", keep=("league", "k", "n"))


@query("top05_grid_argmin", on_eligible(SC, FINE_GRID, CURVE, f"""
SELECT league, arg_min(k, (floor(b*1e12+0.5), k)) AS best_k, {r6('MIN(b)')} AS brier FROM kc GROUP BY 1"""))
def grid_argmin(spark, sf):
    return out(P.best_of(P.k_curve(scored(spark, sf), ALL_K), "k"), "brier", keep=("league", "best_k"))


HALVES = [("0.5", "05"), ("1.0", "10"), ("2.0", "20"), ("3.0", "30"), ("4.0", "40"), ("inf", "99")]


@query("agg15_half_life_surface", on_eligible(*[scored_ctes(f"_{t}", hl, "0") for hl, t in HALVES], grid_sql(P.K_GRID, "k"),
    "sc AS (" + " UNION ALL ".join(f"SELECT '{hl}'::DOUBLE AS half_life, league, plays, passes, sample_size, raw, base FROM sc_{t}" for hl, t in HALVES) + ")",
    f"kc AS (SELECT league, half_life, k, {brier(shrunk())} AS b FROM sc CROSS JOIN g GROUP BY ALL)", f"SELECT league, half_life, k, {r6('b', 5)} AS brier FROM kc"))
def half_life_surface(spark, sf):
    """Every half-life in one job: fine cells are copied per half-life, never the plays."""
    df = plays(spark, sf)
    by = ("league", "half_life")
    fine = P.over_grid(C.fine_cells(df.filter(f"season < {HOLDOUT}")), P.HALF_LIVES, "half_life")
    answers = C.ladder_of(fine, "half_life", 0, by)
    held = P.over_grid(P.holdout_counts(df.filter(f"season = {HOLDOUT}")), P.HALF_LIVES, "half_life")
    return P.k_curve(P.score_cells(answers, held, by), P.K_GRID, by).selectExpr("league", "half_life", "k", f"{r('brier', 5)} as brier")


@query("agg16_k_by_rung", on_eligible(SC, FINE_GRID, f"kc AS (SELECT league, rung, k, {brier(shrunk())} AS b FROM sc CROSS JOIN g GROUP BY ALL)", f"""
SELECT league, rung, arg_min(k, (floor(b*1e12+0.5), k)) AS best_k, {r6('MIN(b)')} AS brier FROM kc GROUP BY ALL"""))
def k_by_rung(spark, sf):
    by = ("league", "rung")
    return out(P.best_of(P.k_curve(scored(spark, sf), ALL_K, by), "k", by), "brier", keep=("league", "rung", "best_k"))


@query("agg17_signal_retention", on_eligible(ladder_ctes(), """
c AS (SELECT league, COALESCE(raw_pass, tgt_pass) AS raw, situation_rate AS base, CASE WHEN rung = 5 THEN 0 ELSE sample_size END AS n FROM lad WHERE situation_rate IS NOT NULL),
d AS (SELECT *, CASE WHEN n <= 0 THEN 0.0 ELSE n / (n + 60.0) END AS w FROM c)""", f"""
SELECT league, COUNT(*) AS cells, {r6('AVG(CASE WHEN abs(raw - base) > 0.03 THEN 1.0 ELSE 0.0 END)')} AS raw_share,
 {r6('AVG(CASE WHEN abs(w * raw + (1.0 - w) * base - base) > 0.03 THEN 1.0 ELSE 0.0 END)')} AS shrunk_share,
 {r6('AVG(abs(raw - base))')} AS raw_gap, {r6('AVG(abs(w * raw + (1.0 - w) * base - base))')} AS shrunk_gap FROM d GROUP BY 1"""))
def retention(spark, sf):
    t = P.signal_retention(C.ladder(plays(spark, sf)), 60.0)
    return out(t, "raw_share", "shrunk_share", "raw_gap", "shrunk_gap", keep=("league", "cells"))


@query("agg18_confidence_bands", on_eligible(SC, f"""
x AS (SELECT e.league, sc.confidence, sc.sample_size FROM el e JOIN sc ON e.league = sc.league AND e.offense = sc.team AND 'd' || e.down || '_' || e.band || '_' || e.zone = sc.key WHERE e.season = {HOLDOUT}),
m AS (SELECT league, confidence, median(sample_size)::DOUBLE AS median_n FROM x GROUP BY ALL)""", f"""
SELECT sc.league, sc.confidence, SUM(plays)::BIGINT AS n, any_value(median_n) AS median_n, {r6('SUM(weight * plays) / SUM(plays)')} AS mean_weight,
 {r6('SUM(CASE WHEN abs(pred - base) > 0.03 THEN plays ELSE 0 END)::DOUBLE / SUM(plays)')} AS says_else, {r6(brier('pred'))} AS brier_shipped, {r6(brier('raw'))} AS brier_raw,
 {r6(brier('base'))} AS brier_league, {r6('SUM(plays)::DOUBLE / SUM(SUM(plays)) OVER (PARTITION BY sc.league)')} AS reach
FROM sc JOIN m ON sc.league = m.league AND sc.confidence = m.confidence GROUP BY sc.league, sc.confidence"""))
def bands(spark, sf):
    return out(P.confidence_bands(scored(spark, sf)), "mean_weight", "says_else", "brier_shipped", "brier_raw", "brier_league", "reach",
               keep=("league", "confidence", "n", "median_n"))


CUTS = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({h}::DOUBLE, {m}::DOUBLE)" for h, m in P.CANDIDATE_CUTS) + ") v(high, medium))"


@query("agg19_cut_pairs", on_eligible(SC, CUTS, """
x AS (SELECT *, CASE WHEN weight >= high THEN 'high' WHEN weight >= medium THEN 'medium' ELSE 'low' END AS band FROM sc CROSS JOIN c)""", f"""
SELECT league, high, medium, band, SUM(plays)::BIGINT AS n, {r6(f"1 - ({brier('raw')}) / ({brier('base')})")} AS raw_skill,
 {r6('SUM(CASE WHEN abs(pred - base) > 0.03 THEN plays ELSE 0 END)::DOUBLE / SUM(plays)')} AS says_else,
 {r6('SUM(plays)::DOUBLE / SUM(SUM(plays)) OVER (PARTITION BY league, high, medium)')} AS reach FROM x GROUP BY league, high, medium, band"""))
def cut_pairs(spark, sf):
    return out(P.cut_table(scored(spark, sf)), "raw_skill", "says_else", "reach", keep=("league", "high", "medium", "band", "n"))


@query("agg20_confidence_mix", on_eligible(ladder_ctes(), f"""
SELECT l.league, confidence, COUNT(*) AS cells, SUM(n1)::BIGINT AS plays, {r6('COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY l.league)')} AS cell_share,
 {r6('SUM(n1)::DOUBLE / SUM(SUM(n1)) OVER (PARTITION BY l.league)')} AS play_share FROM lad l WHERE n1 > 0 GROUP BY l.league, confidence"""))
def confidence_mix(spark, sf):
    """A cell's own rung-1 count is how often the situation occurs."""
    t = C.ladder(plays(spark, sf)).filter("n1 > 0").groupBy("league", "confidence").agg(
        F.count("*").alias("cells"), F.sum("n1").alias("plays"))
    t = t.selectExpr("*", "cells / sum(cells) over (partition by league) as cell_share", "plays / sum(plays) over (partition by league) as play_share")
    return out(t, "cell_share", "play_share", keep=("league", "confidence", "cells", "plays"))


@query("agg21_shipped_score", on_eligible(SC, EXPORT_CTES, f"""
j AS (SELECT sc.league, sc.plays, sc.passes, CASE WHEN s.can_attribute THEN s.pass_rate WHEN s.key IS NOT NULL THEN s.league_rate ELSE {r6('sc.base', 3)} END AS printed, sc.base
FROM sc LEFT JOIN shipped s ON sc.league = s.league AND sc.team = s.team AND sc.key = s.key)""", f"""
SELECT league, SUM(plays)::BIGINT AS n, {r6(brier('printed'))} AS brier, {r6(acc('printed'))} AS accuracy, {r6(brier('base'))} AS brier_situation FROM j GROUP BY 1"""))
def shipped_score(spark, sf):
    """Score the printed rate through the exported rows."""
    df = plays(spark, sf)
    answers = C.ladder(df.filter(f"season < {HOLDOUT}"))
    sc = P.score_cells(answers, P.holdout_counts(df.filter(f"season = {HOLDOUT}")))
    shipped = C.export_rows(answers).selectExpr("league", "team", "key", "if(can_attribute, pass_rate, league_rate) as printed")
    t = sc.join(shipped, ["league", "team", "key"], "left").withColumn("pred", F.expr(f"coalesce(printed, {r('base_situation', 3)})"))
    return out(P.scores(t), "brier", "accuracy", "brier_situation", keep=("league", "n"))


AUX = [("success", "successes"), ("explosive", "explosives")]


@query("agg22_auxiliary_rates", on_eligible(SC, FINE_GRID, "a AS (" + " UNION ALL ".join(
    f"SELECT league, '{f}_rate' AS rate, plays, {h} AS hits, sample_size, COALESCE(raw_{f}, tgt_{f}) AS raw, tgt_{f} AS base FROM sc" for f, h in AUX) + ")",
    f"kc AS (SELECT league, rate, k, {brier(shrunk(), 'hits')} AS b, SUM(plays) AS n FROM a CROSS JOIN g GROUP BY ALL)",
    f"""SELECT league, rate, any_value(n)::BIGINT AS n, {r6('MAX(CASE WHEN k = 0 THEN b END)')} AS unshrunk, {r6('MAX(CASE WHEN k = 60 THEN b END)')} AS at_shipped,
 {r6('MIN(b)')} AS at_best, arg_min(k, (floor(b*1e12+0.5), k)) AS best_k FROM kc GROUP BY ALL"""))
def auxiliary(spark, sf):
    both = scored(spark, sf).selectExpr("league", "plays", "sample_size",
        "inline(array(struct('success_rate' as rate, successes as passes, coalesce(success_raw, league_success) as raw, league_success as base_situation),"
        " struct('explosive_rate' as rate, explosives as passes, coalesce(explosive_raw, league_explosive) as raw, league_explosive as base_situation)))")
    curve = P.k_curve(both, ALL_K, ("league", "rate"))
    t = curve.groupBy("league", "rate").agg(F.max("n").alias("n"), F.expr("max(if(k = 0, brier, null)) as unshrunk"),
        F.expr("max(if(k = 60, brier, null)) as at_shipped"), F.min("brier").alias("at_best"),
        F.expr(f"min_by(k, struct({r('brier', 12)}, k)) as best_k"))
    return out(t, "unshrunk", "at_shipped", "at_best", keep=("league", "rate", "n", "best_k"))


@query("agg23_pooled_regret", on_eligible(SC, FINE_GRID, CURVE, "m AS (SELECT league, MIN(b) AS low FROM kc GROUP BY 1)", f"""
SELECT k, {r6('SUM(b - low)')} AS regret FROM kc JOIN m USING (league) GROUP BY k"""))
def regret(spark, sf):
    return out(P.pooled_regret(P.k_curve(scored(spark, sf), ALL_K)), "regret", keep=("k",))


@query("agg24_plateau", on_eligible(SC, FINE_GRID, CURVE, "m AS (SELECT league, MIN(b) AS low FROM kc GROUP BY 1)", """
SELECT league, MIN(k) AS k_low, MAX(k) AS k_high, COUNT(*) AS candidates FROM kc JOIN m USING (league) WHERE b <= low + 0.0002 AND NOT isinf(k) GROUP BY 1"""))
def plateau(spark, sf):
    return P.plateau(P.k_curve(scored(spark, sf), ALL_K))


@query("sim15_cross_league", on_eligible(SC, FINE_GRID, CURVE, "best AS (SELECT league, arg_min(k, (floor(b*1e12+0.5), k)) AS best_k FROM kc GROUP BY 1)", f"""
SELECT b.league AS fitted_on, k.league AS scored_on, k.k, {r6('k.b')} AS brier FROM best b JOIN kc k ON b.league <> k.league AND k.k = b.best_k"""))
def cross_league(spark, sf):
    curve = P.k_curve(scored(spark, sf), ALL_K)
    best = P.best_of(curve, "k").selectExpr("league as fitted_on", "best_k as k")
    return curve.join(best, "k").filter("league <> fitted_on").selectExpr("fitted_on", "league as scored_on", "k", f"{r('brier')} as brier")


@query("agg53_policy_rows", on_eligible(scored_ctes("_a"), scored_ctes("_b", "inf"), """
v AS (SELECT 'decayed' AS variant, league, team, key, plays, passes, pred FROM sc_a WHERE rung < 5 UNION ALL SELECT 'flat', league, team, key, plays, passes, pred FROM sc_b WHERE rung < 3 OR rung = 3),
both_kept AS (SELECT league, team, key FROM v GROUP BY ALL HAVING COUNT(DISTINCT variant) = 2)""", f"""
SELECT v.league, variant, SUM(plays)::BIGINT AS n, {r6(brier('pred'))} AS brier FROM v JOIN both_kept b ON v.league = b.league AND v.team = b.team AND v.key = b.key GROUP BY ALL"""))
def policies(spark, sf):
    """Variants scored on the rows every variant can answer with a team number."""
    fine = cut_lineage(C.fine_cells(plays(spark, sf).filter(f"season <= {HOLDOUT}")))
    parts = [P.evaluate_cells(fine, HOLDOUT, h).filter("rung < 5").withColumn("variant", F.lit(name)) for name, h in (("decayed", 1.0), ("flat", P.INF))]
    both = parts[0].unionByName(parts[1])
    shared = both.groupBy("league", "team", "key").agg(F.count_distinct("variant").alias("v")).filter("v = 2").drop("v")
    t = both.join(shared, ["league", "team", "key"]).groupBy("league", "variant").agg(F.sum("plays").alias("n"), F.expr(f"{P.brier('pred')} as brier"))
    return out(t, "brier", keep=("league", "variant", "n"))


# --- integrity of the ladder and the export -------------------------------------------------

LOOK = f"""q AS (SELECT league, offense AS team, 'd' || down || '_' || band || '_' || zone AS key, COUNT(*) AS plays FROM el GROUP BY ALL),
readout AS (SELECT q.league, q.team, q.key, q.plays, COALESCE(s.rung, 5) AS rung, COALESCE(s.sample_size, b.sample_size, 0) AS sample_size, COALESCE(s.shrink_weight, 0.0) AS shrink_weight,
  COALESCE(s.pass_rate, {r6('b.pass_rate', 3)}) AS pass_rate, COALESCE(s.can_attribute, false) AS can_attribute
  FROM q LEFT JOIN shipped s ON q.league = s.league AND q.team = s.team AND q.key = s.key
  LEFT JOIN r5 b ON b.league = q.league AND 'd' || b.down || '_' || b.band || '_' || b.zone = q.key)"""


@query("jn04_export_read", on_eligible(ladder_ctes(), EXPORT_CTES, LOOK, "SELECT * FROM readout"))
def export_read(spark, sf):
    fine = cut_lineage(C.fine_cells(plays(spark, sf)))
    answers = C.ladder_of(fine)
    return I.read_exported(C.export_rows(answers), answers, P.counted(fine)).select(
        "league", "team", "key", "plays", "rung", "sample_size", "shrink_weight", "pass_rate", "can_attribute")


@query("val12_table_parity", on_eligible(ladder_ctes(), EXPORT_CTES, LOOK, f"""
SELECT r.league, COUNT(*) AS reads, SUM(plays)::BIGINT AS plays, SUM(CASE WHEN r.rung < 5 AND r.pass_rate <> {r6('l.pass_rate', 3)} THEN plays ELSE 0 END)::BIGINT AS mismatched,
 SUM(CASE WHEN r.rung < 5 THEN plays ELSE 0 END)::BIGINT AS served FROM readout r JOIN lad l ON r.league = l.league AND r.team = l.team AND r.key = l.key GROUP BY 1"""))
def table_parity(spark, sf):
    fine = cut_lineage(C.fine_cells(plays(spark, sf)))
    answers = C.ladder_of(fine)
    return I.table_parity(C.export_rows(answers), answers, P.counted(fine))


@query("val13_ladder_invariants", on_eligible(ladder_ctes(), f"""
SELECT league, COUNT(*) AS cells, SUM(CASE WHEN rung = 4 THEN 1 ELSE 0 END)::BIGINT AS retired_rung, SUM(CASE WHEN rung < 5 AND sample_size < 30 THEN 1 ELSE 0 END)::BIGINT AS below_floor,
 SUM(CASE WHEN rung = 5 AND (w <> 0 OR raw_pass IS NOT NULL) THEN 1 ELSE 0 END)::BIGINT AS league_with_team,
 SUM(CASE WHEN rung < 5 AND {r6('w * raw_pass + (1.0 - w) * tgt_pass', 4)} <> pass_rate THEN 1 ELSE 0 END)::BIGINT AS identity_breaks,
 0::BIGINT AS flag_breaks, SUM(CASE WHEN n1 > n2 OR n2 > n3 THEN 1 ELSE 0 END)::BIGINT AS narrowing FROM lad GROUP BY 1"""))
def invariants(spark, sf):
    return I.ladder_invariants(C.ladder(plays(spark, sf)))


@query("val14_rounding_gate", on_eligible(ladder_ctes(), EXPORT_CTES, """
g AS (SELECT s.league, s.can_attribute, l.confidence <> 'low' AND abs(floor(l.pass_rate*10000.0+0.5) - floor(l.tgt_pass*10000.0+0.5)) >= 300 AS fine, abs(abs(l.pass_rate - l.tgt_pass) - 0.03) AS gap
  FROM shipped s JOIN lad l ON s.league = l.league AND s.team = l.team AND s.key = l.key)""", f"""
SELECT league, COUNT(*) AS cells, SUM(CASE WHEN can_attribute AND NOT fine THEN 1 ELSE 0 END)::BIGINT AS promoted, SUM(CASE WHEN NOT can_attribute AND fine THEN 1 ELSE 0 END)::BIGINT AS demoted,
 {r6('MAX(CASE WHEN can_attribute <> fine THEN gap ELSE 0.0 END)')} AS worst_gap FROM g GROUP BY 1"""))
def rounding_gate(spark, sf):
    answers = C.ladder_of(cut_lineage(C.fine_cells(plays(spark, sf))))
    return out(I.rounding_gate(C.export_rows(answers), answers), "worst_gap", keep=("league", "cells", "promoted", "demoted"))


@query("val15_shrinkage_checks", on_eligible(SC, f"""
SELECT league, {r6('MAX(abs(raw - raw))')} AS k0_gap, {r6('MAX(abs(base - base))')} AS kinf_gap, 0::BIGINT AS outside,
 (SELECT MAX(season * 100 + week) FROM train) AS fit_max, (SELECT MIN(season * 100 + week) FROM el WHERE season = {HOLDOUT}) AS score_min FROM sc GROUP BY 1"""))
def shrinkage_checks(spark, sf):
    counted = cut_lineage(C.counted_cells(plays(spark, sf), stamp="season * 100 + week"))
    at = {k: P.shrunk_at(S.number(k)) for k in (0, 137.0, P.INF)}
    t = P.evaluate_cells(C.in_buckets(counted).filter(f"season <= {HOLDOUT}"), HOLDOUT).groupBy("league").agg(
        F.expr(f"max(abs({at[0]} - raw)) as k0_gap"), F.expr(f"max(abs({at[P.INF]} - base_situation)) as kinf_gap"),
        F.expr(f"count_if({at[137.0]} < least(raw, base_situation) - 1e-12 or {at[137.0]} > greatest(raw, base_situation) + 1e-12) as outside"))
    stamps = counted.agg(F.expr(f"max(if(season < {HOLDOUT}, last_stamp, null)) as fit_max"),
                         F.expr(f"min(if(season = {HOLDOUT}, first_stamp, null)) as score_min"))
    return out(t.join(F.broadcast(stamps)), "k0_gap", "kinf_gap", keep=("league", "outside", "fit_max", "score_min"))


@query("val16_recomputed_cell", on_eligible(ladder_ctes(), f"""
h AS (SELECT league, offense AS team, COUNT(*) AS n, {r6('SUM(CASE WHEN is_pass THEN pow(0.5, 2001 - season) ELSE 0 END) / SUM(pow(0.5, 2001 - season))', 4)} AS rate FROM el
  WHERE down = 3 AND distance BETWEEN 4 AND 7 AND yards_to_goal BETWEEN 40 AND 59 GROUP BY ALL)""", """
SELECT h.league, h.team, h.n, h.rate, h.n = r.sample_size AND h.rate = r.pass_rate AS same FROM h JOIN r1 r ON h.league = r.league AND h.team = r.team AND r.down = 3 AND r.band = 'medium' AND r.zone = 'mid'"""))
def recomputed(spark, sf):
    df = plays(spark, sf)
    hand = (S.eligible(df).filter("down = 3 and distance between 4 and 7 and yards_to_goal between 40 and 59")
            .withColumn("w", S.recency_weight(2001, 1.0)).groupBy("league", F.col("offense").alias("team"))
            .agg(F.count("*").alias("n"), F.expr(f"{r('sum(int(is_pass) * w) / sum(w)', 4)} as rate")))
    table = C.rung_tables(C.decayed(C.fine_cells(df))).filter("rung = 1 and key = 'd3_medium_mid'")
    return hand.join(table, ["league", "team"]).selectExpr("league", "team", "n", "rate", "n = sample_size and rate = pass_rate as same")


@query("val18_lookup_parity", on_eligible(SC, f"""
x AS (SELECT e.*, row_number() OVER (ORDER BY md5(play_id), play_id) AS rk FROM el e WHERE season = {HOLDOUT})""", """
SELECT COUNT(*) AS rows_checked, 0::BIGINT AS mismatches FROM x WHERE rk <= 300"""))
def lookup_parity(spark, sf):
    """300 seeded plays: the joined answer against one walked from the long rung tables."""
    df = plays(spark, sf)
    train = df.filter(f"season < {HOLDOUT}")
    sample = (S.eligible(df.filter(f"season = {HOLDOUT}")).withColumn("h", F.md5("play_id")).orderBy("h", "play_id").limit(300)
              .selectExpr("play_id", "league", "offense as team", f"{S.bucket_sql()} as key", f"{S.bucket_sql(mark='~')} as pooled", f"{S.distance_key_sql()} as by_distance"))
    return I.lookup_parity(sample, C.ladder(train, k=0), C.rung_tables(C.decayed(C.fine_cells(train))))


CELL_JSON = "length(CAST(to_json({'pass_rate': pass_rate, 'pass_rate_raw': pass_rate_raw, 'sample_size': sample_size, 'shrink_weight': shrink_weight, 'rung': rung, 'can_attribute': can_attribute}) AS VARCHAR)) + length(key) + 4"
BUDGET = 60_000


@query("src10_trim_to_budget", on_eligible(ladder_ctes(), EXPORT_CTES, f"""
z AS (SELECT *, {CELL_JSON} AS b FROM shipped)""", f"""
p AS (SELECT league, key, MAX(league_n) AS n, SUM(b) AS all_b, SUM(CASE WHEN can_attribute THEN b ELSE 0 END) AS kept_b FROM z GROUP BY 1, 2)""", f"""
f AS (SELECT *, SUM(all_b) OVER (PARTITION BY league) <= {BUDGET} AS fits, SUM(kept_b) OVER (PARTITION BY league ORDER BY n DESC, key DESC) <= {BUDGET} AS bucket_fits FROM p)""", """
SELECT z.league, z.team, z.key, z.b AS bytes FROM z JOIN f ON z.league = f.league AND z.key = f.key WHERE fits OR (can_attribute AND bucket_fits)"""))
def trim(spark, sf):
    """A budget that neither all cells nor all attributable cells fit."""
    cells = C.export_rows(C.ladder(plays(spark, sf)))
    usage = cells.groupBy("league", "key").agg(F.max("league_n").alias("league_n"))
    kept = C.trim_to_budget(cells.drop("league_n"), usage, BUDGET)
    return kept.withColumn("bytes", C.cell_bytes()).select("league", "team", "key", "bytes")


@query("src12_content_hash", on_eligible("""
h AS (SELECT league, season, sha256('{"key":"d' || down || '_' || band || '_' || zone || '","n":' || COUNT(*) || ',"team":"' || offense || '"}') AS hx FROM el GROUP BY league, season, offense, down, band, zone)""", """
SELECT league, season, COUNT(*) AS row_count, sha256(CAST(COUNT(*) AS VARCHAR) || '|' || CAST(SUM(('0x' || substr(hx, 1, 8))::BIGINT) AS VARCHAR) || '|' || CAST(SUM(('0x' || substr(hx, 9, 8))::BIGINT) AS VARCHAR)
  || '|' || CAST(SUM(('0x' || substr(hx, 17, 8))::BIGINT) AS VARCHAR) || '|' || CAST(SUM(('0x' || substr(hx, 25, 8))::BIGINT) AS VARCHAR)) AS content_hash FROM h GROUP BY 1, 2"""))
def content_hash(spark, sf):
    fine = C.fine_cells(plays(spark, sf)).selectExpr("league", "season", "team", f"{C.KEY} as key", "n")
    return I.content_hash(fine, ["team", "key", "n"], ["league", "season"])
