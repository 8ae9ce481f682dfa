"""Queries for shifts, change points and resampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import situation as S
from ..functions.numbers import r
from ..operators import cells as C
from ..operators import changepoints as CP
from ..operators import resample as RS
from ..operators import scoring as P
from ..operators import shifts as SH
from ..scale import hash_draw
from . import views as V
from .cell_queries import ladder_ctes
from .context_queries import ASSIGN
from .oracle import on_eligible, on_plays
from .registry import query
from .scoring_queries import SC, loss, out, scored
from .situation_queries import r6
from .source_queries import COACH_SQL

PRIMARY = f"""{COACH_SQL},
pcx AS (SELECT school, year, arg_min(struct_pack(coach_id := coach_id, hire_date := hire_date, games := games), (-games, hire_date, coach_id)) AS top, COUNT(*) > 1 AS in_season_change FROM coach_year GROUP BY 1, 2),
pri AS (SELECT school, year, top.coach_id AS coach_id, top.hire_date AS hire_date, top.games AS games, in_season_change FROM pcx),
trans AS (SELECT b.school, b.year, a.coach_id AS prev_coach, b.coach_id, b.coach_id <> a.coach_id AS changed, CASE WHEN b.coach_id = a.coach_id THEN 'none' WHEN b.hire_date < b.year || '-08-01' THEN 'offseason' ELSE 'in_season' END AS change_kind,
  a.in_season_change OR b.in_season_change AS in_season_change FROM pri b JOIN pri a ON a.school = b.school AND a.year + 1 = b.year)"""


def primary(spark, sf):
    return SH.primary_coaches(V.coach_seasons(spark, sf))


@query("win15_primary_coach", f"WITH {PRIMARY} SELECT school, year, coach_id, games, hire_date, in_season_change FROM pri")
def primary_coach(spark, sf):
    return primary(spark, sf).select("school", "year", "coach_id", "games", "hire_date", "in_season_change")


@query("jn12_coach_transition", f"WITH {PRIMARY} SELECT * FROM trans")
def transition(spark, sf):
    return SH.transitions(primary(spark, sf))


TENURE = f"""{PRIMARY}, tn AS (SELECT *, (SELECT MIN(q.year) FROM pri q WHERE q.school = p.school AND q.year <= p.year AND NOT EXISTS (SELECT 1 FROM pri x WHERE x.school = p.school AND x.year BETWEEN q.year AND p.year AND x.coach_id <> p.coach_id)) AS tenure_start FROM pri p)"""


@query("win14_tenure_start", f"WITH {TENURE} SELECT school, year, coach_id, tenure_start FROM tn")
def tenure_start(spark, sf):
    return SH.tenures(primary(spark, sf)).select("school", "year", "coach_id", "tenure_start")


@query("prj38_regime_id", on_plays(TENURE, "SELECT play_id, CASE WHEN tn.school IS NOT NULL THEN tn.school || '#' || tenure_start ELSE offense END AS regime FROM plays p LEFT JOIN tn ON tn.school = p.offense AND tn.year = p.season"))
def regime_id(spark, sf):
    t = SH.tenures(primary(spark, sf)).selectExpr("school as offense", "year as season", "regime")
    return V.plays(spark, sf).join(t, ["offense", "season"], "left").selectExpr("play_id", "coalesce(regime, offense) as regime")


@query("prj39_change_group", f"WITH {TENURE} SELECT school, CASE WHEN tenure_start = 2000 THEN 'changed' WHEN tenure_start = 1999 THEN 'changed_before' ELSE 'continuous' END AS grp FROM tn WHERE year = 2000")
def change_group(spark, sf):
    return SH.tenures(primary(spark, sf)).filter("year = 2000").selectExpr(
        "school", "case when tenure_start = year then 'changed' when tenure_start = year - 1 then 'changed_before' else 'continuous' end as grp")


@query("agg46_turnover", f"WITH {PRIMARY} SELECT year, COUNT(*) AS schools, COUNT(*) FILTER (changed) AS changed, {r6('AVG(CASE WHEN changed THEN 1.0 ELSE 0.0 END)')} AS rate, COUNT(*) FILTER (change_kind = 'offseason') AS offseason FROM trans GROUP BY 1")
def turnover(spark, sf):
    return SH.transitions(primary(spark, sf)).groupBy("year").agg(F.count("*").alias("schools"), F.expr("count_if(changed) as changed"),
        F.expr(f"{r('avg(int(changed))')} as rate"), F.expr("count_if(change_kind = 'offseason') as offseason"))


PAIRS = """bc AS (SELECT offense AS team, season, 'd' || down || '_' || band || '_' || zone AS bucket, COUNT(*) AS n, SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS p FROM el GROUP BY ALL),
pairs AS (SELECT b.team, b.season, b.bucket, a.n AS n_a, a.p AS p_a, b.n AS n_b, b.p AS p_b FROM bc a JOIN bc b ON a.team = b.team AND a.bucket = b.bucket AND b.season = a.season + 1 WHERE a.n >= 10 AND b.n >= 10),
sh AS (SELECT team, season, COUNT(*) AS buckets, SUM(least(n_a, n_b)) AS weight, SUM(least(n_a, n_b) * abs(p_a::DOUBLE / n_a - p_b::DOUBLE / n_b)) / SUM(least(n_a, n_b)) AS shift FROM pairs GROUP BY 1, 2 HAVING SUM(least(n_a, n_b)) >= 100)"""


def pairs(spark, sf, floor=10):
    return SH.season_pairs(SH.bucket_counts(C.fine_cells(V.plays(spark, sf))), floor)


@query("jn11_season_pairs", on_eligible(PAIRS, "SELECT team, season, bucket, n_a, p_a::BIGINT AS p_a, n_b, p_b::BIGINT AS p_b FROM pairs"))
def season_pairs(spark, sf):
    return pairs(spark, sf)


@query("agg40_weighted_shift", on_eligible(PAIRS, f"SELECT team, season, buckets, weight::BIGINT AS weight, {r6('shift')} AS shift FROM sh"))
def weighted_shift(spark, sf):
    return out(SH.shift_sizes(pairs(spark, sf)), "shift", keep=("team", "season", "buckets", "weight"))


@query("top02_largest_shifts", on_eligible(PAIRS, f"SELECT team, season, {r6('shift')} AS shift FROM sh ORDER BY shift DESC, team, season LIMIT 12"))
def largest(spark, sf):
    return SH.shift_sizes(pairs(spark, sf)).orderBy(F.desc("shift"), "team", "season").limit(12).selectExpr("team", "season", f"{r('shift')} as shift")


TAGGED = [PRIMARY, PAIRS, "tg AS (SELECT sh.*, change_kind FROM sh JOIN trans ON sh.team = trans.school AND sh.season = trans.year)"]


def tagged(spark, sf, floor=10):
    t = SH.transitions(primary(spark, sf)).selectExpr("school as team", "year as season", "change_kind")
    return SH.shift_sizes(pairs(spark, sf, floor)).join(t, ["team", "season"])


@query("agg41_distribution", on_eligible(*TAGGED, f"""SELECT change_kind, COUNT(*) AS n, {r6('quantile_cont(shift, 0.25)')} AS q1, {r6('median(shift)')} AS median, {r6('quantile_cont(shift, 0.9)')} AS p90, {r6('AVG(shift)')} AS mean, {r6('stddev_samp(shift)')} AS sd FROM tg GROUP BY 1"""))
def distribution(spark, sf):
    return out(SH.summary(tagged(spark, sf), "shift", ["change_kind"]), "q1", "median", "p90", "mean", "sd", keep=("change_kind", "n"))


RANKS = """x AS (SELECT shift, change_kind = 'offseason' AS a FROM tg WHERE change_kind IN ('offseason', 'none')),
rk AS (SELECT *, rank() OVER (ORDER BY shift) + (COUNT(*) OVER (PARTITION BY shift) - 1) / 2.0 AS rk, COUNT(*) OVER (PARTITION BY shift) AS t FROM x),
s AS (SELECT COUNT(*) FILTER (a) AS na, COUNT(*) FILTER (NOT a) AS nb, SUM(rk) FILTER (a) AS ra, SUM(t * t - 1.0) AS ties, AVG(shift) FILTER (a) AS ma, AVG(shift) FILTER (NOT a) AS mb, var_samp(shift) FILTER (a) AS va, var_samp(shift) FILTER (NOT a) AS vb FROM rk)"""


def rank_row(spark, sf):
    return SH.rank_tests(tagged(spark, sf).withColumn("shift", F.expr(r("shift", 9))), "shift", "change_kind", "offseason", "none")


RT = [*TAGGED[:2], TAGGED[2].replace("sh.*", "sh.team, sh.season, floor(shift*1e9+0.5)/1e9 AS shift"), RANKS]


@query("agg42_cliffs_delta", on_eligible(*RT, f"SELECT na, nb, {r6('(SELECT AVG(sign(p.shift - q.shift)) FROM x p JOIN x q ON p.a AND NOT q.a)')} AS cliffs_delta FROM s"))
def cliffs(spark, sf):
    return out(rank_row(spark, sf), "cliffs_delta", keep=("na", "nb"))


@query("agg43_mann_whitney", on_eligible(*RT, f"SELECT {r6('ra - na * (na + 1) / 2.0', 3)} AS u, {r6('(ra - na * (na + 1) / 2.0 - na * nb / 2.0) / sqrt(na * nb / 12.0 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1.0))))', 4)} AS z FROM s"))
def mann_whitney(spark, sf):
    return rank_row(spark, sf).selectExpr(f"{r('u', 3)} as u", f"{r('z', 4)} as z")


@query("agg44_effect_size", on_eligible(*RT, f"SELECT {r6('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2.0))')} AS cohens_d, {r6('sqrt(greatest(0.0, ma * ma - mb * mb))')} AS drift FROM s"))
def effect_size(spark, sf):
    return rank_row(spark, sf).selectExpr(f"{r('cohens_d')} as cohens_d", f"{r(SH.true_drift('mean_a', 'mean_b'))} as drift")


@query("agg45_floor_sensitivity", on_eligible(PRIMARY, PAIRS.split("pairs AS")[0].rstrip(",\n "), "f AS (SELECT unnest([5, 10, 20, 30]) AS fl)",
    "pr AS (SELECT fl, b.team, b.season, a.n AS n_a, a.p AS p_a, b.n AS n_b, b.p AS p_b FROM bc a JOIN bc b ON a.team = b.team AND a.bucket = b.bucket AND b.season = a.season + 1 JOIN f ON a.n >= fl AND b.n >= fl)",
    "sh AS (SELECT fl, team, season, SUM(least(n_a, n_b) * abs(p_a::DOUBLE / n_a - p_b::DOUBLE / n_b)) / SUM(least(n_a, n_b)) AS shift FROM pr GROUP BY ALL HAVING SUM(least(n_a, n_b)) >= 100)", f"""
SELECT fl AS floor, COUNT(*) AS pairs, {r6("median(shift) FILTER (change_kind = 'offseason')")} AS median_changed, {r6("median(shift) FILTER (change_kind = 'none')")} AS median_same FROM sh JOIN trans ON sh.team = trans.school AND sh.season = trans.year GROUP BY 1"""))
def floors(spark, sf):
    every = pairs(spark, sf, 5).withColumn("floor", F.explode(F.array(*[F.lit(f) for f in (5, 10, 20, 30)]))).filter("n_a >= floor and n_b >= floor")
    t = SH.transitions(primary(spark, sf)).selectExpr("school as team", "year as season", "change_kind")
    return SH.shift_sizes(every, ("floor", "team", "season")).join(t, ["team", "season"]).groupBy("floor").agg(
        F.count("*").alias("pairs"), F.expr(r("percentile(if(change_kind = 'offseason', shift, null), 0.5D)") + " as median_changed"),
        F.expr(r("percentile(if(change_kind = 'none', shift, null), 0.5D)") + " as median_same"))


@query("agg47_printed_error", on_eligible(SC, f"""e AS (SELECT league, team < 'J' AS grp, abs(pred - passes::DOUBLE / plays) AS err, plays FROM sc)""", f"""
SELECT league, grp, SUM(plays)::BIGINT AS plays, {r6('SUM(err * plays) / SUM(plays)')} AS mean_error, {r6('SUM(CASE WHEN err > 0.2 THEN plays ELSE 0 END)::DOUBLE / SUM(plays)')} AS off_by_20 FROM e GROUP BY 1, 2"""))
def printed_error(spark, sf):
    """Held-out counts per (team, bucket) are the actual rates, so no window is needed."""
    t = scored(spark, sf).selectExpr("league", "team < 'J' as grp", "abs(pred - passes / plays) as err", "plays").groupBy("league", "grp").agg(
        F.sum("plays").alias("plays"), F.expr("sum(err * plays) / sum(plays) as mean_error"), F.expr("sum(if(err > 0.2, plays, 0)) / sum(plays) as off_by_20"))
    return out(t, "mean_error", "off_by_20", keep=("league", "grp", "plays"))


@query("agg48_staleness_weights", on_eligible(SC, TENURE, "t AS (SELECT sc.*, CASE WHEN tenure_start >= 1999 THEN 'stale' ELSE 'current' END AS grp FROM sc JOIN tn ON tn.school = sc.team AND tn.year = 2000)",
    "g AS (SELECT CAST(unnest(range(0, 101)) AS DOUBLE) / 100.0 AS w)", "wc AS (SELECT grp, w, SUM(" + loss("w * pred + (1.0 - w) * base") + ") / SUM(plays) AS b, SUM(plays) AS n FROM t CROSS JOIN g GROUP BY ALL)", f"""
SELECT grp, any_value(n)::BIGINT AS n, arg_min(w, (floor(b*1e12+0.5), w)) AS best_w, {r6('MIN(b)')} AS brier FROM wc GROUP BY 1"""))
def staleness(spark, sf):
    t = SH.tenures(primary(spark, sf)).filter("year = 2000").selectExpr("school as team", "if(tenure_start >= 1999, 'stale', 'current') as grp")
    curve = P.weight_curve(scored(spark, sf).join(t, "team"), by=("grp",))
    n = curve.groupBy("grp").agg(F.max("n").alias("n"))
    return out(P.best_of(curve, "w", ("grp",)).join(n, "grp"), "brier", keep=("grp", "n", "best_w"))


@query("agg54_did", on_eligible(SC, "a AS (SELECT team < 'J' AS grp, rung = 1 AS arm, SUM(" + loss("pred") + ") / SUM(plays) AS b FROM sc GROUP BY ALL)", f"""
SELECT grp, {r6('MAX(b) FILTER (arm)')} AS exact, {r6('MAX(b) FILTER (NOT arm)')} AS widened, {r6('MAX(b) FILTER (arm) - MAX(b) FILTER (NOT arm)')} AS difference FROM a GROUP BY 1"""))
def did(spark, sf):
    a = scored(spark, sf).selectExpr("team < 'J' as grp", "rung = 1 as arm", "plays", "passes", "pred").groupBy("grp", "arm").agg(F.expr(f"{P.brier('pred')} as b"))
    wide = a.groupBy("grp").pivot("arm", [True, False]).agg(F.max("b")).toDF("grp", "exact", "widened")
    return out(wide.withColumn("difference", F.expr("exact - widened")), "exact", "widened", "difference", keep=("grp",))


SWEEP = (0.05, 0.125, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 8.0, P.INF)


@query("agg55_recency_sweep")
def recency_sweep(spark, sf):
    """Twelve half-lives and the newest season alone, scored on both halves of the holdout weeks."""
    df = V.plays(spark, sf)
    by = ("league", "setting")
    fine = C.fine_cells(df.filter("season between 1997 and 1999"))
    grid = P.over_grid(fine, SWEEP, "half_life").withColumn("setting", F.expr("string(half_life)"))
    newest = fine.filter("season = 1999").withColumns({"half_life": F.lit(1.0), "setting": F.lit("newest")})
    every = grid.unionByName(newest).withColumn("season", F.expr("season + 51"))  # keep weights near 1 for short half-lives
    cells = C.decayed(every, "half_life", (*by, "half_life"))
    answers = C.answer(C.widened(cells, by), C.league_summary(cells, by), by=by)
    half = df.filter("season = 2000").withColumn("half", F.expr("if(week <= 7, 'fit', 'score')"))
    held = P.holdout_counts(half, by=("league", "half"))
    settings = ", ".join([f"'{s}'" for s in [*(_label(h) for h in SWEEP), "newest"]])
    held = held.withColumn("setting", F.expr(f"explode(array({settings}))"))
    wide = held.groupBy("league", "setting", "team", "key").agg(
        F.sum("plays").alias("plays"), F.sum("passes").alias("passes"), F.sum("successes").alias("successes"), F.sum("explosives").alias("explosives"),
        F.expr("sum(if(half = 'fit', plays, 0)) as plays_fit"), F.expr("sum(if(half = 'fit', passes, 0)) as passes_fit"))
    sc = P.score_cells(answers, wide, by).join(wide.select("league", "setting", "team", "key", "plays_fit", "passes_fit"), ["league", "setting", "team", "key"])
    return sc.groupBy("league", "setting").agg(F.sum("plays").alias("n"), F.expr(f"{r(P.brier('pred'))} as brier"),
        F.expr(f"{r('sum(' + P.loss('pred', 'passes_fit', 'plays_fit') + ') / sum(plays_fit)')} as brier_first_half"))


def _label(h):
    return "Infinity" if h == P.INF else repr(float(h))


# --- series and change points -----------------------------------------------------------

SERIES = """bk AS (SELECT *, 'd' || down || '_' || band || '_' || zone AS bucket FROM el),
br AS (SELECT bucket, AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END) AS rate FROM bk GROUP BY 1),
gs AS (SELECT offense AS team, season, week, game_id, COUNT(*) AS n, AVG(CASE WHEN is_pass THEN 1.0 ELSE 0.0 END) AS raw, AVG(rate) AS expected FROM bk JOIN br USING (bucket) GROUP BY ALL),
ser AS (SELECT *, raw - expected AS adj, CAST(row_number() OVER (PARTITION BY team ORDER BY season, week, game_id) - 1 AS INT) AS idx FROM gs)"""


def series(spark, sf):
    return CP.game_series(V.plays(spark, sf))


@query("agg49_game_series", on_eligible(SERIES, f"SELECT team, game_id, idx, n, {r6('raw')} AS raw, {r6('expected')} AS expected, {r6('adj')} AS adj FROM ser"))
def game_series(spark, sf):
    return out(series(spark, sf), "raw", "expected", "adj", keep=("team", "game_id", "idx", "n"))


@query("jn13_residuals", on_eligible(SERIES, f"SELECT play_id, {r6('CASE WHEN is_pass THEN 1.0 ELSE 0.0 END - rate')} AS residual FROM bk JOIN br USING (bucket)"))
def residuals(spark, sf):
    return CP.with_expected(V.plays(spark, sf)).selectExpr("play_id", f"{r('int(is_pass) - expected')} as residual")


@query("agg65_adjustment", on_eligible(SERIES, f"SELECT {r6('power(corr(raw, expected), 2)')} AS r2, {r6('stddev_samp(raw)')} AS sd_raw, {r6('stddev_samp(adj)')} AS sd_adj, {r6('1 - var_samp(adj) / var_samp(raw)')} AS removed FROM ser"))
def adjustment(spark, sf):
    return series(spark, sf).selectExpr(f"{r('power(corr(raw, expected), 2)')} as r2", f"{r('stddev_samp(raw)')} as sd_raw", f"{r('stddev_samp(adj)')} as sd_adj",
                                        f"{r('1 - var_samp(adj) / var_samp(raw)')} as removed")


@query("win06_season_start", on_eligible(SERIES, "SELECT team, season, MIN(idx) AS at FROM ser GROUP BY 1, 2"))
def season_start(spark, sf):
    return CP.season_starts(series(spark, sf))


CURVE = """cw AS (SELECT *, SUM(n) OVER w AS wc, SUM(adj * n) OVER w AS sc, SUM(n) OVER (PARTITION BY team) AS wt, SUM(adj * n) OVER (PARTITION BY team) AS st, COUNT(*) OVER (PARTITION BY team) AS size FROM ser WINDOW w AS (PARTITION BY team ORDER BY idx)),
cv AS (SELECT *, abs(sc - wc * st / wt) / sqrt(wc * (wt - wc) / wt::DOUBLE) AS stat FROM cw WHERE idx + 1 < size)"""


@query("win07_cusum", on_eligible(SERIES, CURVE, f"SELECT team, CAST(idx + 1 AS INT) AS pos, {r6('stat')} AS stat FROM cv"))
def cusum(spark, sf):
    return out(CP.cusum(series(spark, sf), ["team"]), "stat", keep=("team", "pos"))


DRAWS = CP.PERMUTATIONS
PERM = f"""pm AS (SELECT team, idx, adj, n, d.draw, CASE WHEN d.draw = 0 THEN 0 ELSE ('0x' || substr(md5('' || '|' || team || '|' || idx || '|' || d.draw), 1, 8))::BIGINT END AS h FROM ser CROSS JOIN (SELECT unnest(range(0, {DRAWS + 1})) AS draw) d),
pw AS (SELECT team, draw, row_number() OVER o AS pos, COUNT(*) OVER (PARTITION BY team, draw) AS size, SUM(n) OVER o AS wc, SUM(adj * n) OVER o AS sc, SUM(n) OVER (PARTITION BY team, draw) AS wt, SUM(adj * n) OVER (PARTITION BY team, draw) AS st FROM pm WINDOW o AS (PARTITION BY team, draw ORDER BY h, idx)),
ps AS (SELECT team, draw, pos, abs(sc - wc * st / wt) / sqrt(wc * (wt - wc) / wt::DOUBLE) AS stat FROM pw WHERE pos >= 6 AND size - pos >= 6),
pb AS (SELECT team, draw, MAX(stat) AS stat, arg_max(pos, (stat, -pos)) AS pos FROM ps GROUP BY 1, 2)"""


@query("sim04_permutation_test", on_eligible(SERIES, PERM, f"""
SELECT s.team, CAST(s.pos AS INT) AS pos, {r6('s.stat')} AS stat, {r6(f'(1.0 + COUNT(*) FILTER (b.stat >= s.stat - 1e-12)) / {DRAWS + 1}.0')} AS p FROM pb s JOIN pb b ON s.team = b.team AND s.draw = 0 AND b.draw > 0 GROUP BY s.team, s.pos, s.stat"""))
def permutation(spark, sf):
    return out(CP.permutation_test(series(spark, sf), ["team"], DRAWS), "stat", "p", keep=("team", "pos"))


def planted(spark, sf):
    """Even-numbered teams pass on a fifth of their plays from 1999 on: a level shift to find."""
    df = V.plays(spark, sf)
    hit = "(length(offense) % 2 = 0 and season >= 1999 and pk % 5 < 2 and is_rush)"
    return df.withColumns({"is_pass": F.expr(f"is_pass or {hit}"), "is_rush": F.expr(f"is_rush and not {hit}")})


def detections(spark, sf, source=None, alpha=0.05):
    s = CP.game_series(planted(spark, sf)) if source is None else source
    return CP.segment(s, alpha, DRAWS)


@query("sim05_segmentation")
def segmentation(spark, sf):
    return out(detections(spark, sf), "stat", "p", "delta", keep=("team", "start", "at", "games_before", "games_after"))


@query("sim06_null_detector")
def null_detector(spark, sf):
    s = CP.shuffled(series(spark, sf))
    found = detections(spark, sf, s)
    teams = s.agg(F.count_distinct("team").alias("teams"))
    return found.agg(F.count("*").alias("changepoints"), F.count_distinct("team").alias("flagged")).join(F.broadcast(teams))


def truth(spark, sf, s):
    t = SH.transitions(primary(spark, sf)).filter("change_kind = 'offseason'").selectExpr("school as team", "year as season", "concat(string(year), ' ', string(coach_id)) as label")
    return CP.season_starts(s).join(t, ["team", "season"]).select("team", "at", "label")


# fixed probes: every tenth game of a series stands in for a detection, so SQL can follow
PROBE = "fd AS (SELECT team, idx AS at, adj AS delta FROM ser WHERE idx % 10 = 9)"
TRUTH = f"{PRIMARY}, ev AS (SELECT s.team, MIN(s.idx) AS at, t.year || ' ' || t.coach_id AS label FROM ser s JOIN trans t ON t.school = s.team AND t.year = s.season WHERE change_kind = 'offseason' GROUP BY s.team, t.year, t.coach_id)"


def probes(s):
    return s.filter("idx % 10 = 9").selectExpr("team", "idx as at", "adj as delta")


MATCH = "mt AS (SELECT f.team, f.at, arg_min(struct_pack(e := e.at, l := e.label), (abs(e.at - f.at), e.at)) AS m FROM fd f JOIN ev e ON e.team = f.team AND abs(e.at - f.at) <= 2 GROUP BY 1, 2)"


@query("jn14_nearest_event", on_eligible(SERIES, TRUTH, PROBE, MATCH, "SELECT f.team, f.at, m IS NOT NULL AS matched, m.l AS event, abs(m.e - f.at) AS games_off FROM fd f LEFT JOIN mt ON mt.team = f.team AND mt.at = f.at"))
def nearest_event(spark, sf):
    s = series(spark, sf)
    return CP.match_events(probes(s), truth(spark, sf, s)).select("team", "at", "matched", "event", "games_off")


@query("agg50_detector_quality", on_eligible(SERIES, TRUTH, PROBE, MATCH, """
ls AS (SELECT team, CAST(unnest(range(6, g - 5)) AS INT) AS at FROM (SELECT team, COUNT(*) AS g FROM ser GROUP BY 1 HAVING COUNT(*) >= 20)),
sp AS (SELECT team, MIN(ls.at) AS lo, MAX(ls.at) AS hi FROM ls GROUP BY 1),
rc AS (SELECT e.team, e.at AS "at", EXISTS (SELECT 1 FROM fd WHERE fd.team = e.team AND abs(fd.at - e.at) <= 2) AS hit FROM ev e JOIN sp ON sp.team = e.team WHERE e.at BETWEEN lo - 2 AND hi + 2),
ch AS (SELECT ls.team, AVG(CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.team = ls.team AND abs(ev.at - ls.at) <= 2) THEN 1.0 ELSE 0.0 END) AS c FROM ls GROUP BY 1)""", f"""
SELECT (SELECT COUNT(*) FROM fd) AS detections, (SELECT COUNT(*) FROM mt) AS matched, (SELECT COUNT(*) FROM rc) AS reachable, (SELECT COUNT(*) FROM rc WHERE hit) AS detected, {r6('(SELECT AVG(c) FROM ch)')} AS chance_precision,
 {r6('(SELECT AVG(c) FROM fd JOIN ch USING (team))')} AS chance_per_detection"""))
def detector_quality(spark, sf):
    s = series(spark, sf)
    return out(CP.detector_quality(probes(s), truth(spark, sf, s), s), "chance_precision", "chance_per_detection", keep=("detections", "matched", "reachable", "detected"))


@query("set02_truth_union", on_eligible(SERIES, TRUTH, PROBE, 'SELECT team, ev.at AS "at" FROM ev UNION ALL SELECT team, fd.at FROM fd'))
def truth_union(spark, sf):
    s = series(spark, sf)
    return truth(spark, sf, s).select("team", "at").union(probes(s).select("team", "at"))


@query("top04_strongest", on_eligible(SERIES, CURVE, f"SELECT team, CAST(idx + 1 AS INT) AS pos, {r6('stat')} AS stat FROM cv WHERE idx >= 5 AND size - idx - 1 >= 6 ORDER BY stat DESC, team, idx LIMIT 10"))
def strongest(spark, sf):
    return CP.cusum(series(spark, sf), ["team"]).filter("pos >= 6 and size - pos >= 6").orderBy(F.desc("stat"), "team", "pos").limit(10).selectExpr("team", "pos", f"{r('stat')} as stat")


PB = "pb4 AS (SELECT f.team, f.at, SUM(s.adj * s.n) / SUM(s.n) AS adj_before FROM fd f JOIN ser s ON s.team = f.team AND s.idx < f.at GROUP BY 1, 2)"


@query("agg51_persistence", on_eligible(SERIES, PROBE, PB, """pz AS (SELECT f.team, f.at, SUM(adj * n) FILTER (idx - f.at < 8) / SUM(n) FILTER (idx - f.at < 8) - any_value(adj_before) AS dn, SUM(adj * n) FILTER (idx - f.at >= 8) / SUM(n) FILTER (idx - f.at >= 8) - any_value(adj_before) AS df
  FROM pb4 f JOIN ser s ON s.team = f.team AND s.idx >= f.at GROUP BY 1, 2 HAVING COUNT(*) >= 12)""", f"""
SELECT COUNT(*) AS changepoints, {r6('AVG(abs(dn))')} AS shift_near, {r6('AVG(abs(df))')} AS shift_rest, {r6('AVG(abs(df)) / AVG(abs(dn))')} AS retained, {r6('AVG(CASE WHEN sign(dn) = sign(df) THEN 1.0 ELSE 0.0 END)')} AS same_sign FROM pz"""))
def persistence(spark, sf):
    s = series(spark, sf)
    f = probes(s).select("team", "at").join(s.select("team", "idx", "adj", "n"), "team").filter("idx < at").groupBy("team", "at").agg(F.expr("sum(adj * n) / sum(n) as adj_before"))
    return out(CP.persistence(f, s), "shift_near", "shift_rest", "retained", "same_sign", keep=("changepoints",))


@query("agg64_season_offsets", on_eligible(SERIES, PROBE, "st AS (SELECT team, season, MIN(idx) AS s_at FROM ser GROUP BY 1, 2)", "ofs AS (SELECT f.team, f.at, arg_min(f.at - s_at, (abs(f.at - s_at), f.at - s_at)) AS o FROM fd f JOIN st ON st.team = f.team GROUP BY 1, 2)", """
SELECT CAST(o AS INT) AS offset_games, COUNT(*) AS changepoints, abs(o) <= 2 AS near FROM ofs GROUP BY o"""))
def season_offsets(spark, sf):
    s = series(spark, sf)
    t = probes(s).select("team", "at").join(CP.season_starts(s).selectExpr("team", "at as s_at"), "team").groupBy("team", "at").agg(
        F.expr("min_by(at - s_at, struct(abs(at - s_at), at - s_at)) as o"))
    return t.groupBy(F.col("o").alias("offset_games")).agg(F.count("*").alias("changepoints")).withColumn("near", F.expr("abs(offset_games) <= 2"))


PASSER = "concat('QB', string((dayofyear(shipped) div 40 + length(offense) + season) % 3))"
PASSERS = """qn AS (SELECT offense AS team, game_id, 'QB' || ((dayofyear(shipped) // 40 + length(offense) + season) % 3) AS passer, COUNT(*) AS n FROM el WHERE is_pass GROUP BY ALL), qb AS (SELECT team, game_id, arg_min(passer, (-n, passer)) AS passer, MAX(n) AS n FROM qn GROUP BY 1, 2)"""


@query("agg52_modal_passer", on_eligible(PASSERS, "SELECT * FROM qb"))
def modal_passer(spark, sf):
    return CP.modal_passers(V.plays(spark, sf), PASSER)


@query("win13_handover")
def handover(spark, sf):
    df = V.plays(spark, sf)
    return CP.handovers(CP.game_series(df), CP.modal_passers(df, PASSER))


@query("agg63_changepoint_detail", on_eligible(SERIES, PROBE, PASSERS, "sq AS (SELECT s.*, q.passer FROM ser s LEFT JOIN qb q ON q.team = s.team AND q.game_id = s.game_id)", f"""
SELECT f.team, f.at, MAX(CASE WHEN idx = f.at THEN s.season * 100 + s.week END) AS first_new, {r6('SUM(raw * s.n) FILTER (idx < f.at) / SUM(s.n) FILTER (idx < f.at)')} AS raw_before,
 {r6('SUM(raw * s.n) FILTER (idx >= f.at) / SUM(s.n) FILTER (idx >= f.at)')} AS raw_after, COUNT(DISTINCT passer) FILTER (idx >= f.at - 6 AND idx < f.at) AS passers_before FROM fd f JOIN sq s ON s.team = f.team GROUP BY 1, 2"""))
def changepoint_detail(spark, sf):
    df = V.plays(spark, sf)
    s = CP.game_series(df)
    named = s.join(CP.modal_passers(df, PASSER).select("team", "game_id", "passer"), ["team", "game_id"], "left")
    t = probes(s).select("team", "at").join(named, "team").groupBy("team", "at").agg(
        F.expr("max(if(idx = at, season * 100 + week, null)) as first_new"), F.expr("sum(if(idx < at, raw * n, 0)) / sum(if(idx < at, n, 0)) as raw_before"),
        F.expr("sum(if(idx >= at, raw * n, 0)) / sum(if(idx >= at, n, 0)) as raw_after"), F.expr("count(distinct if(idx >= at - 6 and idx < at, passer, null)) as passers_before"))
    return out(t, "raw_before", "raw_after", keep=("team", "at", "first_new", "passers_before"))


BOOT = RS.REPS


def boot_sql(cluster):
    return f"""cl AS (SELECT league, {cluster} AS cluster, SUM({loss('pred')} - {loss('base')}) AS diff, SUM(plays) AS n FROM sc GROUP BY 1, 2),
nm AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY md5(cluster), cluster) AS number, COUNT(*) OVER (PARTITION BY league) AS c FROM cl),
dr AS (SELECT league, draw, number AS slot, ('0x' || substr(md5('boot|' || league || '|' || draw || '|' || number), 1, 8))::BIGINT % c + 1 AS number FROM nm CROSS JOIN (SELECT unnest(range(0, {BOOT})) AS draw)),
es AS (SELECT dr.league, draw, SUM(diff) / SUM(n) AS e FROM dr JOIN nm ON nm.league = dr.league AND nm.number = dr.number GROUP BY 1, 2),
ci AS (SELECT league, quantile_cont(e, 0.025) AS low, quantile_cont(e, 0.975) AS high FROM es GROUP BY 1)"""


BOOT_OUT = f"SELECT ci.league, (SELECT COUNT(*) FROM cl WHERE cl.league = ci.league) AS clusters, {r6('(SELECT SUM(diff) / SUM(n) FROM cl WHERE cl.league = ci.league)')} AS difference, {r6('low')} AS low, {r6('high')} AS high, CASE WHEN high < 0 THEN 'better' WHEN low > 0 THEN 'worse' ELSE 'not established' END AS verdict FROM ci"


@query("sim01_team_bootstrap", on_eligible(SC, boot_sql("team"), BOOT_OUT))
def team_bootstrap(spark, sf):
    return out(RS.paired_bootstrap(RS.cluster_losses(scored(spark, sf), "team"), BOOT), "difference", "low", "high", keep=("league", "clusters", "verdict"))


@query("sim02_bucket_bootstrap", on_eligible(SC, boot_sql("key"), BOOT_OUT))
def bucket_bootstrap(spark, sf):
    return out(RS.paired_bootstrap(RS.cluster_losses(scored(spark, sf), "key"), BOOT), "difference", "low", "high", keep=("league", "clusters", "verdict"))


@query("sim03_binomial_null", on_eligible(PAIRS, """
big AS (SELECT team, season, bucket, n_a, n_b, (p_a + p_b)::DOUBLE / (n_a + n_b) AS pooled FROM pairs),
sd AS (SELECT team, season, bucket, n_a, n_b, pooled, 'a' AS side, n_a AS n FROM big UNION ALL SELECT team, season, bucket, n_a, n_b, pooled, 'b', n_b FROM big),
pm AS (SELECT team, season, bucket, side, k, exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln(pooled) + (n - k) * ln(1.0 - pooled)) AS m FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM sd WHERE pooled > 0 AND pooled < 1)),
cd AS (SELECT team, season, bucket, side, list(c ORDER BY k) AS cdf FROM (SELECT *, SUM(m) OVER (PARTITION BY team, season, bucket, side ORDER BY k) AS c FROM pm) GROUP BY 1, 2, 3, 4),
u AS (SELECT sd.*, draw, ('0x' || substr(md5(team || '|' || season || '|' || bucket || '|' || side || '|' || draw), 1, 8))::BIGINT / 4294967296.0 AS u FROM sd CROSS JOIN (SELECT unnest(range(0, 200)) AS draw)),
dw AS (SELECT u.team, u.season, u.bucket, u.n_a, u.n_b, u.draw, side, CASE WHEN pooled <= 0 THEN 0 WHEN pooled >= 1 THEN n ELSE least(n, len(list_filter(cdf, lambda c: c <= u.u))) END AS x FROM u LEFT JOIN cd USING (team, season, bucket, side)),
sn AS (SELECT team, season, draw, SUM(least(n_a, n_b) * abs(xa::DOUBLE / n_a - xb::DOUBLE / n_b)) / SUM(least(n_a, n_b)) AS shift FROM (
  SELECT team, season, bucket, n_a, n_b, draw, MAX(x) FILTER (side = 'a') AS xa, MAX(x) FILTER (side = 'b') AS xb FROM dw GROUP BY ALL) GROUP BY 1, 2, 3)""", f"SELECT team, season, {r6('AVG(shift)')} AS null_shift FROM sn GROUP BY 1, 2"))
def binomial_null(spark, sf):
    return out(SH.null_shift(pairs(spark, sf), 200), "null_shift", keep=("team", "season"))


@query("sim07_random_splits", on_eligible(SERIES, """
ls AS (SELECT team, CAST(unnest(range(6, g - 5)) AS INT) AS at FROM (SELECT team, COUNT(*) AS g FROM ser GROUP BY 1 HAVING COUNT(*) >= 20)),
rk AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY md5_h, ls2.at) AS k FROM (SELECT *, ('0x' || substr(md5('ref|' || team || '|' || ls.at), 1, 8))::BIGINT AS md5_h FROM ls) ls2)""", f"""
SELECT rk.team, rk.at AS "at", {r6('SUM(adj * n) FILTER (idx >= rk.at) / SUM(n) FILTER (idx >= rk.at) - SUM(adj * n) FILTER (idx < rk.at) / SUM(n) FILTER (idx < rk.at)')} AS delta FROM rk JOIN ser ON ser.team = rk.team WHERE k <= 5 GROUP BY 1, 2"""))
def random_splits(spark, sf):
    return out(CP.random_splits(series(spark, sf), 5, "ref"), "delta", keep=("team", "at"))


@query("sim08_downsample", on_eligible("""
k AS (SELECT offense, CAST(COUNT(*) // 3 AS BIGINT) AS keep_n FROM el GROUP BY 1), rk AS (SELECT e.*, row_number() OVER (PARTITION BY e.offense ORDER BY md5('placebo|' || play_id), play_id) AS rn FROM el e)""", """
SELECT rk.offense, play_id FROM rk JOIN k ON k.offense = rk.offense WHERE rn <= keep_n"""))
def downsample(spark, sf):
    el = S.eligible(V.plays(spark, sf)).select("offense", "play_id")
    keep = el.groupBy("offense").agg(F.expr("count(*) div 3 as keep_n"))
    return RS.downsample(el, keep)


#: Training series, its strongest legal split and a split drawn by hash.
CUTS = f"""tr AS (SELECT * FROM el WHERE season < 2000), {SERIES.replace('FROM el)', 'FROM tr)')}, {CURVE},
cuts AS (SELECT 'split' AS policy, team, CAST(arg_max(idx + 1, (stat, -idx)) AS INT) AS cut FROM cv WHERE idx + 1 >= 6 AND size - idx - 1 >= 6 GROUP BY 2 HAVING MAX(stat) >= 0.9
 UNION ALL SELECT 'random', team, CAST(6 + ('0x' || substr(md5('cut|' || team), 1, 8))::BIGINT % (COUNT(*) - 11) AS INT) FROM ser GROUP BY 2 HAVING COUNT(*) >= 12)"""


def kept_ctes(policy):
    held = f"(SELECT * FROM cuts WHERE policy = '{policy}')"
    base = f"kp_{policy} AS (SELECT tr.* FROM tr JOIN ser ON ser.team = tr.offense AND ser.game_id = tr.game_id LEFT JOIN {held} c ON c.team = tr.offense WHERE c.cut IS NULL OR ser.idx >= c.cut)"
    held_out = (f"hd_{policy} AS (SELECT league, offense AS team, 'd' || down || '_' || band || '_' || zone AS key, COUNT(*) AS plays, SUM(CASE WHEN is_pass THEN 1 ELSE 0 END) AS passes FROM el WHERE season = 2000 GROUP BY ALL)")
    scored = (f"ss_{policy} AS (SELECT h.*, l.pass_rate AS pred FROM hd_{policy} h JOIN lad_{policy} l ON h.league = l.league AND h.team = l.team AND h.key = l.key)")
    rows = (f"po_{policy} AS (SELECT '{policy}' AS policy, s.league, x.scope, SUM(plays)::BIGINT AS plays, {r6('SUM(plays * pred * pred - 2.0 * pred * passes + passes) / SUM(plays)')} AS brier, (SELECT COUNT(*) FROM kp_{policy} k WHERE k.league = s.league) AS kept "
            f"FROM ss_{policy} s JOIN (SELECT DISTINCT offense AS team, 'all' AS scope FROM el UNION ALL SELECT DISTINCT team, 'touched' FROM cuts) x ON x.team = s.team GROUP BY ALL)")
    return ",\n".join([base, ladder_ctes(f"kp_{policy}", f"_{policy}", "60.0", "1.0"), held_out, scored, rows])


POLICIES = ("shipped", "split", "random")


@query("sim09_truncated_history", on_eligible(CUTS, *[kept_ctes(p) for p in POLICIES], " UNION ALL ".join(f"SELECT * FROM po_{p}" for p in POLICIES)))
def truncated(spark, sf):
    """Held-out loss with all history, with that after a team's strongest split, and after a random one."""
    df = V.plays(spark, sf)
    s = CP.game_series(df.filter("season < 2000"))
    best = CP.best_split(CP.cusum(s, ["team"]), ["team"]).filter("stat >= 0.9").selectExpr("'split' as policy", "team", "pos as cut")
    sizes = s.groupBy("team").agg(F.count("*").alias("games")).filter("games >= 12")
    drawn = sizes.withColumn("cut", (F.lit(6) + hash_draw(F.lit("cut"), "team") % (F.col("games") - 11)).cast("int")).selectExpr("'random' as policy", "team", "cut")
    table = P.score_policies(df, s, best.unionByName(drawn), POLICIES, 2000)
    return out(table, "brier", keep=("policy", "league", "scope", "plays", "kept"))


@query("jn21_regime_or_team")
def regime_or_team(spark, sf):
    """Regime block when it reaches a team rung (C), and rung by rung (C2)."""
    df = V.plays(spark, sf).filter("season < 2000")
    t = SH.tenures(primary(spark, sf)).selectExpr("school as offense", "year as season", "regime")
    tagged_plays = df.join(t, ["offense", "season"], "left").withColumn("regime", F.expr("coalesce(regime, offense)"))
    team = C.ladder(df).select("league", "team", "key", "rung", "pass_rate", "n1", "n2", "n3")
    now = SH.tenures(primary(spark, sf)).filter("year = 2000").selectExpr("school as team", "regime")
    reg = C.ladder(tagged_plays, team="regime").selectExpr("league", "team as regime", "key", "rung as r_rung", "pass_rate as r_rate", "n1 as r1", "n2 as r2", "n3 as r3")
    both = team.join(now, "team", "left").join(reg, ["league", "regime", "key"], "left")
    step = " ".join(f"when r{i} >= 30 then 'regime' when n{i} >= 30 then 'team'" for i in (1, 2, 3))
    return both.selectExpr("league", "team", "key", "if(r_rung < 5, r_rung, rung) as rung", "if(r_rung < 5, r_rate, pass_rate) as pred",
                           f"case {step} else 'league' end as per_rung_source")
