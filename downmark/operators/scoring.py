"""Holdout splits and scores.

The outcome is 0 or 1, so a prediction p shared by ``plays`` plays of which
``passes`` have outcome 1 has squared loss ``plays*p^2 - 2*p*passes + passes``.
Held-out plays are therefore counted per (team, bucket) once, and every score,
grid and band is computed on those counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import div, r
from ..scale import with_position, with_running
from . import cells as C

INF = float("inf")
# Reported grids and cut pairs.
K_GRID = (0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 350, 500, 750, 1000, 2000, INF)
K_JOINT = (0, 20, 50, 75, 100, 150, 250, 500, 1000, INF)
EB_GRID = (0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 1000)
HALF_LIVES = (0.5, 1.0, 2.0, 3.0, 4.0, INF)
ROUND_CANDIDATES = (40.0, 50.0, 60.0, 75.0, 100.0, 150.0, 200.0)
CANDIDATE_CUTS = ((0.50, 0.35), (0.50, 0.25), (0.60, 0.35), (0.71, 0.45), (0.60, 0.45), (0.75, 0.50), (0.40, 0.20))
SIGNAL_EPS = 0.03
TAIL_SHARE = 0.25
PLATEAU = 0.0002


def fine_k() -> list[float]:
    """0, infinity and 160 geometric steps from 1 to 5000, one decimal."""
    steps = {round(5000.0 ** (i / 159), 1) for i in range(160)}
    return sorted(steps | {0.0, INF})


def tail_cut(stamps: DataFrame, by=("league",), share: float = TAIL_SHARE) -> DataFrame:
    """Latest (season, week) whose tail still holds ``share`` of the plays.

    ``stamps`` has one row per week, so the window is small."""
    late = W.partitionBy(*by).orderBy(F.col("stamp").desc())
    tail = F.sum("n").over(late) / F.sum("n").over(W.partitionBy(*by))
    return (stamps.withColumn("tail", tail).filter(F.col("tail") >= share)
            .groupBy(*by).agg(F.max("stamp").alias("cut"), F.max_by("tail", "stamp").alias("share")))


def holdout_counts(plays: DataFrame, team: str = "offense", by=("league",)) -> DataFrame:
    """Held-out plays per (team, bucket) with the count of each outcome."""
    return (S.eligible(plays).selectExpr(*by, f"{team} as team", f"{S.bucket_sql()} as key", "int(is_pass) as p",
                                         "int(success) as s", f"int({S.EXPLOSIVE}) as e")
            .filter("key is not null").groupBy(*by, "team", "key")
            .agg(F.count("*").alias("plays"), F.sum("p").alias("passes"), F.sum("s").alias("successes"),
                 F.sum("e").alias("explosives")))


def counted(fine: DataFrame, by=("league",)) -> DataFrame:
    """``holdout_counts`` from fine cells."""
    return fine.groupBy(*by, "team", F.expr(C.KEY).alias("key")).agg(
        F.sum("n").alias("plays"), F.sum("n_pass").alias("passes"), F.sum("n_success").alias("successes"), F.sum("n_explosive").alias("explosives"))


def score_cells(answers: DataFrame, held: DataFrame, by=("league",)) -> DataFrame:
    """Attach predictions and baselines to the held-out counts.

    A team the ladder never saw reads the league's rate for the bucket."""
    on = [*by, "team", "key"]
    known = answers.select(*on, "rung", "sample_size", "shrink_weight", "confidence", "pass_rate", "pass_rate_raw",
                           "success_raw", "explosive_raw", "league_success", "league_explosive")
    league = (answers.groupBy(*by, "key").agg(
        F.max("league_n").alias("b_n"), F.max("situation_rate").alias("b_rate"), F.max("league_pass_rate").alias("b_any"),
        F.max("global_rate").alias("b_global")))
    base = "coalesce(b_rate, b_global)"
    return (held.join(known, on, "left").join(league, [*by, "key"], "left").selectExpr(
        *on, "plays", "passes", "successes", "explosives", "coalesce(rung, 5) as rung",
        "coalesce(sample_size, b_n, 0) as sample_size", "coalesce(shrink_weight, 0.0D) as weight",
        "coalesce(confidence, 'low') as confidence", "coalesce(pass_rate, b_any) as pred",
        f"coalesce(pass_rate_raw, {base}) as raw", f"{base} as base_situation", "b_global as base_global",
        "success_raw", "explosive_raw", "league_success", "league_explosive"))


def evaluate(plays: DataFrame, holdout: int, half_life=1.0, k=S.SHRINK_K, by=("league",), team="offense") -> DataFrame:
    """Build on the seasons before ``holdout`` and score that season's plays.

    Plays are counted once; training sums and held-out counts are both masked
    sums of the same fine cells, so the shuffle of the counts is shared."""
    return evaluate_cells(C.fine_cells(plays.filter(f"season <= {holdout}"), team, by), holdout, half_life, k, by)


def evaluate_cells(fine: DataFrame, holdout: int, half_life=1.0, k=S.SHRINK_K, by=("league",)) -> DataFrame:
    """``evaluate`` of plays that are counted already, up to the season ``holdout``."""
    counts = ("n", "n_pass", "n_success", "n_explosive")
    train = fine.withColumns({c: F.expr(f"if(season < {holdout}, {c}, 0L)") for c in counts})
    names = ("plays", "passes", "successes", "explosives")
    held = (fine.groupBy(*by, "team", "down", "band", "zone")
            .agg(*[F.expr(f"sum(if(season = {holdout}, {c}, 0L)) as {n}") for c, n in zip(counts, names)])
            .filter("plays > 0").selectExpr(*by, "team", f"{C.KEY} as key", *names))
    return score_cells(C.ladder_of(train, half_life, k, by), held, by)


def loss(p, hits="passes", n="plays") -> str:
    """Total squared loss of one prediction over a cell."""
    return f"({n} * ({p}) * ({p}) - 2.0D * ({p}) * {hits} + {hits})"


def brier(p, hits="passes", n="plays") -> str:
    return f"(sum({loss(p, hits, n)}) / sum({n}))"


def accuracy(p) -> str:
    return f"(sum(case when ({p}) >= 0.5D then passes else plays - passes end) / sum(plays))"


def scores(scored: DataFrame, by=("league",)) -> DataFrame:
    """Brier, accuracy and mean absolute distance from the league line."""
    return scored.groupBy(*by).agg(
        F.sum("plays").alias("n"), F.expr(f"{brier('pred')} as brier"), F.expr(f"{brier('raw')} as brier_raw"),
        F.expr(f"{brier('base_situation')} as brier_situation"), F.expr(f"{brier('base_global')} as brier_global"),
        F.expr(f"{accuracy('pred')} as accuracy"),
        F.expr("sum(plays * abs(pred - base_situation)) / sum(plays) as mean_gap"))


def reliability(scored: DataFrame, p="pred", by=("league",), hits="passes") -> DataFrame:
    """Ten fixed bins, half open except the last."""
    return (scored.withColumn("bin", F.expr(f"int(least(9, floor({r(f'({p}) * 10', 9)})))")).groupBy(*by, "bin")
            .agg(F.sum("plays").alias("n"), F.expr(f"sum({p} * plays) / sum(plays) as predicted"),
                 F.expr(f"sum({hits}) / sum(plays) as observed")))


def calibration_error(table: DataFrame, by=("league",)) -> DataFrame:
    return table.groupBy(*by).agg(F.sum("n").alias("n"),
                                  F.expr("sum(n * abs(observed - predicted)) / sum(n) as ece"))


def breakdown(scored: DataFrame, column: str, by=("league",)) -> DataFrame:
    out = scored.groupBy(*by, column).agg(
        F.sum("plays").alias("n"), F.expr(f"{brier('pred')} as brier"),
        F.expr(f"{brier('base_situation')} as brier_situation"), F.expr(f"{brier('base_global')} as brier_global"),
        F.expr(f"{accuracy('pred')} as accuracy"))
    return out.selectExpr("*", f"n / sum(n) over (partition by {', '.join(by)}) as reach",
                          f"1 - {div('brier', 'brier_situation')} as skill")


def shrunk_at(k: str, raw="raw", base="base_situation", n="sample_size") -> str:
    w = S.weight_sql(n, k)
    return f"({w}) * {raw} + (1.0D - ({w})) * {base}"


def over_grid(df: DataFrame, values, name: str) -> DataFrame:
    """One copy of the counted rows per grid value."""
    return df.withColumn(name, F.expr(f"explode(array({', '.join(S.number(v) for v in values)}))"))


def k_curve(scored: DataFrame, grid=K_GRID, by=("league",), raw="raw", base="base_situation", hits="passes") -> DataFrame:
    return over_grid(scored, grid, "k").groupBy(*by, "k").agg(
        F.expr(f"{brier(shrunk_at('k', raw, base), hits)} as brier"), F.sum("plays").alias("n"))


def best_of(curve: DataFrame, name: str, by=("league",)) -> DataFrame:
    """The grid value with the lowest score; the smaller value wins a tie."""
    return curve.groupBy(*by).agg(F.expr(f"min_by({name}, struct({r('brier', 12)}, {name})) as best_{name}"),
                                  F.min("brier").alias("brier"))


def weight_curve(scored: DataFrame, steps: int = 100, by=("league",)) -> DataFrame:
    """Brier of blends ``w*pred + (1-w)*base`` for w = 0..1."""
    blend = "w * pred + (1.0D - w) * base_situation"
    return over_grid(scored, [i / steps for i in range(steps + 1)], "w").groupBy(*by, "w").agg(
        F.expr(f"{brier(blend)} as brier"), F.expr(f"{accuracy(blend)} as accuracy"), F.sum("plays").alias("n"))


def plateau(curve: DataFrame, width: float = PLATEAU, by=("league",)) -> DataFrame:
    """Range of finite k whose score is within ``width`` of the best."""
    low = F.min("brier").over(W.partitionBy(*by))
    near = curve.withColumn("low", low).filter((F.col("brier") <= F.col("low") + width) & (F.col("k") < INF))
    return near.groupBy(*by).agg(F.min("k").alias("k_low"), F.max("k").alias("k_high"), F.count("*").alias("candidates"))


def pooled_regret(curve: DataFrame, by=("league",)) -> DataFrame:
    """Summed distance from each group's own best score, per k."""
    low = F.min("brier").over(W.partitionBy(*by))
    return curve.withColumn("regret", F.col("brier") - low).groupBy("k").agg(F.sum("regret").alias("regret"))


FAR = f"abs(pred - base_situation) > {SIGNAL_EPS}"


def confidence_bands(scored: DataFrame, by=("league",)) -> DataFrame:
    out = scored.groupBy(*by, "confidence").agg(
        F.sum("plays").alias("n"), F.expr("sum(weight * plays) / sum(plays) as mean_weight"),
        F.expr("percentile(sample_size, 0.5D, plays) as median_n"),
        F.expr(f"sum(if({FAR}, plays, 0)) / sum(plays) as says_else"), F.expr(f"{brier('pred')} as brier_shipped"),
        F.expr(f"{brier('raw')} as brier_raw"), F.expr(f"{brier('base_situation')} as brier_league"))
    return out.selectExpr("*", f"n / sum(n) over (partition by {', '.join(by)}) as reach")


def cut_table(scored: DataFrame, cuts=CANDIDATE_CUTS, by=("league",)) -> DataFrame:
    """The band measures under every candidate pair of cut points."""
    pairs = ", ".join(f"struct({h}D as high, {m}D as medium)" for h, m in cuts)
    g = scored.selectExpr("*", f"inline(array({pairs}))").withColumn(
        "band", F.expr("case when weight >= high then 'high' when weight >= medium then 'medium' else 'low' end"))
    out = g.groupBy(*by, "high", "medium", "band").agg(
        F.sum("plays").alias("n"), F.expr(f"{brier('raw')} as brier_raw"),
        F.expr(f"{brier('base_situation')} as brier_league"), F.expr(f"sum(if({FAR}, plays, 0)) / sum(plays) as says_else"))
    return out.selectExpr("*", f"n / sum(n) over (partition by {', '.join(by)}, high, medium) as reach",
                          f"1 - {div('brier_raw', 'brier_league')} as raw_skill")


def equal_count_bins(scored_plays: DataFrame, bins: int = 10, by=("league",), p="pred", id_col="play_id") -> DataFrame:
    """Equal-count bins of the predictions, ties in hash order of the play id.

    Predictions carry four decimals, so (prediction, first hash byte) is an
    ordered block and no group has to be ranked in one task."""
    df = scored_plays.withColumn("_tie", F.md5(id_col)).withColumn(
        "_slot", F.expr(f"bigint(floor({p} * 10000 + 0.5D)) * 256 + int(conv(substring(_tie, 1, 2), 16, 10))"))
    ranked = with_position(df, by, "_slot", [p, "_tie"], "_rank")
    total = scored_plays.groupBy(*by).agg(F.count("*").alias("_total"))
    slot = f"int(greatest(1, ceil((_rank - 1) * {bins} / greatest(_total - 1, 1))))"
    return (ranked.join(total, list(by)).selectExpr("*", f"{slot} as decile").groupBy(*by, "decile").agg(
        F.count("*").alias("n"), F.min(p).alias("pred_lo"), F.max(p).alias("pred_hi"), F.avg(p).alias("predicted"),
        F.expr("avg(int(is_pass)) as observed")))


def signal_retention(answers: DataFrame, k: float, by=("league",)) -> DataFrame:
    """Share of (team, bucket) cells still away from the league line, before and after shrinking at k."""
    raw = "coalesce(pass_rate_raw, league_pass_rate)"
    cells = answers.filter("situation_rate is not null").selectExpr(
        *by, f"{raw} as raw", "situation_rate as base", "if(rung = 5, 0, sample_size) as n")
    gap = f"abs({shrunk_at(S.number(k), 'raw', 'base', 'n')} - base)"
    return cells.groupBy(*by).agg(
        F.count("*").alias("cells"), F.expr(f"avg(int(abs(raw - base) > {SIGNAL_EPS})) as raw_share"),
        F.expr(f"avg(int({gap} > {SIGNAL_EPS})) as shrunk_share"), F.expr("avg(abs(raw - base)) as raw_gap"),
        F.expr(f"avg({gap}) as shrunk_gap"))


COUNTS = ("n", "n_pass", "n_success", "n_explosive")


def cumulative_cells(plays: DataFrame, series: DataFrame, by=("league",), team: str = "offense") -> DataFrame:
    """Fine cells per game of a team with running sums over its game index, this game included.

    The history before any cut is then one row per cell, and what is left after the cut a
    difference of two sums; no play is read again for another cut."""
    games = C.fine_cells(plays, team, (*by, "game_id")).join(series.select("team", "game_id", "idx"), ["team", "game_id"])
    keys = [*by, "team", "down", "band", "zone", "season"]
    placed = games.withColumn("_block", F.expr("idx div 64"))
    return with_running(placed, keys, "_block", ["idx"], {f"c_{c}": F.col(c) for c in COUNTS}).drop("_block")


def cells_after(running: DataFrame, cuts: DataFrame, policies, by=("league",)) -> DataFrame:
    """Fine cells of every policy: a team's games from its ``cut`` on, all of them where it has none.

    ``cuts`` are (policy, team, cut), at most one cut for each."""
    keys = [*by, "team", "down", "band", "zone", "season"]
    whole = running.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    each = whole.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    before = (running.join(cuts, "team").filter("idx < cut").groupBy("policy", *keys)
              .agg(F.max_by(F.struct(*[f"c_{c}" for c in COUNTS]), "idx").alias("_b")))
    left = each.join(before, ["policy", *keys], "left")
    return left.selectExpr("policy", *keys, *[f"{c} - coalesce(_b.c_{c}, 0) as {c}" for c in COUNTS]).filter("n > 0")


def score_policies(plays: DataFrame, series: DataFrame, cuts: DataFrame, policies, holdout: int, half_life=1.0, k=S.SHRINK_K, by=("league",), team="offense") -> DataFrame:
    """Held-out loss of every policy, over all plays and over those of teams that some policy cuts.

    ``kept`` are the training plays of the policy."""
    before = plays.filter(f"season < {int(holdout)}")
    cells = cells_after(cumulative_cells(before, series, by, team), cuts, policies, by)
    ways = F.explode(F.array(*[F.lit(p) for p in policies]))
    held = holdout_counts(plays.filter(f"season = {int(holdout)}"), team, by).withColumn("policy", ways)
    scored = score_cells(C.ladder_of(cells, half_life, k, ("policy", *by)), held, ("policy", *by))
    touched = cuts.filter("cut > 0").select("team").distinct().withColumn("touched", F.lit(True))
    rows = scored.join(touched, "team", "left").withColumn("scope", F.explode(F.expr("if(touched, array('all', 'touched'), array('all'))")))
    kept = cells.groupBy("policy", *by).agg(F.sum("n").alias("kept"))
    out = rows.groupBy("policy", *by, "scope").agg(F.sum("plays").alias("plays"), F.expr(f"{brier('pred')} as brier"))
    return out.join(kept, ["policy", *by])
