"""Season profiles per team, side and situation, and the joins that feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import situation as S

MIN_PLAYS, MIN_GAMES = 20, 5


def attach_outcomes(plays: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One-to-one join on (game, play); another team or a penalty leaves the outcome unknown."""
    df = plays.join(outcomes, ["game_id", "play_id"], "left")
    clean = "coalesce(posteam = offense and penalty = 0, false)"
    return df.withColumn("converted", F.expr(L.flag_conversion())).withColumn("clear_yards", F.expr(f"if({clean}, yards_gained, null)"))


def profile_cells(plays: DataFrame, by=("league", "season"), min_plays=MIN_PLAYS, min_games=MIN_GAMES) -> DataFrame:
    """Counts per side, team and context with enough plays and games.

    Plays are read once: each counts in its game, so games are counted without a
    distinct, and in a histogram of yards (at most 199 values), which gives the exact
    medians.  Both kinds of row combine on the map side in one shuffle."""
    df = plays.withColumn("context", F.expr(S.HISTORY_CONTEXT)).filter("context is not null").selectExpr(
        *by, "stack(2, 'offense', offense, 'defense', defense) as (side, team)", "context", "game_id", "converted", "is_rush", "is_pass", "clear_yards as y")
    key = [*by, "side", "team", "context"]
    sums = ["count(*) as n", "count(converted) as known", "count_if(converted) as conversions"]
    for name, flag in (("run", "is_rush"), ("pass", "is_pass")):
        sums += [f"count_if({flag}) as {name}_n", f"count_if({flag} and y is not null) as {name}_known",
                 f"count_if({flag} and y <= 2) as {name}_two_or_less", f"count_if({flag} and y >= 5) as {name}_five_plus",
                 f"count_if({flag} and y >= 10) as {name}_ten_plus"]
    names = [s.split(" as ")[1] for s in sums]
    twice = df.selectExpr("*", "explode(array(true, false)) as in_game").selectExpr(
        *key, "in_game", "if(in_game, game_id, null) as game", "if(in_game, null, y) as yards", "converted", "is_rush", "is_pass", "y")
    parts = twice.dropna(subset=key).groupBy(*key, "in_game", "game", "yards").agg(*[F.expr(s) for s in sums])
    median = lambda n: f"percentile(if(not in_game and yards is not null, yards, null), 0.5D, if(in_game, 0L, {n}))"
    cells = parts.groupBy(*key).agg(F.expr("count_if(in_game) as games"), *[F.expr(f"sum(if(in_game, {n}, 0L)) as {n}") for n in names],
                                    F.expr(f"{median('run_n')} as run_median"), F.expr(f"{median('pass_n')} as pass_median"))
    return cells.filter(f"n >= {min_plays} and games >= {min_games}").select(*key, "games", *names, "run_median", "pass_median")


def usable(cells: DataFrame) -> DataFrame:
    """Which measures a profile may be read for: enough known outcomes, and 90% of them."""
    ok = lambda known, n, least: f"({known} >= {least} and {known} >= 0.9D * {n})"
    return cells.selectExpr("*", f"{ok('known', 'n', 20)} as conversion_usable", f"{ok('run_known', 'run_n', 15)} as run_usable",
                            f"{ok('pass_known', 'pass_n', 15)} as pass_usable").withColumn(
        "reading", F.expr("case when context like 'd3|%' and conversion_usable then 'third_down' when context like '%|short|%' and run_usable then 'short_run' end"))


def coverage(cells: DataFrame, by=("league", "season")) -> DataFrame:
    return cells.groupBy(*by, "side").agg(F.count_distinct("team").alias("teams"), F.count("*").alias("cells"), F.sum("n").alias("covered"))


def prior_season(situations: DataFrame, cells: DataFrame) -> DataFrame:
    """Each situation with last season's offense and defense profile of its context."""
    def side(name):
        return cells.filter(f"side = '{name}'").selectExpr("league", "season + 1 as season", f"team as {name}", "context",
                                                            f"n as {name}_n", f"conversions as {name}_conversions", f"known as {name}_known")
    return situations.join(side("offense"), ["league", "season", "offense", "context"], "left").join(
        side("defense"), ["league", "season", "defense", "context"], "left")


def enrich(plays: DataFrame, source: DataFrame, key="play_id", team="offense", source_team="source_team") -> DataFrame:
    """Left join of source rows whose id is unique and whose team agrees where known.

    Copies are excluded, never multiplied: ids are counted with map-side combine."""
    rest = [c for c in source.columns if c != key]
    one = source.groupBy(key).agg(F.count("*").alias("_copies"), F.min(F.struct(*rest)).alias("_s")).filter("_copies = 1").select(key, "_s.*", F.lit(True).alias("_hit"))
    df = plays.join(one, key, "left")
    ok = f"(_hit and ({source_team} is null or {source_team} = {team}))"
    return df.selectExpr(*plays.columns, *[f"if({ok}, {c}, null) as {c}" for c in rest], f"coalesce({ok}, false) as matched")
