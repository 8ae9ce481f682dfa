"""Situation counts, the widening ladder and the shrunk rate of every cell.

Plays are counted once into fine cells (team x situation x season).  Everything
after that works on the counts, so its size follows teams and situations, not
plays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import div, r

RATES = ("pass", "success", "explosive")
REFERENCE = 2050  # any fixed year: a decayed rate does not depend on it


def counted_cells(plays: DataFrame, team: str = "offense", by=("league",), stamp: str | None = None) -> DataFrame:
    """Counts by team, down, band, zone and season, those outside the 60 buckets too; ``stamp`` adds its first and last value."""
    ends = [F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp")] if stamp else []
    return (S.eligible(plays)
            .selectExpr(*by, f"{team} as team", "down", f"{S.band_sql()} as band", f"{S.zone_sql()} as zone", "season",
                        "int(is_pass) as p", "int(success) as s", f"int({S.EXPLOSIVE}) as e", *([f"{stamp} as stamp"] if stamp else []))
            .groupBy(*by, "team", "down", "band", "zone", "season")
            .agg(F.count("*").alias("n"), F.sum("p").alias("n_pass"), F.sum("s").alias("n_success"),
                 F.sum("e").alias("n_explosive"), *ends))


def in_buckets(counted: DataFrame) -> DataFrame:
    return counted.filter("band is not null and zone is not null and down between 1 and 4")


def fine_cells(plays: DataFrame, team: str = "offense", by=("league",)) -> DataFrame:
    """Counts by team, down, band, zone and season."""
    return in_buckets(counted_cells(plays, team, by))


def decayed(fine: DataFrame, half_life=1.0, by=("league",)) -> DataFrame:
    """One row per team and exact bucket with raw n and decayed sums."""
    w = S.recency_sql(REFERENCE, half_life)
    return (fine.groupBy(*by, "team", "down", "band", "zone")
            .agg(F.sum("n").alias("n"), F.sum("n_pass").alias("n_pass"), F.expr(f"sum(n * {w}) as w_n"),
                 *[F.expr(f"sum(n_{x} * {w}) as w_{x}") for x in RATES]))


KEY = "concat('d', string(down), '_', band, '_', zone)"
DIST = "concat('d', string(down), '_', band)"
SUMS = ("n", *RATES)


def _rate(x: str, tail: str = "") -> str:
    return r(div(f"w_{x}{tail}", f"w_n{tail}"), 4)


def rung_tables(cells: DataFrame, by=("league",)) -> DataFrame:
    """All rungs long: each cell feeds its exact key, the neighbouring zones'
    pooled keys, its distance key and the league's exact key, in one shuffle."""
    near = "map(" + ", ".join(
        f"'{z}', array({', '.join(repr(t) for t in S.neighbors(z))})" for z in S.ZONES) + ")[zone]"
    feed = f"""explode(concat(
        array(named_struct('rung', 1, 'team', team, 'key', {KEY})),
        transform({near}, t -> named_struct('rung', 2, 'team', team, 'key', concat({DIST}, '_~', t))),
        array(named_struct('rung', 3, 'team', team, 'key', {DIST}),
              named_struct('rung', 5, 'team', string(null), 'key', {KEY})))) as f"""
    out = (cells.selectExpr(*by, "n", *[f"w_{x}" for x in SUMS], feed)
           .selectExpr(*by, "n", *[f"w_{x}" for x in SUMS], "f.*").groupBy(*by, "rung", "team", "key")
           .agg(F.sum("n").alias("sample_size"), *[F.sum(f"w_{x}").alias(f"w_{x}") for x in SUMS]))
    return out.selectExpr(*by, "rung", "team", "key", "sample_size", *[f"{_rate(x)} as {x}_rate" for x in RATES])


def league_cells(cells: DataFrame, by=("league",)) -> DataFrame:
    """The league's exact-bucket rates: at most 60 rows per league."""
    return (cells.groupBy(*by, "down", "band", "zone")
            .agg(F.sum("n").alias("n"), F.sum("n_pass").alias("n_pass"), *[F.sum(f"w_{x}").alias(f"w_{x}") for x in SUMS])
            .selectExpr(*by, f"{KEY} as key", "n as league_n", "n_pass", *[f"w_{x}" for x in SUMS],
                        *[f"{_rate(x)} as l_{x}" for x in RATES]))


def league_summary(cells: DataFrame, by=("league",)) -> DataFrame:
    """One row per league: a map of its (at most 60) bucket rates, its overall
    rates as the last-resort prior, and the undecayed global pass rate."""
    entry = "struct(key, struct(league_n as n, l_pass as pass, l_success as success, l_explosive as explosive))"
    return (league_cells(cells, by).groupBy(*by)
            .agg(F.expr(f"map_from_entries(collect_list({entry})) as buckets"), F.sum("league_n").alias("overall_n"),
                 F.sum("n_pass").alias("n_pass"), *[F.sum(f"w_{x}").alias(f"w_{x}") for x in SUMS])
            .selectExpr(*by, "buckets", "overall_n", f"{div('n_pass', 'overall_n')} as global_rate",
                        *[f"{_rate(x)} as o_{x}" for x in RATES]))


TARGETS = "array(" + ", ".join(
    f"named_struct('d', {d}, 'b', '{b}', 'z', '{z}', 'i', {i})"
    for d in S.DOWNS for b in S.BANDS for i, z in enumerate(S.ZONES)) + ")"
PLACE = "case zone " + " ".join(f"when '{z}' then {i}" for i, z in enumerate(S.ZONES)) + " end"


def widened(cells: DataFrame, by=("league",)) -> DataFrame:
    """For every team and all 60 buckets: the sums of rungs 1, 2 and 3 side by side."""
    values = ["n", *[f"w_{x}" for x in SUMS]]
    rows = (cells.selectExpr(*by, "team", *values, "down as sd", "band as sb", f"{PLACE} as si", f"explode({TARGETS}) as t")
            .selectExpr(*by, "team", "t.d as down", "t.b as band", "t.z as zone", *values,
                        "t.d = sd and t.b = sb as same", "abs(t.i - si) as step"))
    hits = {1: "same and step = 0", 2: "same and step <= 1", 3: "same"}
    sums = []
    for rung, hit in hits.items():
        sums.append(F.expr(f"sum(if({hit}, n, 0)) as n{rung}"))
        sums += [F.expr(f"sum(if({hit}, w_{x}, 0.0D)) as w_{x}{rung}") for x in SUMS]
    return rows.groupBy(*by, "team", "down", "band", "zone").agg(*sums)


def answer(wide: DataFrame, league: DataFrame, k=S.SHRINK_K, floor: int = S.MIN_SAMPLE, by=("league",)) -> DataFrame:
    """Walk the rungs per (team, bucket) and shrink toward the league."""
    pick = ", ".join(f"{_rate(x, '{g}')} as {x}" for x in RATES)
    arms = " ".join(f"when n{g} >= {floor} then struct({g} as rung, n{g} as n, {pick.replace('{g}', str(g))})" for g in (1, 2, 3))
    nothing = "struct(5 as rung, null as n, null as pass, null as success, null as explosive)"
    found = (wide.join(league, list(by), "left").selectExpr(
        *by, "team", "down", "band", "zone", f"{KEY} as key", "n1", "n2", "n3", "global_rate",
        f"buckets[{KEY}] as b", *[f"o_{x}" for x in RATES], f"case {arms} else {nothing} end as hit"))
    sized = found.selectExpr(
        *by, "team", "down", "band", "zone", "key", "n1", "n2", "n3", "global_rate", "hit.rung as rung",
        "b.n as league_n", "b.pass as situation_rate", "coalesce(hit.n, b.n, 0) as sample_size",
        f"case when hit.rung = 5 then 0.0D else {r(S.weight_sql('hit.n', k), 4)} end as shrink_weight",
        f"case hit.rung when 2 then concat({DIST}, '_~', zone) when 3 then {DIST} else key end as matched_key",
        *[f"hit.{x} as {x}_raw" for x in RATES], *[f"coalesce(b.{x}, o_{x}) as league_{x}" for x in RATES])
    return sized.selectExpr(
        *by, "team", "key", "down", "band", "zone", "rung", "matched_key", "sample_size", "shrink_weight",
        f"{S.confidence_sql('shrink_weight')} as confidence", "pass_raw as pass_rate_raw", "league_pass as league_pass_rate",
        *[f"{r(S.shrink_sql(f'{x}_raw', 'shrink_weight', f'league_{x}'), 4)} as {x}_rate" for x in RATES],
        "success_raw", "explosive_raw", "league_success", "league_explosive", "n1", "n2", "n3", "league_n",
        "global_rate", "situation_rate")


def ladder(plays: DataFrame, half_life=1.0, k=S.SHRINK_K, by=("league",), team: str = "offense") -> DataFrame:
    """Plays in, one shrunk answer per (team, bucket) out."""
    return ladder_of(fine_cells(plays, team, by), half_life, k, by)


def ladder_of(fine: DataFrame, half_life=1.0, k=S.SHRINK_K, by=("league",)) -> DataFrame:
    cells = decayed(fine, half_life, by)
    return answer(widened(cells, by), league_summary(cells, by), k, by=by)


def export_rows(answers: DataFrame, by=("league",)) -> DataFrame:
    """Shipped cells: 3-decimal rates and the attribution flag on rungs 1 to 3."""
    return (answers.filter("rung in (1, 2, 3) and pass_rate is not null")
            .selectExpr(*by, "team", "key", f"{r('pass_rate', 3)} as pass_rate", f"{r('pass_rate_raw', 3)} as pass_rate_raw",
                        "sample_size", "shrink_weight", "rung", f"{r('league_pass_rate', 3)} as league_rate", "confidence", "league_n")
            .withColumn("can_attribute", S.can_attribute("pass_rate", "league_rate", "shrink_weight")))


CELL = "struct(pass_rate, pass_rate_raw, sample_size, shrink_weight, rung, can_attribute)"


def cell_bytes() -> Column:
    """Uncompressed size of one shipped cell as JSON text."""
    return F.expr(f"length(to_json({CELL})) + length(key) + 4")


def export_documents(cells: DataFrame, by=("league",)) -> DataFrame:
    """One JSON document per team; a team never holds more than the 60 buckets."""
    return (cells.groupBy(*by, "team")
            .agg(F.count("*").alias("cells"),
                 F.expr(f"to_json(map_from_entries(sort_array(collect_list(struct(key, {CELL} as cell))))) as document")))


def trim_to_budget(cells: DataFrame, usage: DataFrame, budget: int, by=("league",)) -> DataFrame:
    """Keep what fits: everything if it fits, else only attributable cells, and of
    those whole buckets, the most used first.  At most 60 buckets per league
    reach the window."""
    from pyspark.sql import Window as W

    sized = cells.withColumn("bytes", cell_bytes())
    per = (sized.groupBy(*by, "key")
           .agg(F.sum("bytes").alias("all_bytes"),
                F.sum(F.when(F.col("can_attribute"), F.col("bytes")).otherwise(0)).alias("kept_bytes"))
           .join(usage, [*by, "key"], "left"))
    whole = W.partitionBy(*by)
    upward = whole.orderBy(F.coalesce("league_n", F.lit(0)).desc(), F.col("key").desc())
    plan = per.select(*by, "key", (F.sum("all_bytes").over(whole) <= budget).alias("fits"),
                      (F.sum("kept_bytes").over(upward) <= budget).alias("bucket_fits"))
    return (sized.join(plan, [*by, "key"])
            .filter(F.col("fits") | (F.col("can_attribute") & F.col("bucket_fits")))
            .drop("fits", "bucket_fits", "bytes"))
