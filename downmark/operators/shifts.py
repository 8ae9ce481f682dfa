"""Coaching tenures and the size of season-to-season shifts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numbers import r
from ..scale import hash_unit, with_running

PAIR_WEIGHT = 100


#: Bands that the range of a ranked value is cut into.
BANDS = 1024


def primary_coaches(seasons: DataFrame) -> DataFrame:
    """Most games, then earliest hire; more than one coach with games marks a change inside the season."""
    return (seasons.groupBy("school", "year").agg(
        F.expr("min_by(struct(coach_id, coach, hire_date, games), struct(-games, hire_date, coach_id)) as top"),
        F.count("*").alias("listed"), F.expr("count_if(games > 0) > 1 as in_season_change"))
        .select("school", "year", "top.*", "listed", "in_season_change"))


def transitions(primary: DataFrame) -> DataFrame:
    """Consecutive seasons of a school; a coach hired before August came in the offseason.

    One row per school and season, so the join is small."""
    before = primary.selectExpr("school", "year + 1 as year", "coach_id as prev_coach", "in_season_change as prev_change")
    return primary.join(before, ["school", "year"]).selectExpr(
        "school", "year", "prev_coach", "coach_id", "coach_id <> prev_coach as changed",
        "case when coach_id = prev_coach then 'none' when hire_date < concat(string(year), '-08-01') then 'offseason' else 'in_season' end as change_kind",
        "in_season_change or prev_change as in_season_change")


def tenures(primary: DataFrame) -> DataFrame:
    """First season of the coach's current unbroken tenure (islands per school)."""
    w = W.partitionBy("school").orderBy("year")
    new = F.expr("not (coach_id <=> lag(coach_id) over (partition by school order by year)) or year - lag(year) over (partition by school order by year) <> 1")
    runs = primary.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    out = runs.withColumn("tenure_start", F.min("year").over(W.partitionBy("school", "_run")))
    return out.withColumn("regime", F.concat_ws("#", "school", F.col("tenure_start").cast("string"))).drop("_new", "_run")


def bucket_counts(fine: DataFrame) -> DataFrame:
    return fine.selectExpr("team", "season", "concat('d', string(down), '_', band, '_', zone) as bucket", "n", "n_pass").groupBy(
        "team", "season", "bucket").agg(F.sum("n").alias("n"), F.sum("n_pass").alias("n_pass"))


def season_pairs(counts: DataFrame, floor: int = 10) -> DataFrame:
    """The same bucket of a team in consecutive seasons, both with enough plays."""
    a = counts.filter(f"n >= {floor}").selectExpr("team", "season + 1 as season", "bucket", "n as n_a", "n_pass as p_a")
    b = counts.filter(f"n >= {floor}").selectExpr("team", "season", "bucket", "n as n_b", "n_pass as p_b")
    return a.join(b, ["team", "season", "bucket"])


def shift_sizes(pairs: DataFrame, by=("team", "season"), least: int = PAIR_WEIGHT) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count("*").alias("buckets"), F.expr("sum(least(n_a, n_b)) as weight"),
        F.expr("sum(least(n_a, n_b) * abs(p_a / n_a - p_b / n_b)) / sum(least(n_a, n_b)) as shift")).filter(f"weight >= {least}")


def log_factorial(k: str) -> str:
    """ln k! by Stirling's series from eight on (error below 1e-10), by a table of eight before that."""
    small = ", ".join(repr(math.lgamma(i + 1)) + "D" for i in range(8))
    x = f"double({k})"
    series = f"({x} * ln({x}) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1.0D / (12.0D * {x}) - 1.0D / (360.0D * {x} * {x} * {x}) + 1.0D / (1260.0D * pow({x}, 5)))"
    return f"if({k} < 8, element_at(array({small}), int(least({k}, 7)) + 1), {series})"


def binomial_table(n: str, p: str) -> str:
    """struct(low, high, upto): the distribution function of ``n`` trials from ``low`` on, null where nothing is left to chance.

    The probabilities are laid out in closed form over ten standard deviations round the
    mean, so a table costs the root of ``n``, not ``n``, and needs no row per trial."""
    half = f"bigint(ceil(10.0D * sqrt({n} * {p} * (1.0D - {p})))) + 10"
    middle = f"bigint(round({n} * {p}))"
    low, high = f"greatest(0L, {middle} - ({half}))", f"least(bigint({n}), {middle} + ({half}))"
    mass = f"exp({log_factorial(f'bigint({n})')} - {log_factorial('k')} - {log_factorial(f'(bigint({n}) - k)')} + k * ln({p}) + ({n} - k) * ln(1.0D - {p}))"
    upto = (f"aggregate(transform(sequence({low}, {high}), k -> {mass}), struct(0.0D as sum, cast(array() as array<double>) as upto), "
            f"(s, m) -> struct(s.sum + m as sum, array_append(s.upto, s.sum + m) as upto), s -> s.upto)")
    return f"if({n} > 0 and {p} > 0.0D and {p} < 1.0D, struct({low} as low, {high} as high, {upto} as upto), null)"


def binomial_draw(n: str, p: str, u: str, table: str) -> str:
    """The binomial count of ``n`` trials whose distribution function, given by its table, first passes ``u``: found by halving."""
    steps = ", ".join(str(1 << i) for i in range(25, -1, -1))
    passed = f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= size({table}.upto) and coalesce(get({table}.upto, at + step - 1) <= {u}, false), at + step, at))"
    return f"case when {n} = 0 or {p} <= 0.0D then 0L when {p} >= 1.0D then bigint({n}) else least({table}.high, {table}.low + {passed}) end"


def null_shift(pairs: DataFrame, draws: int = 200, by=("team", "season")) -> DataFrame:
    """The shift when nothing changed: both seasons redrawn from the pooled rate.

    One uniform per (cell, draw, side) is put through the binomial distribution function,
    so the rows are cells times draws, whatever the number of plays.  A cell's functions are
    laid out once for all draws; the cells are few bytes but much work, so they are spread
    over all partitions."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pooled = pairs.withColumn("pooled", F.expr("(p_a + p_b) / (n_a + n_b)")).select(*by, "bucket", "n_a", "n_b", "pooled").repartition(parts, *by, "bucket")
    tables = pooled.withColumns({f"_t{x}": F.expr(binomial_table(f"n_{x}", "pooled")) for x in ("a", "b")})
    rows = tables.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    for side in ("a", "b"):
        rows = rows.withColumn(f"_u{side}", hash_unit(*by, "bucket", F.lit(side), "draw"))
    drawn = rows.selectExpr(*by, "bucket", "n_a", "n_b", "draw", *[f"{binomial_draw(f'n_{x}', 'pooled', f'_u{x}', f'_t{x}')} as p_{x}" for x in ("a", "b")])
    per = shift_sizes(drawn, (*by, "draw"), 0)
    return per.groupBy(*by).agg(F.avg("shift").alias("null_shift"))


def summary(df: DataFrame, value: str, by) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D, 0.9D)) as q"),
        F.avg(value).alias("mean"), F.max(value).alias("high"), F.stddev_samp(value).alias("sd")).selectExpr(
        *by, "n", "low", "q[0] as q1", "q[1] as median", "q[2] as q3", "q[3] as p90", "mean", "high", "sd")


def rank_tests(df: DataFrame, value: str, group: str, a: str, b: str, by=()) -> DataFrame:
    """Mann-Whitney U, Cliff's delta and Cohen's d of group a over b from value counts."""
    two = df.filter(F.col(group).isin(a, b))
    levels = two.groupBy(*by, value).agg(F.expr(f"count_if({group} = '{a}') as na"), F.expr(f"count_if({group} = '{b}') as nb"))
    # bands of the value range keep the distinct values of a group apart; only band totals meet
    ends = levels.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    width = (ends["hi"] - ends["lo"]) if ends["lo"] is not None else 0.0
    band = F.floor((F.col(value) - ends["lo"]) / width * (BANDS - 1)) if width else F.lit(0)
    banded = levels.withColumn("t", F.expr("na + nb")).withColumn("_band", band.cast("int"))
    ranked = with_running(banded, list(by), "_band", [value], {"_upto": F.col("t")}).withColumn("below", F.expr("_upto - t"))
    s = ranked.groupBy(*by).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"),
                                F.expr("sum(na * (below + (t + 1) / 2.0D)) as ra"), F.expr("sum(double(t) * t * t - t) as ties"))
    moments = two.groupBy(*by).agg(*[F.expr(f"{fn}(if({group} = '{g}', {value}, null)) as {n}_{g_}") for g, g_ in ((a, "a"), (b, "b"))
                                     for fn, n in (("avg", "m"), ("var_samp", "v"))])
    s = s.join(moments, list(by)) if by else s.join(F.broadcast(moments))
    u = "ra - na * (na + 1) / 2.0D"
    s = s.withColumn("u", F.expr(u)).withColumn("sd", F.expr("sqrt(na * nb / 12.0D * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1.0D))))"))
    s = s.withColumn("z", F.expr("if(sd = 0.0D and u is not null, 0.0D, (u - na * nb / 2.0D) / nullif(sd, 0.0D))"))  # unknown where a group is empty
    return s.selectExpr(*by, "na", "nb", "u", "z", f"{normal_tail('abs(z)')} * 2.0D as p", "2.0D * u / (double(na) * nb) - 1.0D as cliffs_delta",
                        # a group of one has no spread to measure by
                        "if((na - 1) * v_a + (nb - 1) * v_b = 0.0D, 0.0D, (m_a - m_b) / nullif(sqrt(((na - 1) * v_a + (nb - 1) * v_b) / (na + nb - 2.0D)), 0.0D)) as cohens_d",
                        "m_a as mean_a", "m_b as mean_b")


def normal_tail(z: str) -> str:
    """Upper tail of the standard normal for z >= 0 by a rational approximation (error below 1.5e-7)."""
    t = f"(1.0D / (1.0D + 0.3275911D * ({z}) / sqrt(2.0D)))"
    poly = f"{t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D))))"
    return f"(0.5D * {poly} * exp(-({z}) * ({z}) / 2.0D))"


def true_drift(observed: str, noise: str) -> str:
    return f"sqrt(greatest(0.0D, ({observed}) * ({observed}) - ({noise}) * ({noise})))"
