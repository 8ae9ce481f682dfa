"""Profiles and rule checks over a play table; every check returns its violating rows or counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import situation as S
from ..functions.numbers import div, r
from ..sources.plays import EXACT_COPY, FLAGS, first_copies


def profile(df: DataFrame) -> DataFrame:
    """One row of table facts; teams count both sides of the ball."""
    ok = "not is_special and not is_penalty_only"
    counts = df.agg(F.count("*").alias("plays"), F.count_distinct("league").alias("leagues"), F.count_distinct("season").alias("seasons"),
                    F.count_distinct("game_id").alias("games"), F.expr(f"count_if({ok}) as eligible"),
                    F.expr("count_if(down is null) as null_down"), F.expr(f"{r(f'avg(if({ok}, int(is_pass), null))', 4)} as pass_rate"),
                    F.expr(f"{r(f'avg(if({ok}, int(success), null))', 4)} as success_rate"))
    teams = df.selectExpr("explode(array(offense, defense)) as team").agg(F.count_distinct("team").alias("teams"))
    return counts.join(F.broadcast(teams))  # one row beside one row


def duplicates(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def missing(df: DataFrame, columns) -> DataFrame:
    """Null counts of features that must be complete, and unbucketed rows."""
    one = df.agg(*[F.expr(f"count_if({c} is null) as {c}") for c in columns], F.expr(f"count_if({S.bucket_sql()} is null) as bucket"))
    names = [*columns, "bucket"]
    return one.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (feature, missing)")


def season_profile(df: DataFrame, by=("league",)) -> DataFrame:
    e = S.ELIGIBLE
    return df.groupBy(*by, "season").agg(
        F.count("*").alias("plays"), F.expr(f"count_if({e}) as eligible"), F.count_distinct("game_id").alias("games"),
        F.count_distinct("offense").alias("teams"), F.expr(f"{r(f'avg(if({e}, int(is_pass), null))')} as pass_rate"))


def shared_groups(df: DataFrame, group="game_id", part="part") -> DataFrame:
    """Groups that reach into more than one time part."""
    return (df.select(group, part).distinct().groupBy(group).agg(F.count("*").alias("parts"), F.min(part).alias("first_part"),
                                                               F.max(part).alias("last_part")).filter("parts > 1"))


def part_order(df: DataFrame, part="part") -> DataFrame:
    """Time range of each part, and whether it starts after the part before."""
    spans = df.groupBy(part).agg(F.min(S.stamp()).alias("low"), F.max(S.stamp()).alias("high"))
    return spans.selectExpr("*", f"coalesce(low > lag(high) over (order by {part}), true) as after_previous")  # one row per part


def flag_overlap(df: DataFrame) -> DataFrame:
    """Rows per raw type with no flag, and with more than one."""
    total = " + ".join(f"int({f})" for f in FLAGS)
    return df.groupBy("play_type_raw").agg(
        F.count("*").alias("plays"), F.expr(f"count_if({total} = 0) as unflagged"), F.expr(f"count_if({total} > 1) as overlapping"))


def classification_table(df: DataFrame) -> DataFrame:
    """Source type x category x method, with the copies removed before counting.

    Copies have one type, so their counts add up to the rows received; rows are read once."""
    kept = first_copies(df.select(*EXACT_COPY, "play_id").filter("play_type_raw is not null"), order=("play_id",))
    split = (L.classified(kept).groupBy("play_type_raw", "category", "how")
             .agg(F.count("*").alias("kept"), F.sum("copies").alias("copies")))
    return split.selectExpr("play_type_raw", "category", "how", "kept", "sum(copies) over (partition by play_type_raw) as received",
                            "sum(copies - kept) over (partition by play_type_raw) as copies_removed")


# The situations every ingest is eyeballed on.
SITUATIONS = {"third_long": "down = 3 and distance >= 8", "third_short": "down = 3 and distance <= 3",
              "first_ten": "down = 1 and distance = 10", "second_long": "down = 2 and distance >= 8", "fourth": "down = 4"}


def sanity_rates(df: DataFrame, by=("league",)) -> DataFrame:
    ok = df.filter("not is_special and not is_penalty_only")
    parts = []
    for name, cond in SITUATIONS.items():
        parts += [F.expr(f"count_if({cond}) as n_{name}"), F.expr(f"avg(if({cond}, int(is_pass), null)) as p_{name}")]
    rows = ", ".join(f"'{n}', n_{n}, p_{n}" for n in SITUATIONS)
    return (ok.groupBy(*by).agg(*parts).selectExpr(*by, f"stack({len(SITUATIONS)}, {rows}) as (situation, n, rate)")
            .selectExpr(*by, "situation", "n", f"{r('rate')} as pass_rate"))


def realigned(df: DataFrame) -> DataFrame:
    """Labels and snap clock read again from the text, next to the stored ones."""
    fresh = (L.classified(df.drop("category", "how")).withColumnRenamed("category", "new_category")
             .withColumn("new_clock", F.expr(L.text_clock())))
    moved = "new_clock is not null and not new_clock <=> clock_seconds"
    cross = lambda s: f"((clock_seconds <= {s}) <> (new_clock <= {s}))"
    phase = f"({moved}) and ((period = 4 and ({cross(120)} or {cross(300)})) or (period = 2 and {cross(120)}))"
    label = "is_pass <> (new_category = 'pass') or is_rush <> (new_category = 'rush') or is_penalty_only <> (new_category = 'penalty')"
    return fresh.selectExpr("*", f"{label} as label_changed", f"{moved} as clock_changed", f"coalesce({phase}, false) as phase_changed")


def alignment_report(df: DataFrame, by=("league",)) -> DataFrame:
    return realigned(df).groupBy(*by).agg(
        F.expr("count_if(label_changed) as labels"), F.expr(f"count_if(new_clock is not null and {S.ELIGIBLE}) as explicit_clocks"),
        F.expr(f"count_if(clock_changed and {S.ELIGIBLE}) as clocks"), F.expr(f"count_if(phase_changed and {S.ELIGIBLE}) as phases"))


def bank_violations(examples: DataFrame, practice: DataFrame) -> DataFrame:
    """Broken references of a question bank: one row per rule and offending id."""
    ids = examples.select(F.col("id").alias("_id"), F.struct("league", "game_id").alias("_game"))
    worked = ids.select(F.col("_id").alias("worked"), F.col("_game").alias("worked_game"))
    tested = ids.select(F.col("_id").alias("tested"), F.col("_game").alias("tested_game"))
    joined = practice.join(worked, "worked", "left").join(tested, "tested", "left")
    rule = lambda name, cond: joined.filter(cond).selectExpr(f"'{name}' as rule", "id")
    repeated = lambda df, name: duplicates(df, ["id"]).selectExpr(f"'{name}' as rule", "id")
    return (rule("missing_example", "worked_game is null or tested_game is null")
            .unionByName(rule("same_game", "worked_game = tested_game"))
            .unionByName(rule("bad_answer", "not array_contains(choices, answer) or size(array_distinct(choices)) <> size(choices)"))
            .unionByName(repeated(practice, "duplicate_practice")).unionByName(repeated(examples, "duplicate_example")))
