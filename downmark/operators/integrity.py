"""Checks that compare a table with its rebuild, and content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import r


def read_exported(cells: DataFrame, answers: DataFrame, asked: DataFrame, by=("league",)) -> DataFrame:
    """What a reader of the shipped rows gets for each asked (team, bucket)."""
    league = answers.groupBy(*by, "key").agg(F.max("league_n").alias("base_n"), F.max("situation_rate").alias("base_rate"))
    own = cells.select(*by, "team", "key", "pass_rate", "pass_rate_raw", "sample_size", "shrink_weight", "rung", "can_attribute")
    return (asked.join(own, [*by, "team", "key"], "left").join(league, [*by, "key"], "left").selectExpr(
        *by, "team", "key", "plays", "coalesce(rung, 5) as rung", "coalesce(sample_size, base_n, 0) as sample_size",
        "coalesce(shrink_weight, 0.0D) as shrink_weight", f"coalesce(pass_rate, {r('base_rate', 3)}) as pass_rate",
        "pass_rate_raw", "coalesce(can_attribute, false) as can_attribute"))


def table_parity(cells: DataFrame, answers: DataFrame, asked: DataFrame, by=("league",)) -> DataFrame:
    """Plays for which the shipped row and the ladder's own answer differ."""
    on = [*by, "team", "key"]
    want = answers.select(*on, F.col("rung").alias("w_rung"), F.col("pass_rate").alias("w_rate"),
                          F.col("sample_size").alias("w_n"), F.col("shrink_weight").alias("w_w"))
    both = read_exported(cells, answers, asked, by).join(want, on)
    bad = f"rung < 5 and (rung <> w_rung or sample_size <> w_n or shrink_weight <> w_w or pass_rate <> {r('w_rate', 3)})"
    return both.groupBy(*by).agg(
        F.count("*").alias("reads"), F.sum("plays").alias("plays"), F.expr(f"sum(if({bad}, plays, 0)) as mismatched"),
        F.expr("sum(if(rung < 5, plays, 0)) as served"))


def ladder_invariants(answers: DataFrame, floor: int = S.MIN_SAMPLE, by=("league",)) -> DataFrame:
    """Counts of broken rules; every count but ``cells`` must be zero."""
    same = r("shrink_weight * pass_rate_raw + (1.0D - shrink_weight) * league_pass_rate", 4)
    return answers.groupBy(*by).agg(
        F.count("*").alias("cells"), F.expr("count_if(rung = 4) as retired_rung"),
        F.expr(f"count_if(rung < 5 and sample_size < {floor}) as below_floor"),
        F.expr("count_if(rung = 5 and (shrink_weight <> 0 or pass_rate_raw is not null)) as league_with_team"),
        F.expr(f"count_if(rung < 5 and {same} <> pass_rate) as identity_breaks"),
        F.expr(f"count_if(confidence <> {S.confidence_sql('shrink_weight')}) as flag_breaks"),
        F.expr("count_if(n1 > n2 or n2 > n3) as narrowing"))


def rounding_gate(cells: DataFrame, answers: DataFrame, by=("league",)) -> DataFrame:
    """Cells that 3-decimal rounding moved across the attribution gate."""
    on = [*by, "team", "key"]
    fine = (f"shrink_weight >= {S.MEDIUM_CUT} and abs(floor(pass_rate * 10000.0D + 0.5D) - floor(league_pass_rate * 10000.0D + 0.5D)) "
            f">= {S.ATTRIBUTION_GAP * 10}")
    want = answers.selectExpr(*on, f"{fine} as fine", f"abs(abs(pass_rate - league_pass_rate) - {S.ATTRIBUTION_GAP / 1000}D) as gap")
    return cells.select(*on, "can_attribute").join(want, on).groupBy(*by).agg(
        F.count("*").alias("cells"), F.expr("count_if(can_attribute and not fine) as promoted"),
        F.expr("count_if(not can_attribute and fine) as demoted"),
        F.expr("max(if(can_attribute <> fine, gap, 0.0D)) as worst_gap"))


def lookup_parity(sample: DataFrame, answers: DataFrame, rungs: DataFrame, floor: int = S.MIN_SAMPLE, by=("league",)) -> DataFrame:
    """Compare the wide answer with one walked rung by rung, per sampled play."""
    def rung(n, key):
        return rungs.filter(f"rung = {n} and sample_size >= {floor}").select(
            *by, "team", F.col("key").alias(key), F.struct(F.lit(n).alias("rung"), "pass_rate").alias(f"r{n}"))
    league = rungs.filter("rung = 5").select(*by, "key", F.struct(F.lit(5).alias("rung"), "pass_rate").alias("r5"))
    walked = (sample.join(rung(1, "key"), [*by, "team", "key"], "left").join(rung(2, "pooled"), [*by, "team", "pooled"], "left")
              .join(rung(3, "by_distance"), [*by, "team", "by_distance"], "left").join(league, [*by, "key"], "left")
              .withColumn("direct", F.coalesce("r1", "r2", "r3", "r5")))
    both = walked.join(answers.selectExpr(*by, "team", "key", "rung as joined_rung", "pass_rate as joined_rate"), [*by, "team", "key"], "left")
    bad = "not (direct.rung <=> coalesce(joined_rung, 5) and direct.pass_rate <=> coalesce(joined_rate, direct.pass_rate))"
    return both.agg(F.count("*").alias("rows_checked"), F.expr(f"count_if({bad}) as mismatches"))


def row_hash(columns) -> str:
    """SHA-256 of the canonical (name-sorted) JSON of a row."""
    return f"sha2(to_json(struct({', '.join(sorted(columns))})), 256)"


def content_hash(df: DataFrame, columns, by=()) -> DataFrame:
    """Order-free fingerprint per group: the row hashes' 32-bit words are summed,
    so no group is collected or sorted, and equal multisets of rows agree."""
    words = [f"bigint(conv(substring(hx, {1 + 8 * i}, 8), 16, 10))" for i in range(4)]
    sums = df.selectExpr(*by, f"{row_hash(columns)} as hx").groupBy(*by).agg(
        F.count("*").alias("row_count"), *[F.expr(f"sum(decimal({w})) as s{i}") for i, w in enumerate(words)])
    return sums.selectExpr(*by, "row_count", "sha2(concat_ws('|', string(row_count), string(s0), string(s1), string(s2), string(s3)), 256) as content_hash")
