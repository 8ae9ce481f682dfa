"""Clustered bootstraps and placebo samples with reproducible hash draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..scale import hash_draw, with_position
from ..session import cut_lineage
from .scoring import loss

REPS = 2000


def cluster_losses(scored: DataFrame, cluster: str, a="pred", b="base_situation", by=("league",)) -> DataFrame:
    return scored.groupBy(*by, F.col(cluster).alias("cluster")).agg(
        F.expr(f"sum({loss(a)} - {loss(b)}) as diff"), F.sum("plays").alias("n"))


def paired_bootstrap(clusters: DataFrame, reps: int = REPS, by=("league",), salt: str = "boot") -> DataFrame:
    """Interval of the mean paired difference, whole clusters resampled.

    Clusters are numbered in hash order of their name; slot i of a draw reads
    cluster number hash(draw, i) mod count.  A draw's slots are rows, joined to
    the cluster sums by number, so neither draws nor clusters meet in one task.
    The cluster sums, which every branch reads, are worked out once."""
    clusters = cut_lineage(clusters)
    named = clusters.withColumn("_h", F.md5(F.col("cluster").cast("string"))).withColumn("_block", F.substring("_h", 1, 2))
    numbered = with_position(named, by, "_block", ["_h", "cluster"], "number").select(*by, "number", "diff", "n")
    total = clusters.groupBy(*by).agg(F.count("*").alias("clusters"), F.expr("sum(diff) / sum(n) as difference"))
    slots = numbered.select(*by, F.col("number").alias("slot")).join(total.select(*by, "clusters"), list(by))
    drawn = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn(
        "number", hash_draw(F.lit(salt), *by, "draw", "slot") % F.col("clusters") + 1)
    means = drawn.join(numbered, [*by, "number"]).groupBy(*by, "draw").agg(F.expr("sum(diff) / sum(n) as estimate"))
    ends = means.groupBy(*by).agg(F.expr("percentile(estimate, array(0.025D, 0.975D)) as q"))
    return ends.join(total, list(by)).selectExpr(
        *by, "clusters", "difference", "q[0] as low", "q[1] as high",
        "case when q[1] < 0 then 'better' when q[0] > 0 then 'worse' else 'not established' end as verdict")


def downsample(plays: DataFrame, keep: DataFrame, key="offense", id_col="play_id", salt: str = "placebo") -> DataFrame:
    """Each team cut to its given number of plays, picked in hash order."""
    h = plays.withColumn("_h", F.md5(F.concat_ws("|", F.lit(salt), id_col))).withColumn("_block", F.substring("_h", 1, 3))
    ranked = with_position(h, [key], "_block", ["_h", id_col], "_k")
    return ranked.join(keep.select(key, "keep_n"), key, "left").filter("keep_n is null or _k <= keep_n").drop("_h", "_block", "_k", "keep_n")
