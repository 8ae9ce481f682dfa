"""What was known when: revision logs, as-of reads, links and audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..scale import with_previous, with_running

DAY = 86_400_000


def with_revision(events: DataFrame, order="event_id", block="block") -> DataFrame:
    """Keep a row when its content differs from the play's row before: A, B, A is three revisions."""
    seen = with_previous(events, ["game", "play"], block, [order], {"prev_content": "content"})
    return seen.filter("not content <=> prev_content")


def released_state(releases: DataFrame, moments: DataFrame) -> DataFrame:
    """For each shown moment: plays and revisions released by then, and how many
    plays' latest revision counts.

    Each release adds what it changes (a new play, a correction's difference), so
    the state at a moment is a running sum and no moment is joined to all plays."""
    seen = with_previous(releases, ["game", "play"], "block", ["at", "id"], {"_had": F.lit(1), "_counted": "counts"})
    steps = seen.selectExpr("game", "at", "0 as kind", "id", "if(_had is null, 1, 0) as d_plays", "1 as d_revisions", "counts - coalesce(_counted, 0) as d_counts")
    asked = moments.selectExpr("game", "at", "1 as kind", "id", "0 as d_plays", "0 as d_revisions", "0 as d_counts")
    line = steps.unionByName(asked).withColumn("slot", F.expr(f"at div {DAY}"))
    out = with_running(line, ["game"], "slot", ["at", "kind", "id"], {
        "plays": F.col("d_plays"), "revisions": F.col("d_revisions"), "counted": F.col("d_counts")})
    return out.filter("kind = 1").select("game", "id", "plays", "revisions", "counted")


def last_forecasts(forecasts: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Of a target's forecasts the last one shown strictly before the first arrival stands."""
    df = forecasts.join(arrivals, ["game", "play"], "left")
    best = (df.filter("shown_at < first_at").groupBy("game", "play").agg(F.expr("max_by(id, struct(shown_at, id)) as best_id")))
    return df.join(best, ["game", "play"], "left").selectExpr(
        "id", "game", "play", "case when first_at is null then 'no_target' when shown_at >= first_at then 'late' when id = best_id then 'kept' else 'superseded' end as status")


def link_status(links: DataFrame, moments: DataFrame) -> DataFrame:
    """Distinct targets per moment over all link sources: none, one or conflicting."""
    n = links.groupBy("id").agg(F.count_distinct("target").alias("targets"), F.min("target").alias("target"))
    return moments.select("id").join(n, "id", "left").selectExpr(
        "id", "case when coalesce(targets, 0) = 0 then 'missing' when targets = 1 then 'linked' else 'conflict' end as status", "if(targets = 1, target, null) as target")


def field_changes(shown: DataFrame, final: DataFrame, fields) -> DataFrame:
    """Full join on the play: consistent, enriched, changed or unmatched, with the changed fields."""
    a = shown.select("game", "play", *[F.col(f).alias(f"s_{f}") for f in fields], F.lit(1).alias("_s"))
    b = final.select("game", "play", *[F.col(f).alias(f"f_{f}") for f in fields], F.lit(1).alias("_f"))
    changed = "array_compact(array(" + ", ".join(f"if(s_{f} is not null and not s_{f} <=> f_{f}, '{f}', null)" for f in fields) + "))"
    added = " or ".join(f"(s_{f} is null and f_{f} is not null)" for f in fields)
    return a.join(b, ["game", "play"], "full").selectExpr(
        "game", "play", f"case when _s is null or _f is null then 'unmatched' when size({changed}) > 0 then 'changed' when {added} then 'enriched' else 'consistent' end as status",
        f"if(_s is null or _f is null, 0, size({changed})) as changes")


def repeated_keys(rows: DataFrame, key: str, window: int = 6) -> DataFrame:
    """Rows whose key occurred in the ``window`` rows just before.

    One window per (game, block) gathers the neighbours inside a block; the last
    ``window`` keys of each block are carried over to the blocks after it, which
    may each hold fewer rows than the window reaches back."""
    inner = W.partitionBy("game", "block").orderBy("event_id")
    local = rows.withColumn("_near", F.collect_list(F.struct(F.col(key).alias("k"))).over(inner.rowsBetween(-window, -1)))
    last = rows.select("game", "block", "event_id", F.struct(F.col(key).alias("k")).alias("_k")).withColumn(
        "_back", F.row_number().over(W.partitionBy("game", "block").orderBy(F.desc("event_id")))).filter(F.col("_back") <= window)
    edges = last.groupBy("game", "block").agg(F.expr("transform(array_sort(collect_list(struct(event_id, _k))), x -> x._k) as _edge"))
    before = W.partitionBy("game").orderBy("block").rowsBetween(-window, -1)
    carry = edges.select("game", "block", F.flatten(F.collect_list("_edge").over(before)).alias("_far"))
    joined = local.join(carry, ["game", "block"], "left").withColumn("_all", F.concat(F.coalesce("_far", F.array().cast("array<struct<k:string>>")), "_near"))
    recent = f"slice(_all, greatest(size(_all) - {window} + 1, 1), {window})"
    return joined.withColumn("repeated", F.expr(f"exists({recent}, x -> coalesce(x.k = {key}, false))")).drop("_near", "_far", "_all")


def link_calls(calls: DataFrame, results: DataFrame, slack: int = 5) -> DataFrame:
    """A call to the first released result of the same game, team and down whose spot and distance are near.

    Distance is cut into steps of ``slack``; a call looks at its own and the two
    neighbouring steps, so the tolerant match is an equality join."""
    near = calls.selectExpr("*", f"explode(sequence(distance div {slack} - 1, distance div {slack} + 1)) as step")
    r = results.selectExpr("game", "team", "down", "distance as r_distance", "ytg as r_ytg", "at as r_at", "result_id", f"distance div {slack} as step")
    hit = near.join(r, ["game", "team", "down", "step"]).filter(f"abs(distance - r_distance) <= {slack} and abs(ytg - r_ytg) <= {slack} and r_at > at")
    best = hit.groupBy("call_id").agg(F.expr("min_by(result_id, struct(r_at, result_id)) as result_id"))
    return calls.select("call_id").join(best, "call_id", "left")


def forecast_cohorts(scored: DataFrame, by=("league", "cohort"), least_plays=2000, least_games=20) -> DataFrame:
    """Scores only where a cohort is large enough."""
    out = scored.groupBy(*by, "game_id").agg(F.sum("plays").alias("p"), F.sum("loss").alias("l")).groupBy(*by).agg(
        F.sum("p").alias("plays"), F.count("*").alias("games"), F.expr("sum(l) / sum(p) as b"))
    return out.selectExpr(*by, "plays", "games", f"if(plays >= {least_plays} and games >= {least_games}, b, null) as brier")


def practice_exposure(attempts: DataFrame) -> DataFrame:
    """Attempts on the same target before each one."""
    out = with_running(attempts, ["target"], "block", ["opened_at", "id"], {"_n": F.lit(1), "_right": F.expr("int(right)")})
    return out.withColumns({"prior_attempts": F.expr("_n - 1"), "prior_right": F.expr("_right - int(right)")}).drop("_n", "_right")
