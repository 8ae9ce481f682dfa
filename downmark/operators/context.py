"""Context and identity models on counted cells, their tuning and calibration.

A prediction depends on league, bucket, context, identity and identity bucket
only, so train and held-out plays are counted per such cell first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import r
from ..session import cut_lineage
from .scoring import INF, brier, over_grid

# Grids and the half-life of the context models.
CONTEXT_K = (10.0, 30.0, 100.0, 300.0, 1000.0)
IDENTITY_K = (30.0, 60.0, 200.0, 600.0, 2000.0, INF)
HALF_LIFE = 2.0


def context_cells(plays: DataFrame, identity="offense", by=("league",), extra=()) -> DataFrame:
    """Counts per season, identity, bucket and context; unknown parts are left out."""
    df = S.eligible(plays).selectExpr(
        *by, "season", f"{identity} as identity", f"{S.bucket_sql()} as bucket", f"{S.CONTEXT} as context",
        f"{S.distance_key_sql()} as identity_bucket", "int(is_pass) as p", *extra)
    keep = [c.split(" as ")[-1] for c in extra]
    return (df.filter("context is not null").groupBy(*by, "season", "identity", "bucket", "context", "identity_bucket", *keep)
            .agg(F.count("*").alias("plays"), F.sum("p").alias("passes")))


def weighted(cells: DataFrame, reference: int) -> DataFrame:
    w = S.recency_sql(reference, HALF_LIFE)
    return cells.selectExpr("*", f"plays * {w} as wn", f"passes * {w} as wp", f"{w} as w")


def fit_context(train: DataFrame, reference: int, feature="context", by=("league",)) -> dict[str, DataFrame]:
    """Bucket priors (k = 60 toward the overall rate) and decayed context sums."""
    rows = weighted(train, reference)
    b = ", ".join(by)
    buckets = rows.groupBy(*by, "bucket").agg(F.sum("wn").alias("n"), F.sum("wp").alias("total"))
    # at most 60 buckets per league reach this window
    prior = buckets.selectExpr(*by, "bucket", "n", f"sum(total) over (partition by {b}) / sum(n) over (partition by {b}) as overall", "total").selectExpr(
        *by, "bucket", f"(total + {S.SHRINK_K}D * overall) / (n + {S.SHRINK_K}D) as prior", "overall")
    table = rows.groupBy(*by, feature).agg(F.sum("wn").alias("c_n"), F.sum("wp").alias("c_total"))
    return {"prior": prior, "table": table, "overall": prior.groupBy(*by).agg(F.max("overall").alias("o_rate"))}


def predict_context(model, cells: DataFrame, k="100.0D", feature="context", by=("league",)) -> DataFrame:
    """Adds ``base``: the context rate pulled toward its bucket's prior with strength k."""
    df = (cells.join(model["prior"].drop("overall"), [*by, "bucket"], "left").join(model["table"], [*by, feature], "left")
          .join(model["overall"], list(by), "left"))
    out = f"(coalesce(c_total, 0.0D) + {k} * coalesce(prior, o_rate)) / (coalesce(c_n, 0.0D) + {k})"
    return df.withColumn("base", F.expr(out)).drop("prior", "c_n", "c_total", "o_rate")


def fit_identity(train_with_base: DataFrame, reference: int, by=("league",)) -> DataFrame:
    """Decayed residual sums per identity and identity bucket."""
    w = S.recency_sql(reference, HALF_LIFE)
    return (train_with_base.filter("identity is not null").groupBy(*by, "identity", "identity_bucket")
            .agg(F.expr(f"sum(plays * {w}) as i_n"), F.expr(f"sum((passes - plays * base) * {w}) as i_total"), F.sum("plays").alias("i_plays")))


def predict_identity(offsets: DataFrame, cells_with_base: DataFrame, k="200.0D", by=("league",)) -> DataFrame:
    offset = f"if({k} = double('infinity') or i_n is null, 0.0D, i_total / (i_n + {k}))"
    df = cells_with_base.join(offsets.drop("i_plays"), [*by, "identity", "identity_bucket"], "left")
    return df.withColumn("pred", F.expr(f"greatest(0.001D, least(0.999D, base + {offset}))")).drop("i_n", "i_total")


def pick(curve: DataFrame, name: str, by=("league",)) -> DataFrame:
    """Lowest score; the larger k wins a tie."""
    return curve.groupBy(*by).agg(F.expr(f"min_by({name}, struct({r('brier', 12)}, -{name})) as {name}"))


def tune(train: DataFrame, validation: DataFrame, reference: int, by=("league",)) -> DataFrame:
    """Context k, then identity k, both chosen on the validation cells; one row per league."""
    model = fit_context(train, reference, by=by)
    held = predict_context(model, over_grid(validation, CONTEXT_K, "ck"), "ck", by=by)
    best = pick(held.groupBy(*by, "ck").agg(F.expr(f"{brier('base')} as brier")), "ck", by)
    with_k = lambda cells: predict_context(model, cells.join(best, list(by)), "ck", by=by)
    offsets = fit_identity(with_k(train), reference, by)
    scored = predict_identity(offsets, over_grid(with_k(validation), IDENTITY_K, "ik"), "ik", by)
    return pick(scored.groupBy(*by, "ik").agg(F.expr(f"{brier('pred')} as brier")), "ik", by).join(best, list(by))


def fit_predict(train: DataFrame, held: DataFrame, ks: DataFrame, reference: int, by=("league",)) -> DataFrame:
    """Refit with the chosen constants and predict the held-out cells."""
    model = fit_context(train, reference, by=by)
    with_k = lambda cells: predict_context(model, cells.join(ks, list(by)), "ck", by=by)
    return predict_identity(fit_identity(with_k(train), reference, by), with_k(held), "ik", by)


def fit_sigmoid(scored: DataFrame, by=("league",), steps: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """Slope and intercept of the calibration per league by Newton steps, until they stand still.

    Each step is one aggregate over the counted cells; only the two parameters
    per league come back to the driver.  A league whose steps do not settle, or
    whose cells do not determine a line, has no parameters (null)."""
    x = S.logit_sql("pred")
    cells = cut_lineage(scored.selectExpr(*by, "plays", "passes", f"{x} as x"))
    spark = scored.sparkSession
    groups = [tuple(row) for row in cells.select(*by).distinct().collect()]
    at = {g: (1.0, 0.0) for g in groups}
    kinds = ", ".join(f"{c} string" for c in by) + ", slope double, intercept double"
    moving, failed = set(groups), set()
    for _ in range(steps):
        params = spark.createDataFrame([(*g, *v) for g, v in at.items()], kinds)
        q = "(1.0D / (1.0D + exp(-(slope * x + intercept))))"
        sums = cells.join(F.broadcast(params), list(by)).groupBy(*by).agg(
            F.expr(f"sum(x * (passes - plays * {q})) as ga"), F.expr(f"sum(passes - plays * {q}) as gb"),
            F.expr(f"sum(plays * x * x * {q} * (1 - {q})) as haa"), F.expr(f"sum(plays * x * {q} * (1 - {q})) as hab"),
            F.expr(f"sum(plays * {q} * (1 - {q})) as hbb")).collect()
        for s in sums:
            g = tuple(s[c] for c in by)
            det = s.haa * s.hbb - s.hab * s.hab
            if not det > 0:
                failed.add(g)
            elif g in moving:
                a, b = at[g]
                da, db = (s.hbb * s.ga - s.hab * s.gb) / det, (s.haa * s.gb - s.hab * s.ga) / det
                at[g] = (a + da, b + db)
                if max(abs(da), abs(db)) < tolerance:
                    moving.discard(g)
        if not moving - failed:
            break
    lost = moving | failed
    return spark.createDataFrame([(*g, *((None, None) if g in lost else v)) for g, v in at.items()], kinds)


def protocol(plays: DataFrame, year: int, by=("league",)) -> DataFrame:
    """before -> tune -> calibrate -> test, each part later than the one before;
    returns the test cells with the uncalibrated and calibrated prediction."""
    # the plays are read and counted once; parts, fits and Newton steps read the kept cells
    cells = cut_lineage(context_cells(plays.filter(f"season <= {year}"), by=by, extra=("week",)))
    before, tuning = cells.filter(f"season < {year - 1}"), cells.filter(f"season = {year - 1} and week <= 9")
    late, test = cells.filter(f"season = {year - 1} and week > 9"), cells.filter(f"season = {year}")
    ks = cut_lineage(tune(before, tuning, year - 2, by))
    base = before.unionByName(tuning)
    params = fit_sigmoid(fit_predict(base, late, ks, year - 1, by), by)
    out = fit_predict(base.unionByName(late), test, ks, year - 1, by)
    return out.join(F.broadcast(params), list(by)).withColumn("calibrated", F.expr(S.calibrated_sql("pred", "slope", "intercept")))


def assign_callers(plays: DataFrame, assignments: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Caller and tenure by team and season; exceptions clear one game of a team."""
    flat = assignments.selectExpr("team as offense", "explode(seasons) as season", "caller", "tenure")
    cleared = exceptions.selectExpr("game_id", "team as offense", "true as cleared").distinct()
    df = plays.join(flat, ["offense", "season"], "left").join(cleared, ["game_id", "offense"], "left")
    return df.withColumns({c: F.expr(f"if(cleared, null, {c})") for c in ("caller", "tenure")}).drop("cleared")


def overlapping_assignments(assignments: DataFrame) -> DataFrame:
    return (assignments.selectExpr("team", "explode(seasons) as season").groupBy("team", "season")
            .agg(F.count("*").alias("callers")).filter("callers > 1"))


def transfer_starts(assignments: DataFrame) -> DataFrame:
    """First season of each stint whose caller had an earlier stint elsewhere."""
    stints = assignments.selectExpr("caller", "tenure", "team", "explode(seasons) as s").groupBy("caller", "tenure", "team").agg(F.min("s").alias("start"))
    first = stints.groupBy("caller").agg(F.expr("array_sort(collect_list(struct(start, team))) as stints"))
    return stints.join(first, "caller").filter("exists(stints, x -> x.start < start and x.team <> team)").select("caller", "tenure", "team", "start")


def export_model(plays: DataFrame, by=("league",)) -> DataFrame:
    """Raw plays and games behind every context."""
    df = S.eligible(plays).selectExpr(*by, f"{S.CONTEXT} as context", "game_id").filter("context is not null")
    per_game = df.groupBy(*by, "context", "game_id").agg(F.count("*").alias("n"))
    return per_game.groupBy(*by, "context").agg(F.sum("n").alias("n"), F.count("*").alias("games"))


def subgroup_gates(scored: DataFrame, a="calibrated", b="base", by=("league",), groups=("phase", "score_band"), least=200, limit=0.01) -> DataFrame:
    """Brier per subgroup and whether the candidate stays within the allowed loss."""
    out = scored.groupBy(*by, *groups).agg(F.sum("plays").alias("n"), F.expr(f"{brier(a)} as candidate"), F.expr(f"{brier(b)} as baseline"))
    return out.withColumn("passes_gate", F.expr(f"n < {least} or candidate - baseline <= {limit}D"))
