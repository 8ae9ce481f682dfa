"""Game series, CUSUM splits with permutation tests, and matching of the splits to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import situation as S
from ..functions.numbers import r
from ..scale import hash_draw
from ..session import cut_lineage

# Detector settings.
MIN_SEG, PERMUTATIONS, ALPHA, MIN_GAMES, TOLERANCE = 6, 999, 0.05, 20, 2


def with_expected(plays: DataFrame, by=()) -> DataFrame:
    """Eligible plays with the league rate of their bucket (60 rows per league)."""
    el = S.eligible(plays).selectExpr("*", f"{S.bucket_sql()} as bucket").filter("bucket is not null")
    rates = el.groupBy(*by, "bucket").agg(F.expr("avg(int(is_pass)) as expected"))
    return el.join(rates, [*by, "bucket"])


def game_series(plays: DataFrame, team="offense", by=()) -> DataFrame:
    """One row per team and game: plays, raw and expected pass rate, adjusted rate, index.

    Plays are counted per bucket before the rates are joined; the window sees a
    team's games, not its plays."""
    el = S.eligible(plays).selectExpr(*by, f"{team} as team", "season", "week", "game_id", f"{S.bucket_sql()} as bucket", "int(is_pass) as p").filter("bucket is not null")
    cells = el.groupBy(*by, "team", "season", "week", "game_id", "bucket").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    rates = cells.groupBy(*by, "bucket").agg(F.expr("sum(p) / sum(n) as rate"))
    games = cells.join(rates, [*by, "bucket"]).groupBy(*by, "team", "season", "week", "game_id").agg(
        F.sum("n").alias("n"), F.expr("sum(p) / sum(n) as raw"), F.expr("sum(n * rate) / sum(n) as expected"))
    at = F.row_number().over(W.partitionBy(*by, "team").orderBy("season", "week", "game_id")) - 1
    return games.withColumn("adj", F.expr("raw - expected")).withColumn("idx", at)


def season_starts(series: DataFrame) -> DataFrame:
    return series.groupBy("team", "season").agg(F.min("idx").alias("at"))


def cusum(rows: DataFrame, keys, order="idx", value="adj", weight="n") -> DataFrame:
    """|running sum - expected running sum|, scaled, at every split of a series."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    df = rows.withColumns({
        "pos": F.row_number().over(W.partitionBy(*keys).orderBy(order)), "size": F.count("*").over(whole),
        "wc": F.sum(weight).over(w), "sc": F.sum(F.col(value) * F.col(weight)).over(w),
        "wt": F.sum(weight).over(whole), "st": F.sum(F.col(value) * F.col(weight)).over(whole)})
    stat = "abs(sc - wc * st / wt) / sqrt(wc * (wt - wc) / wt)"
    return df.filter("pos < size").withColumn("stat", F.expr(stat)).drop("sc", "st")


def best_split(curve: DataFrame, keys, min_seg: int = MIN_SEG) -> DataFrame:
    """The legal split with the largest statistic; the first one wins a tie."""
    legal = curve.filter(f"pos >= {min_seg} and size - pos >= {min_seg}")
    return legal.groupBy(*keys).agg(F.expr("max_by(pos, struct(stat, -pos)) as pos"), F.max("stat").alias("stat"), F.max("size").alias("size"))


def permutation_test(rows: DataFrame, keys, draws: int = PERMUTATIONS, min_seg: int = MIN_SEG, salt: str = "") -> DataFrame:
    """Best split per series with the share of shuffled orders that match or beat it.

    Every (series, draw) is its own window partition, so the work spreads over
    series times draws; the observed order is draw 0 of the same job."""
    long = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    order = F.when(F.col("draw") == 0, F.struct(F.lit(0).cast("bigint"), F.col("idx"))).otherwise(
        F.struct(hash_draw(F.lit(salt), *keys, "idx", "draw"), F.col("idx")))
    curves = cusum(long.withColumn("_order", order), [*keys, "draw"], "_order")
    best = best_split(curves, [*keys, "draw"], min_seg)
    seen = best.filter("draw = 0").select(*keys, "pos", "stat", "size")
    null = best.filter("draw > 0").select(*keys, F.col("stat").alias("null_stat"))
    return seen.join(null, list(keys)).groupBy(*keys, "pos", "stat", "size").agg(
        F.expr(f"(1.0D + count_if(null_stat >= stat - 1e-12)) / {draws + 1}.0D as p"))


def segment(series: DataFrame, alpha: float = ALPHA, draws: int = PERMUTATIONS, min_seg: int = MIN_SEG,
            min_games: int = MIN_GAMES, salt: str = "") -> DataFrame:
    """Binary segmentation of all teams at once: one job per level, until no segment splits.

    Every level shortens the segments that are still open, so the levels end."""
    sized = series.select("team", "idx", "adj", "n", F.count("*").over(W.partitionBy("team")).alias("games"))
    open_rows = cut_lineage(sized.filter(f"games >= {min_games}").withColumn("start", F.lit(0)))
    found = None
    while True:
        tested = permutation_test(open_rows, ["team", "start"], draws, min_seg, salt).filter(f"p <= {alpha}")
        hits = cut_lineage(tested.selectExpr("team", "start", "start + pos as at", "stat", "p", "pos as games_before", "size - pos as games_after"))
        if hits.isEmpty():
            break
        rows = open_rows.join(hits.select("team", "start", "at"), ["team", "start"])
        means = rows.groupBy("team", "start", "at").agg(
            F.expr("sum(if(idx < at, adj * n, 0)) / sum(if(idx < at, n, 0)) as adj_before"),
            F.expr("sum(if(idx >= at, adj * n, 0)) / sum(if(idx >= at, n, 0)) as adj_after"))
        level = hits.join(means, ["team", "start", "at"]).selectExpr("team", "start", "at", "stat", "p", "games_before", "games_after",
                                                                     "adj_before", "adj_after", "adj_after - adj_before as delta")
        found = level if found is None else found.unionByName(level)
        open_rows = cut_lineage(rows.withColumn("start", F.expr("if(idx < at, start, at)")).drop("at"))
    if found is None:
        spark = series.sparkSession
        return spark.createDataFrame([], "team string, start int, at int, stat double, p double, games_before int, games_after int, "
                                         "adj_before double, adj_after double, delta double")
    return found


def shuffled(series: DataFrame, salt: str = "null") -> DataFrame:
    """The same games in hash order: whatever is found in it is a false positive."""
    order = W.partitionBy("team").orderBy(hash_draw(F.lit(salt), "team", "idx"), "idx")
    return series.withColumn("idx", F.row_number().over(order) - 1)


def legal_splits(series: DataFrame, min_seg: int = MIN_SEG, min_games: int = MIN_GAMES) -> DataFrame:
    sizes = series.groupBy("team").agg(F.count("*").cast("int").alias("games")).filter(f"games >= {max(min_games, 2 * min_seg)}")
    return sizes.withColumn("at", F.expr(f"explode(sequence({min_seg}, games - {min_seg}))"))


def match_events(found: DataFrame, truth: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Nearest event within the tolerance; each event is offered at the few
    positions it can match, so the range join is an equality join."""
    near = truth.selectExpr("team", "at as event_at", "label", f"explode(sequence(at - {tolerance}, at + {tolerance})) as at")
    best = (found.select("team", "at").join(near, ["team", "at"]).groupBy("team", "at").agg(
        F.expr("min_by(struct(event_at, label), struct(abs(event_at - at), event_at)) as e")))
    return found.join(best, ["team", "at"], "left").selectExpr(*found.columns, "e is not null as matched", "e.label as event", "abs(e.event_at - at) as games_off")


def detector_quality(found: DataFrame, truth: DataFrame, series: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Precision, recall, F1 and what a random legal split would score, both per
    tested team and per detection."""
    splits = legal_splits(series)
    hits = match_events(found, truth, tolerance).agg(F.count("*").alias("detections"), F.expr("count_if(matched) as matched"))
    spans = splits.groupBy("team").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    events = truth.join(spans, "team").withColumn("reachable", F.expr(f"at between lo - {tolerance} and hi + {tolerance}"))
    caught = match_events(events.select("team", "at", "reachable"), found.selectExpr("team", "at", "'' as label").distinct(), tolerance)
    recall = caught.filter("reachable").agg(F.count("*").alias("reachable"), F.expr("count_if(matched) as detected"))
    chance_team = match_events(splits.select("team", "at"), truth, tolerance).groupBy("team").agg(F.expr("avg(int(matched)) as chance"))
    chance = chance_team.agg(F.avg("chance").alias("chance_precision"))
    per_found = found.select("team").join(chance_team, "team").agg(F.avg("chance").alias("chance_per_detection"))
    one = hits.join(F.broadcast(recall)).join(F.broadcast(chance)).join(F.broadcast(per_found))  # one row beside one row
    out = one.selectExpr("*", "matched / nullif(detections, 0) as precision", "detected / nullif(reachable, 0) as recall")
    return out.selectExpr("*", "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0D) as f1",
                          "precision / nullif(chance_precision, 0) as lift", f"{binomial_tail('matched', 'detections', 'chance_precision')} as tail_p")


def binomial_tail(hits: str, trials: str, p: str) -> str:
    """P(X >= hits) from running sums of logs; trials is the number of detections."""
    logs = f"transform(sequence(0, int({trials})), j -> if(j = 0, 0.0D, ln(double(j))))"
    fact = f"aggregate({logs}, array(0.0D), (acc, x) -> array_append(acc, element_at(acc, -1) + x))"
    term = f"exp(f[int({trials}) + 1] - f[k + 1] - f[int({trials}) - k + 1] + k * ln({p}) + ({trials} - k) * ln(1.0D - {p}))"
    total = f"aggregate(sequence(int({hits}), int({trials})), 0.0D, (acc, k) -> acc + {term})"
    body = f"aggregate(array({fact}), 0.0D, (o, f) -> o + {total})"
    return f"case when {hits} = 0 then 1.0D when {p} <= 0 then 0.0D when {p} >= 1 then 1.0D else {body} end"


def persistence(found: DataFrame, series: DataFrame, horizon: int = 8) -> DataFrame:
    """Distance from the old level in the first games and in the rest."""
    rows = found.select("team", "at", "adj_before").join(series.select("team", "idx", "adj", "n"), "team").filter("idx >= at")
    mean = lambda cond: f"sum(if({cond}, adj * n, 0)) / sum(if({cond}, n, 0)) - max(adj_before)"
    near = rows.groupBy("team", "at").agg(F.count("*").alias("games"), F.expr(f"{mean(f'idx - at < {horizon}')} as d_near"),
                                          F.expr(f"{mean(f'idx - at >= {horizon}')} as d_far")).filter(f"games >= {horizon + 4}")
    return near.agg(F.count("*").alias("changepoints"), F.expr("avg(abs(d_near)) as shift_near"), F.expr("avg(abs(d_far)) as shift_rest"),
                    F.expr("avg(abs(d_far)) / avg(abs(d_near)) as retained"), F.expr("avg(int(sign(d_far) = sign(d_near))) as same_sign"))


def modal_passers(plays: DataFrame, passer: str) -> DataFrame:
    """The passer with the most pass plays per team and game; the name breaks a tie."""
    named = S.eligible(plays).filter("is_pass").selectExpr("offense as team", "game_id", f"{passer} as passer").filter("passer is not null")
    counts = named.groupBy("team", "game_id", "passer").agg(F.count("*").alias("n"))
    return counts.groupBy("team", "game_id").agg(F.expr("min_by(passer, struct(-n, passer)) as passer"), F.max("n").alias("n"))


def handovers(series: DataFrame, passers: DataFrame, window: int = 4, gap: int = 2) -> DataFrame:
    """Games where the modal passer before and after differ; neighbours merge, the purest stays."""
    w = W.partitionBy("team").orderBy("idx")
    named = series.join(passers.select("team", "game_id", "passer"), ["team", "game_id"], "left")
    df = named.select("team", "idx", F.collect_list("passer").over(w.rowsBetween(-window, -1)).alias("b"),
                      F.collect_list("passer").over(w.rowsBetween(0, window - 1)).alias("a"),
                      F.count("*").over(w.rowsBetween(-window, -1)).alias("nb"), F.count("*").over(w.rowsBetween(0, window - 1)).alias("na"))
    mode = lambda c: f"array_min(transform(array_distinct({c}), x -> struct(-size(filter({c}, y -> y = x)) as k, x as name)))"
    marks = df.filter(f"nb = {window} and na = {window}").selectExpr("team", "idx", f"{mode('b')} as mb", f"{mode('a')} as ma").filter(
        "mb.name is not null and ma.name is not null and mb.name <> ma.name").selectExpr("team", "idx", "mb.name as before", "ma.name as after", "-(mb.k + ma.k) as purity")
    runs = (marks.withColumn("new", F.expr(f"if(idx - lag(idx) over (partition by team order by idx) <= {gap}, 0, 1)"))
            .withColumn("run", F.sum("new").over(w)))
    return runs.groupBy("team", "run").agg(F.expr("max_by(struct(idx as at, before, after, purity), struct(purity, -idx)) as m")).select("team", "m.*")


def random_splits(series: DataFrame, per_team: int, salt: str) -> DataFrame:
    """Hash-drawn legal splits of each team with the level difference across them."""
    w = W.partitionBy("team").orderBy(hash_draw(F.lit(salt), "team", "at"), "at")
    drawn = legal_splits(series).withColumn("k", F.row_number().over(w)).filter(f"k <= {per_team}")
    rows = drawn.select("team", "at").join(series.select("team", "idx", "adj", "n"), "team")
    return rows.groupBy("team", "at").agg(F.expr(
        "sum(if(idx >= at, adj * n, 0)) / sum(if(idx >= at, n, 0)) - sum(if(idx < at, adj * n, 0)) / sum(if(idx < at, n, 0)) as delta"))


def keep_after(plays: DataFrame, series: DataFrame, cuts: DataFrame) -> DataFrame:
    """Drop a team's games before its cut index; teams without a cut keep everything."""
    drop = series.select("team", "game_id", "idx").join(cuts.select("team", "cut"), "team").filter("idx < cut").selectExpr("team as offense", "game_id")
    return plays.join(drop, ["offense", "game_id"], "left_anti")
