"""Per-game and per-team summaries of described reports, without collecting a game."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.reports import ACTION, before_ruling, drive_ending, has
from ..scale import with_island, with_last_known, with_position, with_previous, with_running
from ..session import cut_lineage


#: Whether a snap is told before the first ruling of a report.
ACTED = has(before_ruling("primary"), ACTION)


def last_revisions(reports: DataFrame, keys=("game_id", "play_id"), position="position") -> DataFrame:
    """Latest revision of each report, at the place of its first one; map-side combined."""
    rest = [c for c in reports.columns if c not in keys and c != position]
    return reports.groupBy(*keys).agg(F.max(F.struct(position, *rest)).alias("_r"), F.min(position).alias("first_position"),
                                      F.count("*").alias("revisions")).select(*keys, "first_position", "revisions", *[f"_r.{c}" for c in rest])


def kept_snaps(described: DataFrame, by=("game_id", "offense")) -> DataFrame:
    """What ``team_insights`` and ``named_plays`` read of described reports, worked out once and kept for both."""
    return cut_lineage(described.filter("action <> 'none'").select(*by, "play_id", "action", "facts", "actor", "receiver", "start_down", "start_distance", "gained", "need"))


def team_insights(described: DataFrame, by=("game_id", "offense")) -> DataFrame:
    """Early-down mix, directions, third downs and naming coverage."""
    live = described.filter("action <> 'none'")
    return live.groupBy(*by).agg(
        F.count("*").alias("plays"), F.expr("count_if(start_down <= 2) as early"), F.expr("count_if(start_down <= 2 and action = 'pass') as early_pass"),
        F.expr("count_if(start_down <= 2 and action = 'run') as early_run"), F.expr("count_if(exists(facts, f -> f like '%left')) as to_left"),
        F.expr("count_if(exists(facts, f -> f like '%middle')) as to_middle"), F.expr("count_if(exists(facts, f -> f like '%right')) as to_right"),
        F.expr("count_if(start_down = 3) as third"), F.expr("count_if(start_down = 3 and start_distance >= 7) as third_long"),
        F.expr("count_if(start_down = 3 and gained >= need) as third_made"), F.expr("count_if(actor is not null) as named"))


def named_plays(described: DataFrame, by=("game_id", "offense")) -> DataFrame:
    """A row for every use of a name: carries of the actor of a run, targets of the receiver of a pass."""
    return described.filter("action in ('run', 'pass')").selectExpr(
        *by, "play_id", "gained", "inline(array(struct('carrier' as role, if(action = 'run', actor, null) as name, true as done), "
        "struct('target' as role, if(action = 'pass', receiver, null) as name, gained > 0 as done)))").filter("name is not null")


def named_usage(described: DataFrame, by=("game_id", "offense")) -> DataFrame:
    """Targets, catches, carries and yards per name; one unknown yardage makes the sum unknown.

    The plays themselves are the rows of ``named_plays``."""
    return named_plays(described, by).groupBy(*by, "role", "name").agg(
        F.count("*").alias("uses"), F.expr("count_if(done) as completed"), F.expr("if(count_if(gained is null) = 0, sum(gained), null) as yards"),
        F.min("play_id").alias("first_play"), F.max("play_id").alias("last_play"))


def leaders(usage: DataFrame, by=("game_id", "offense"), least: int = 3, share: float = 0.4) -> DataFrame:
    """The name with the most uses, if it is frequent enough and alone at the top."""
    total = usage.groupBy(*by, "role").agg(F.sum("uses").alias("total"), F.max("uses").alias("top"))
    tied = usage.join(total, [*by, "role"]).filter("uses = top").groupBy(*by, "role").agg(
        F.count("*").alias("at_top"), F.min("name").alias("name"), F.max("uses").alias("uses"), F.max("total").alias("total"))
    return tied.filter(f"at_top = 1 and uses >= {least} and uses >= {share} * total").drop("at_top")


def drive_rows(reports: DataFrame, order=("position",)) -> DataFrame:
    """The reports of each drive with its team and what each of them counts for.

    ``reports`` are described, with movement.  The drive's team is that of its first report
    that is neither a marker, kickoff, conversion nor kick.  A kick before that (the one
    that gave the ball) and a lone refused ruling do not count; the team's own kick ends
    the drive without counting.  ``prev_end`` is where the last verified movement before
    the report ended.  What the words say is read before the rows are shuffled, and they
    are shuffled once: all that a drive decides are windows over it.
    """
    place = F.struct(*order)
    ordered = W.partitionBy("drive_id").orderBy(*order)  # one order for all windows, so a drive is sorted once
    drive = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lead = F.expr("not marker and not kickoff and not conversion")
    own_lead = lead & F.expr("outcome <> 'kick'")
    rows = reports.filter("drive_id is not null").withColumns({
        "_live": F.expr("not marker and not kickoff and not conversion and not (penalties > 0 and not accepted and not f_penalty and startswith(upper(trim(primary)), 'PENALTY'))"),
        "_acted": F.expr(f"f_penalty and {ACTED}"), "_closed": F.expr(f"nullif({drive_ending()}, '')")})
    first = F.coalesce(F.min_by(F.struct("start_team"), F.when(own_lead, place)).over(drive), F.max_by(F.struct("start_team"), F.when(lead, place)).over(drive))
    rows = rows.withColumn("_team", first).withColumn("team", F.col("_team.start_team")).drop("_team")
    rows = rows.withColumn("own", F.expr("coalesce(start_team = team, false)"))
    rows = rows.withColumn("own_kick", F.expr("_live and outcome = 'kick' and own and not f_penalty"))
    rows = rows.withColumn("_sure", F.expr("_live and not own_kick and (own or outcome <> 'kick')"))
    rows = rows.withColumn("_begin", F.min(F.when(F.col("_sure"), place)).over(drive)).withColumn("_place", place)
    rows = rows.withColumn("counted", F.expr("_sure or (_live and not own_kick and coalesce(_place > _begin, false))"))
    rows = rows.withColumn("opens", F.expr("coalesce(_place = _begin, false)")).drop("_live", "_sure", "_place", "_begin")
    rows = rows.withColumn("moved", F.expr("counted and own and movement is not null"))
    end = F.expr("if(moved, start_yards_to_goal - movement.net, null)")
    return rows.withColumn("prev_end", F.last(end, ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1)))


def drive_summary(reports: DataFrame, order=("position",)) -> DataFrame:
    """Plays, yards by plays and by penalties, actions and the end of every drive.

    Yards are null unless the drive is verified: it begins on first down, every counted
    report has a movement of the drive's team, and each begins where the one before ended.
    One unknown yardage makes the totals unknown, never a partial sum.
    """
    rows = drive_rows(reports, order)
    snap = "(action in ('run', 'pass', 'sack') or clock_play or (movement is not null and f_penalty and not wiped and _acted))"
    breaks = "prev_end is not null and ((moved and prev_end <> start_yards_to_goal) or (own_kick and not coalesce(prev_end = start_yards_to_goal, false)))"
    done = rows.withColumn("_end", F.expr("if(marker or own_kick or counted, _closed, null)"))
    own = lambda kind: F.expr(f"count_if(counted and own and action in ({kind}))")
    out = done.groupBy("drive_id").agg(
        F.first("team").alias("team"), F.expr("count_if(counted)").alias("reports"), F.expr(f"count_if(counted and {snap})").alias("plays"),
        own("'run'").alias("runs"), own("'pass'").alias("passes"), own("'sack'").alias("sacks"), own("'pass', 'sack'").alias("dropbacks"),
        F.expr("count_if(moved)").alias("movements"), F.expr("count_if(counted and not moved)").alias("unverified"),
        F.expr(f"bool_or({breaks})").alias("broken"), F.expr("coalesce(bool_or(opens and start_down = 1), false)").alias("first_down"),
        F.expr("sum(if(moved, movement.play, 0))").alias("_play"), F.expr("sum(if(moved, movement.penalty, 0))").alias("_penalty"),
        F.max_by("_end", F.when(F.col("_end").isNotNull(), F.struct(*order))).alias("ending"))
    out = out.filter("team is not null").withColumn("verified", F.expr("movements > 0 and unverified = 0 and not broken and first_down"))
    return out.selectExpr("drive_id", "team", "reports", "plays", "runs", "passes", "sacks", "dropbacks", "movements", "unverified", "not broken as continuous", "first_down", "verified",
                          "if(verified, _play + _penalty, null) as net_yards", "if(verified, _play, null) as play_yards", "if(verified, _penalty, null) as penalty_yards",
                          "ending is not null as complete", "ending")


def drive_progress(reports: DataFrame, order=("position",)) -> DataFrame:
    """The field segments of every drive: (drive_id, play_id, kind, from_yard, to_yard), a play's before its penalty's."""
    moved = drive_rows(reports, order).filter("moved")
    parts = ("filter(array(struct('play' as kind, 100 - start_yards_to_goal as from_yard, 100 - start_yards_to_goal + movement.play as to_yard), "
             "struct('penalty' as kind, 100 - start_yards_to_goal + movement.play as from_yard, 100 - start_yards_to_goal + movement.net as to_yard)), "
             "x -> if(x.kind = 'play', movement.play <> 0 or movement.penalty = 0, movement.penalty <> 0))")
    return moved.selectExpr("drive_id", "play_id", *order, f"inline({parts})")


def repeated_clocks(rows: DataFrame, block="block", order=("position",), least: int = 3) -> DataFrame:
    """Runs of consecutive scrimmage rows that show one clock."""
    runs = with_island(rows, ["game_id"], block, list(order), ["clock_key"])
    return runs.filter("clock_key is not null").groupBy("game_id", "island", "clock_key").agg(
        F.count("*").alias("reports"), F.min("position").alias("first_position")).filter(f"reports >= {least}").drop("island")


def streaks(rows: DataFrame, value: str, block="block", order=("position",)) -> DataFrame:
    """Longest run of one value per game."""
    runs = with_island(rows, ["game_id"], block, list(order), [value])
    return (runs.groupBy("game_id", "island", value).agg(F.count("*").alias("length")).groupBy("game_id")
            .agg(F.max("length").alias("longest"), F.count("*").alias("runs")))


def known_score(rows: DataFrame, block="block", order=("position",)) -> DataFrame:
    """Latest stated score at each report; a scoring row without a score makes it unknown."""
    marked = rows.withColumn("_state", F.expr("case when scoring_play and home_score is null then struct(false as known, null as h, null as a) "
                                              "when home_score is not null and away_score is not null then struct(true as known, home_score as h, away_score as a) end"))
    out = with_last_known(marked, ["game_id"], block, list(order), "_at", F.col("_state"))
    return out.selectExpr(*rows.columns, "if(_at.known, _at.h, null) as known_home", "if(_at.known, _at.a, null) as known_away")


def since_involved(rows: DataFrame, player: str, block="block", order=("position",)) -> DataFrame:
    """Team actions since each named player's last involvement, at the end of the rows."""
    placed = with_position(rows, ["game_id", "offense"], block, list(order), "_k")
    total = rows.groupBy("game_id", "offense").agg(F.count("*").alias("_n"))
    return (placed.filter(f"{player} is not null").groupBy("game_id", "offense", player).agg(F.max("_k").alias("_last"))
            .join(total, ["game_id", "offense"]).selectExpr("game_id", "offense", player, "_n - _last as actions_since"))


def replay_steps(rows: DataFrame, block="block", order=("position",)) -> DataFrame:
    """Every prefix that ends on a real report, numbered, with the first row of each period marked."""
    real = rows.filter("not marker")
    steps = with_position(real, ["game_id"], block, list(order), "step")
    first = real.groupBy("game_id", "period").agg(F.min(F.struct(*order)).alias("_first"))
    return steps.join(first, ["game_id", "period"]).withColumn("opens_period", F.struct(*order) == F.col("_first")).drop("_first")


def prefix_totals(rows: DataFrame, block="block", order=("position",)) -> DataFrame:
    """Running counts at every step of a game, by prefix sums instead of joining all earlier rows."""
    return with_running(rows, ["game_id"], block, list(order), {
        "plays_so_far": F.lit(1), "passes_so_far": F.expr("int(action = 'pass')"), "named_so_far": F.expr("int(actor is not null)")})


def observations(insights: DataFrame, leads: DataFrame, by=("game_id", "offense")) -> DataFrame:
    """Candidate observations with priorities; the best one per team and game."""
    rules = [("third_down", 90, "third >= 4 and third_made >= 0.5 * third"), ("early_pass", 70, "early >= 10 and early_pass >= 0.6 * early"),
             ("early_run", 60, "early >= 10 and early_run >= 0.6 * early"), ("direction", 50, "greatest(to_left, to_middle, to_right) >= 6")]
    options = ", ".join(f"if({cond}, struct({p} as priority, '{name}' as id), null)" for name, p, cond in rules)
    own = insights.selectExpr(*by, f"inline(array_compact(array({options})))")
    lead = leads.selectExpr(*by, "80 as priority", "concat('leader_', role) as id")
    return own.unionByName(lead).groupBy(*by).agg(F.expr("max_by(id, struct(priority, id)) as observation"), F.count("*").alias("candidates"))


#: What a moment is picked for, its condition and its order; earlier reports win ties.
MOMENTS = (("after", "gained > 0 and after > air", "-after"), ("air", "gained > 0 and air > after", "-air"), ("short", "gained >= 0 and gained < need and start_down >= 3", "0"))


def review_moments(rows: DataFrame, size: int = 3, parts: int = 32) -> DataFrame:
    """Per game ``size`` plays to look at again, none of them twice.

    ``rows`` are described reports with the yards of a catch in the air and after it where
    they are known.  Slot after slot picks the first play in its order that no slot before
    it took; what is missing is filled by the largest gains of the plays left.  Every slot
    reads the counted plays and the slots before it, so they are described once and kept.
    """
    counted = cut_lineage(rows.filter("need is not null").select("game_id", "play_id", "position", "gained", "need", "start_down", "air", "after"))
    taken = None
    for slot, cond, rank in MOMENTS[:size]:
        open_ = counted.filter(cond)
        if taken is not None:
            open_ = open_.join(taken.select("game_id", "play_id"), ["game_id", "play_id"], "left_anti")
        best = open_.groupBy("game_id").agg(F.expr(f"min_by(play_id, struct({rank} as rank, position)) as play_id")).select("game_id", F.lit(slot).alias("slot"), "play_id")
        taken = best if taken is None else taken.unionByName(best)
    left = counted.join(taken.select("game_id", "play_id"), ["game_id", "play_id"], "left_anti").withColumn("_part", F.pmod(F.xxhash64("play_id"), F.lit(parts)))
    order = [F.coalesce("gained", F.lit(0)).desc(), F.col("position")]
    left = left.withColumn("_k", F.row_number().over(W.partitionBy("game_id", "_part").orderBy(*order))).filter(F.col("_k") <= size)
    left = left.withColumn("k", F.row_number().over(W.partitionBy("game_id").orderBy(*order))).filter(F.col("k") <= size)
    have = taken.groupBy("game_id").agg(F.count("*").alias("n"))
    fill = left.join(have, "game_id", "left").filter(F.expr(f"k <= {size} - coalesce(n, 0)")).selectExpr("game_id", "concat('fill', string(k)) as slot", "play_id")
    return taken.unionByName(fill)
