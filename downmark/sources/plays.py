"""The play schema, and reading and writing of play tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import situation as S
from ..scale import with_position, with_previous

# The 23 columns of the unified play table.
COLUMNS = {
    "league": "string", "season": "smallint", "week": "tinyint", "game_id": "string", "play_id": "string",
    "play_index": "int", "offense": "string", "defense": "string", "period": "tinyint", "clock_seconds": "smallint",
    "down": "tinyint", "distance": "tinyint", "yards_to_goal": "tinyint", "play_type_raw": "string", "is_pass": "boolean",
    "is_rush": "boolean", "is_special": "boolean", "is_penalty_only": "boolean", "yards_gained": "tinyint", "value": "float",
    "success": "boolean", "score_diff": "tinyint", "play_text": "string",
}
LEAGUES = ("cfb", "nfl")
REQUIRED = ("league", "season", "game_id", "play_id", "play_index", "offense", "defense", "period")
RANGES = {"season": (1999, 2099), "week": (0, 25), "period": (1, 10), "clock_seconds": (0, 900), "down": (1, 4),
          "distance": (0, 99), "yards_to_goal": (1, 99), "yards_gained": (-99, 99), "score_diff": (-99, 99)}
FLAGS = ("is_pass", "is_rush", "is_special", "is_penalty_only")
SOURCE_COLUMNS = ("season", "week", "game_id", "play_id", "order_sequence", "posteam", "defteam", "qtr",
                  "quarter_seconds_remaining", "down", "ydstogo", "yardline_100", "play_type", "play_type_nfl",
                  "two_point_attempt", "yards_gained", "epa", "desc", "score_differential")
PAYLOAD = ("id string, gameId string, driveNumber int, playNumber int, playType string, playText string, period int, "
           "clock struct<minutes int, seconds int>, offense string, defense string, home string, offenseScore int, "
           "defenseScore int, down int, distance int, yardsToGoal int, yardsGained int, ppa double")
POSTSEASON_OFFSET = 15
EXACT_COPY = ("game_id", "period", "clock_seconds", "play_type_raw", "play_text", "down", "distance", "yards_to_goal")


def conform(df: DataFrame) -> DataFrame:
    """The 23 columns in order and type; a missing or extra column is an error."""
    missing, extra = set(COLUMNS) - set(df.columns), set(df.columns) - set(COLUMNS)
    if missing or extra:
        raise ValueError(f"schema mismatch: missing={sorted(missing)} unexpected={sorted(extra)}")
    return df.selectExpr(*[f"try_cast({c} as {t}) as {c}" for c, t in COLUMNS.items()])


def rules(columns=None, ranges=RANGES) -> dict[str, str]:
    """Rule name to the SQL condition that breaks it."""
    out = {f"{c}_null": f"{c} is null" for c in REQUIRED}
    out["league_domain"] = f"league not in ({L.quoted(LEAGUES)})"
    out.update({f"{c}_range": f"{c} not between {lo} and {hi}" for c, (lo, hi) in ranges.items()})
    return out


def violations(df: DataFrame, checks=None) -> DataFrame:
    """One row per rule with the count of rows that break it, in one pass."""
    checks = checks or rules()
    one = df.agg(*[F.expr(f"count_if({cond}) as {name}") for name, cond in checks.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in checks)
    return one.selectExpr(f"stack({len(checks)}, {pairs}) as (rule, violations)")


def validate(df: DataFrame) -> DataFrame:
    """Raise when the table breaks the contract; the one collected row is the counts."""
    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if types != list(COLUMNS.items()):
        raise TypeError(f"columns differ from the play schema: {types}")
    bad = violations(df).filter("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations} rows" for r in bad))
    return df


def write_plays(df: DataFrame, path: str) -> None:
    validate(df).write.mode("overwrite").partitionBy("league", "season").parquet(path)


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return validate(spark.read.schema(schema).parquet(path).select(*COLUMNS))


def read_season_plays(spark: SparkSession, paths, columns=SOURCE_COLUMNS) -> DataFrame:
    """One parquet per season; only the named columns are read."""
    return spark.read.parquet(*paths).select(*columns)


def read_week_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """JSON arrays named ``<year>_<week>_<type>.json``; the name carries the partition."""
    name = "regexp_extract(_metadata.file_name, '(\\\\d+)_(\\\\d+)_([a-z]+)', {})"
    raw = spark.read.schema(PAYLOAD).json(folder, multiLine=True)
    return stored_week(raw.selectExpr("*", f"int({name.format(1)}) as season", f"int({name.format(2)}) as source_week",
                                      f"{name.format(3)} as season_type"))


def stored_week(df: DataFrame) -> DataFrame:
    """Postseason weeks sort after the regular season."""
    return df.selectExpr("*", f"source_week + if(season_type = 'postseason', {POSTSEASON_OFFSET}, 0) as week").drop("source_week")


def first_copies(df: DataFrame, keys=EXACT_COPY, order=("season", "week", "drive", "play_no", "play_id")) -> DataFrame:
    """Exact copies reduced to the first one, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    ordered = list(order) + [c for c in rest if c not in order]
    return (df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"), F.count("*").alias("copies"))
            .select(*keys, "_first.*", "copies"))


def shape_payload(df: DataFrame) -> DataFrame:
    """Source records to classified play rows, the drop category left out."""
    text_clock, clock = L.text_clock("playText"), L.structured_clock()
    no_down = f"coalesce(playType in ({L.quoted(L.NO_DOWN)}), false)"
    rows = L.classified(df.drop("category", "how"), "playType", "playText").filter("category <> 'drop'").selectExpr(
        "season", "week", "gameId as game_id", "id as play_id", "offense", "defense", "period",
        f"coalesce({text_clock}, {clock}) as clock_seconds", f"if({no_down}, null, {L.in_range('down', 1, 4)}) as down",
        f"if({no_down}, null, {L.in_range('distance', 0, 99)}) as distance", f"{L.in_range('yardsToGoal', 1, 99)} as yards_to_goal",
        "playType as play_type_raw", "category", "how",
        "greatest(-99, least(99, yardsGained)) as yards_gained", "abs(yardsGained) > 99 as clamped", "ppa as value",
        "playText as play_text", "driveNumber as drive", "playNumber as play_no", "home", "offenseScore as off_score",
        "defenseScore as def_score")
    return rows.selectExpr("*", "category = 'pass' as is_pass", "category = 'rush' as is_rush",
                           "category = 'special' as is_special", "category = 'penalty' as is_penalty_only")


def with_play_index(df: DataFrame, block: str, order, game="game_id") -> DataFrame:
    """0-based order of a play in its game."""
    return with_position(df, [game], block, order, "_at").withColumn("play_index", F.expr("int(_at - 1)")).drop("_at")


def with_presnap_score(df: DataFrame, block: str, order, game="game_id", offense="offense", home="home",
                       off_score="off_score", def_score="def_score") -> DataFrame:
    """Score before the snap from the offense's side: the source states it after the play."""
    at_home = f"{offense} = {home}"
    sides = df.selectExpr("*", f"if({at_home}, {off_score}, {def_score}) as _h", f"if({at_home}, {def_score}, {off_score}) as _a")
    before = with_previous(sides, [game], block, order, {"_ph": "_h", "_pa": "_a"})
    lead = "(coalesce(_ph, 0) - coalesce(_pa, 0))"
    return before.withColumn("presnap_diff", F.expr(f"greatest(-99, least(99, if({at_home}, {lead}, -{lead})))")).drop("_h", "_a", "_ph", "_pa")


def shape_source(df: DataFrame) -> DataFrame:
    """Professional source rows to play rows; administrative rows are left out."""
    live = df.filter(f"not coalesce({L.ADMIN_ROW}, false)")
    flags = L.source_flags()
    return live.selectExpr(
        "season", "week", "game_id", f"{L.plain_id('play_id')} as play_id", "order_sequence", "posteam as offense",
        "defteam as defense", "qtr as period", "quarter_seconds_remaining as clock_seconds", "down",
        "if(down is not null, ydstogo, null) as distance", "yardline_100 as yards_to_goal", "play_type as play_type_raw",
        *[f"{sql} as {name}" for name, sql in flags.items()], "yards_gained", "epa as value",
        "score_differential as score_diff", "desc as play_text")


def season_window(now: str, size: int) -> list[int]:
    """Seasons roll over in July."""
    if size < 1:
        raise ValueError("window must be at least 1 season")
    year, month = int(now[:4]), int(now[5:7])
    last = year if month >= 7 else year - 1
    return list(range(last - size + 1, last + 1))


def split_partitions(calendar: DataFrame, now: str) -> DataFrame:
    """Weeks that are final or live at ``now``; weeks not started are left out."""
    state = f"case when end_at <= timestamp_ntz '{now}' then 'final' when start_at <= timestamp_ntz '{now}' then 'live' end"
    return calendar.selectExpr("*", f"{state} as state").filter("state is not null")


def present_seasons(df: DataFrame, wanted) -> DataFrame:
    """The wanted seasons that have rows."""
    asked = df.sparkSession.createDataFrame([(int(s),) for s in wanted], "season int")
    return df.select(F.col("season").cast("int").alias("season")).distinct().join(asked, "season")
