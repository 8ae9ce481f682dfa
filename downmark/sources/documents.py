"""Nested documents (games, coaches, rosters, journals, scoreboards) as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L

TEAM = "struct<id string, abbreviation string, location string, name string, displayName string, shortDisplayName string>"
SPOT = ("struct<down int, distance int, yardLine int, yardsToEndzone int, downDistanceText string, "
        "shortDownDistanceText string, possessionText string, team struct<id string>>")
REPORT = ("struct<id string, sequenceNumber string, type struct<id string, text string, abbreviation string>, text string, "
          "awayScore int, homeScore int, period struct<number int>, clock struct<displayValue string>, scoringPlay boolean, "
          f"isPenalty boolean, isTurnover boolean, statYardage int, scoreValue int, start {SPOT}, `end` {SPOT}, "
          "scoringType struct<name string>, pointAfterAttempt struct<text string, value int>, airYards int, yardsAfterCatch int>")
DRIVE = f"struct<id string, plays array<{REPORT}>>"
SUMMARY = (f"header struct<id string, season struct<year int, type int>, competitions array<struct<id string, date string, "
           f"competitors array<struct<id string, homeAway string, score string, team {TEAM}>>>>>, "
           f"drives struct<previous array<{DRIVE}>, current {DRIVE}>")
COACH = ("id bigint, firstName string, lastName string, hireDate string, "
         "seasons array<struct<year int, school string, conference string, games int>>")
ATHLETE = ("struct<id string, fullName string, displayName string, shortName string, firstName string, lastName string, jersey string>")
ROSTER = f"team struct<id string>, season struct<year int>, athletes array<struct<position string, items array<{ATHLETE}>>>"
SCOREBOARD = ("events array<struct<id string, date string, state string, competitors array<struct<homeAway string, "
              "score string, team struct<abbreviation string, displayName string>>>>>")
JOURNAL = ("key string, meta struct<league string, gameId string, teams array<struct<id string, abbreviation string>>>, "
           "sources array<struct<revisionId string, playId string, observedAt bigint, report string>>, "
           "releases array<struct<playId string, revisionId string, at bigint>>, "
           "shown array<struct<id string, kind string, shownAt bigint, basisPlayId string, visibility string>>, "
           "observations array<struct<id string, kind string, shownId string, rating string, playId string, at bigint>>")


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One document per file, declared schema."""
    return spark.read.schema(schema).json(folder, multiLine=True)


def parse_json(df: DataFrame, schema: str, column="document") -> DataFrame:
    """Documents held as text in a column."""
    return df.selectExpr(f"from_json({column}, '{schema}') as d").select("d.*")


def game_reports(summaries: DataFrame, *keep) -> DataFrame:
    """One row per report in source order, with its drive; the running drive comes last."""
    drives = "concat(coalesce(drives.previous, array()), if(drives.current is null, array(), array(drives.current)))"
    outer = summaries.selectExpr(*keep, "header.id as game_id", f"posexplode({drives}) as (drive_at, drive)")
    return outer.selectExpr(*keep, "game_id", "drive_at", "drive.id as drive_id", "posexplode(drive.plays) as (play_at, report)")


def coach_seasons(records: DataFrame, year: str | None = None) -> DataFrame:
    """One row per coach, school and season; ``year`` keeps the file's own season."""
    rows = records.selectExpr("id as coach_id", "trim(concat_ws(' ', firstName, lastName)) as coach",
                              "substring(coalesce(hireDate, ''), 1, 10) as hire_date", "explode(seasons) as s")
    out = rows.selectExpr("s.year as year", "s.school as school", "s.conference as conference", "coach_id", "coach",
                          "hire_date", "coalesce(s.games, 0) as games")
    return out if year is None else out.filter(f"year = {year}")


def roster_athletes(rosters: DataFrame) -> DataFrame:
    """Identities of all rosters: id and a name are required, jerseys are one or two digits."""
    flat = rosters.selectExpr("team.id as team_id", "season.year as season", "explode(flatten(athletes.items)) as a")
    jersey = "if(trim(a.jersey) rlike '^[0-9]{1,2}$', string(int(trim(a.jersey))), null)"
    return flat.selectExpr(
        "team_id", "season", "trim(a.id) as athlete_id", "nullif(trim(a.fullName), '') as full_name",
        "nullif(trim(a.displayName), '') as display_name", "nullif(trim(a.shortName), '') as short_name", f"{jersey} as jersey",
    ).filter("coalesce(athlete_id, '') <> '' and coalesce(full_name, display_name) is not null")


def roster_conflicts(athletes: DataFrame) -> DataFrame:
    """Ids that stand for different people in one roster."""
    content = "to_json(struct(full_name, display_name, short_name, jersey))"
    return (athletes.groupBy("team_id", "season", "athlete_id")
            .agg(F.expr(f"min({content}) <> max({content}) as conflict")).filter("conflict").drop("conflict"))


def journal_tables(journals: DataFrame) -> dict[str, DataFrame]:
    """The four append-only tables of exported sessions."""
    base = journals.selectExpr("key as game_key", "meta.league as league", "meta.gameId as game_id", "sources", "releases", "shown", "observations")
    return {name: base.selectExpr("game_key", "league", "game_id", f"inline({name})")
            for name in ("sources", "releases", "shown", "observations")}


def scoreboard_games(boards: DataFrame) -> DataFrame:
    """One row per game with both sides."""
    side = "filter(e.competitors, c -> c.homeAway = '{}')[0]"
    rows = boards.selectExpr("explode(events) as e")
    return rows.selectExpr("e.id as game_id", "e.date as game_date", "e.state as state",
                           *[f"{side.format(s)}.team.displayName as {s}" for s in ("home", "away")],
                           *[f"try_cast({side.format(s)}.score as int) as {s}_score" for s in ("home", "away")])


def search_games(games: DataFrame, terms: str) -> DataFrame:
    """Games whose teams contain every term, accents and case folded."""
    hay = L.norm_name("concat_ws(' ', home, away)")
    words = L.norm_name("'" + terms.replace("'", "\\'") + "'")
    return games.filter(f"forall(split({words}, ' '), t -> contains({hay}, t))")
