"""Play-shaped views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import situation as S


# Declared schemas: no footer-reading job per table and query.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf}/{name}.parquet")


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("qty"), "l_returnflag", "l_linestatus")


def plays(spark: SparkSession, sf: str) -> DataFrame:
    """One row per play.  Copies of a play are reduced before the joins, so a
    play copied very often shrinks on the map side."""
    first = (raw_lines(spark, sf).groupBy("l_orderkey", "l_linenumber")
             .agg(F.min(F.struct("l_shipdate", "l_partkey", "l_suppkey", "qty", "l_returnflag", "l_linestatus")).alias("r"))
             .select("l_orderkey", "l_linenumber", "r.*"))
    return shape(spark, sf, first)


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """The same view with every source row kept."""
    return shape(spark, sf, raw_lines(spark, sf))


def shape(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    """Orders meet their customers first, so that lines are shuffled for one join only: that with orders.

    Suppliers are read without their names' table, so that Spark sees how small they are."""
    names = table(spark, sf, "nation").select("n_nationkey", "n_name")
    side = lambda key, team: names.selectExpr(f"n_nationkey as {key}", f"n_name as {team}")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    asked = o.join(c, o.o_custkey == c.c_custkey).join(side("c_nationkey", "defense"), "c_nationkey").drop("c_custkey", "o_custkey")
    df = (lines.join(s, lines.l_suppkey == s.s_suppkey).join(side("s_nationkey", "offense"), "s_nationkey")
          .join(asked, lines.l_orderkey == asked.o_orderkey))
    return df.selectExpr(*BASE).selectExpr("*", *DERIVED)


BASE = [
    "if(l_orderkey % 2 = 0, 'cfb', 'nfl') as league",
    "year(l_shipdate) as season",
    "int(1 + floor((dayofyear(l_shipdate) - 1) / 25.0D)) as week",
    "concat(string(l_orderkey), '-', string(l_linenumber)) as play_id",
    "offense", "defense",
    "int(1 + l_partkey % 4) as period",
    "int((l_orderkey * 7 + l_partkey * 13) % 901) as clock_seconds",
    "int(1 + (l_linenumber - 1) % 4) as down",
    "int(1 + qty % 12) as distance",
    "int(1 + l_partkey % 99) as yards_to_goal",
    """case when l_returnflag = 'N' and o_orderpriority = '1-URGENT' then 'special'
        when l_returnflag = 'N' and o_orderpriority = '5-LOW' then 'penalty'
        when l_returnflag = 'A' then 'pass' when l_returnflag = 'R' then 'rush'
        when l_linestatus = 'O' then 'pass' else 'rush' end as category""",
    "int(l_orderkey % 23) - 5 as yards_gained",
    "int(l_partkey % 41) as off_score_post", "int(l_orderkey % 37) as def_score_post",
    "o_orderstatus", "qty", "l_orderkey as ok", "l_partkey as pk", "l_suppkey as sk", "l_shipdate as shipped",
]

DERIVED = [
    "concat_ws('-', offense, string(season), string(week)) as game_id",
    """case when pk % 50 = 0 then 'Fumble Recovery (Own)' when pk % 53 = 0 then 'Mystery' when pk % 59 = 0 then 'Timeout'
        when category = 'penalty' then 'Penalty' when category = 'special' then 'Punt' when category = 'rush' then 'Rush'
        when ok % 23 > 5 then 'Pass Reception' else 'Pass Incompletion' end as play_type_raw""",
    "category = 'pass' as is_pass", "category = 'rush' as is_rush",
    "category = 'special' as is_special", "category = 'penalty' as is_penalty_only",
    "off_score_post - def_score_post as score_diff",
    """case when down = 1 then yards_gained >= 0.5D * distance when down = 2 then yards_gained >= 0.7D * distance
        else yards_gained >= distance end as success""",
    """concat('(', lpad(string(int(floor(clock_seconds / 60.0D))), 2, '0'), ':', lpad(string(clock_seconds % 60), 2, '0'), ') ',
        case when category = 'penalty' then 'PENALTY AAA holding 10 yards from AAA20. NO PLAY.'
             when category = 'special' then '#9 K.Foot punt 40 yards'
             when category = 'rush' and qty = 50 then '#1 Q.Back takes a knee'
             when category = 'rush' then concat('#', string(20 + sk % 5), ' R.Back', string(sk % 5), ' rush middle for ', string(yards_gained), ' yards')
             when yards_gained > 0 then concat('Shotgun #1 Q.Back pass complete short left to #', string(80 + sk % 7), ' W.Out', string(sk % 7), ' for ', string(yards_gained), ' yards')
             else concat('#1 Q.Back pass incomplete deep right to #', string(80 + sk % 7), ' W.Out', string(sk % 7)) end) as play_text""",
    "date(shipped) as day",
]


def payload(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Plays as the college source writes them."""
    df = plays(spark, sf) if rows is None else rows
    return df.selectExpr(
        "season", "week", "play_id as id", "game_id as gameId", "int(dayofyear(shipped)) as driveNumber", "int(ok % 1000) as playNumber",
        "play_type_raw as playType", "if(pk % 3 = 0, substring(play_text, 9), play_text) as playText", "period",
        "named_struct('minutes', int(clock_seconds div 60), 'seconds', int(clock_seconds % 60 + if(pk % 5 = 0, 1, 0))) as clock",
        "offense", "defense", "least(offense, defense) as home", "off_score_post as offenseScore", "def_score_post as defenseScore",
        "down", "distance - if(pk % 11 = 0, 20, 0) as distance", "yards_to_goal - if(pk % 13 = 0, 50, 0) as yardsToGoal",
        "yards_gained * if(pk % 17 = 0, 10, 1) as yardsGained", "double(yards_gained) / 4 as ppa")


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Plays as the professional source writes them."""
    return plays(spark, sf).selectExpr(
        "season", "week", "game_id", "double(ok * 10 + int(split(play_id, '-')[1])) as play_id", "ok as order_sequence", "offense as posteam",
        "defense as defteam", "period as qtr", "clock_seconds as quarter_seconds_remaining", "if(pk % 19 = 0, null, down) as down",
        "if(pk % 19 = 0, 0, distance) as ydstogo", "yards_to_goal as yardline_100",
        "case when pk % 59 = 0 then null when category = 'pass' then 'pass' when category = 'rush' then 'run' when category = 'special' then 'punt' else 'no_play' end as play_type",
        "if(pk % 7 = 0, 'TIMEOUT', 'PLAY') as play_type_nfl", "double(if(pk % 61 = 0, 1, 0)) as two_point_attempt", "yards_gained",
        "double(yards_gained) / 4 as epa", "play_text as desc", "score_diff as score_differential", "shipped", "day")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome flags of the professional source, one row per play."""
    return plays(spark, sf).selectExpr(
        "game_id", "play_id", "if(pk % 23 = 0, defense, offense) as posteam",
        "case o_orderstatus when 'F' then 1 when 'O' then 0 end as first_down", "int(yards_to_goal <= 9) as touchdown",
        "if(pk % 2 = 0, offense, defense) as td_team", "int(pk % 29 = 0) as fumble_lost", "int(pk % 31 = 0) as interception",
        "int(is_penalty_only or pk % 37 = 0) as penalty")


def game_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One nested document per order: lines 1-3 are a drive, 4-5 a drive, the rest the running one.

    An order has at most seven lines once copies are removed."""
    report = """named_struct('id', play_id, 'sequenceNumber', string(line), 'text', play_text, 'awayScore', def_score_post,
        'homeScore', off_score_post, 'statYardage', yards_gained)"""
    rows = plays(spark, sf).selectExpr("ok", "int(split(play_id, '-')[1]) as line", "*").selectExpr(
        "ok", f"struct(line, {report} as report) as r")
    part = lambda cond: f"transform(filter(rs, r -> {cond}), r -> r.report)"
    docs = rows.groupBy("ok").agg(F.sort_array(F.collect_list("r")).alias("rs")).selectExpr(
        "ok", f"{part('r.line <= 3')} as a", f"{part('r.line in (4, 5)')} as b", f"{part('r.line > 5')} as c")
    return docs.selectExpr("""to_json(named_struct('header', named_struct('id', string(ok)), 'drives', named_struct(
        'previous', filter(array(named_struct('id', concat(ok, '-1'), 'plays', a), named_struct('id', concat(ok, '-2'), 'plays', b)), d -> size(d.plays) > 0),
        'current', if(size(c) > 0, named_struct('id', concat(ok, '-3'), 'plays', c), null)))) as document""")


def coach_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """School, year, coach and games from customers: changes every third year."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    rows = c.selectExpr("n_name as school", "c_custkey", "explode(sequence(1995, 2001)) as year").selectExpr(
        "school", "year", "bigint(c_custkey % 7 + year div 3) as coach_id")
    return rows.groupBy("school", "year", "coach_id").agg(F.count("*").cast("int").alias("games")).selectExpr(
        "school", "year", "coach_id", "games",
        "concat(string(year - int(coach_id % 2)), '-', lpad(string(1 + coach_id % 12), 2, '0'), '-01') as hire_date",
        "concat('Coach ', string(coach_id)) as coach")


def coach_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Coach records; a coach's list holds at most one entry per school and year."""
    return (coach_seasons(spark, sf).groupBy("coach_id").agg(
        F.expr("sort_array(collect_list(struct(year, school, 'C' as conference, games))) as seasons"))
        .selectExpr("to_json(struct(coach_id as id, 'Coach' as firstName, string(coach_id) as lastName, concat('1990-01-0', string(1 + coach_id % 9), 'T00:00') as hireDate, seasons)) as document"))


def roster_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Rosters in pages of at most 400 customers; a few ids appear twice with other content."""
    item = """named_struct('id', string(c_custkey - if(c_custkey % 97 = 0, 25, 0)), 'fullName', concat('Player ', c_name), 'displayName', c_name,
        'shortName', concat('P. ', string(c_custkey)), 'jersey', if(c_custkey % 10 = 3, 'x', string(c_custkey % 150)))"""
    c = table(spark, sf, "customer").withColumn("page", F.expr("c_custkey div 400"))
    return c.groupBy("c_nationkey", "page").agg(F.expr(f"collect_list({item}) as items")).selectExpr(
        "to_json(struct(named_struct('id', string(c_nationkey)) as team, named_struct('year', 2001) as season, array(named_struct('position', 'all', 'items', items)) as athletes)) as document")


def scoreboard_documents(spark: SparkSession, sf: str) -> DataFrame:
    games = plays(spark, sf).groupBy("game_id", "offense", "defense", "season").agg(
        F.max("off_score_post").alias("o"), F.max("def_score_post").alias("d"))
    return games.selectExpr("""to_json(struct(array(named_struct('id', concat(game_id, '/', defense), 'date', string(season), 'state', if(season < 2001, 'post', 'in'),
        'competitors', array(named_struct('homeAway', 'away', 'score', string(d), 'team', named_struct('displayName', initcap(defense))),
                             named_struct('homeAway', 'home', 'score', string(o), 'team', named_struct('displayName', initcap(replace(offense, 'I', 'Í'))))))) as events)) as document""")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a revision stream: game = user, play = the k of props."""
    return table(spark, sf, "events").selectExpr(
        "event_id", "ts", "user_id as game", "get_json_object(props, '$.k') as play", "event_type", "value",
        "bigint(unix_micros(cast(ts as timestamp)) div 1000) as at")


def journal_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Exported sessions: at most 1,000 consecutive events of one user per document."""
    e = events(spark, sf).withColumn("page", F.expr("event_id div 1000"))
    return e.groupBy("game", "page").agg(
        F.expr("sort_array(collect_list(struct(event_id, play, at, event_type, value))) as es")).selectExpr(
        """to_json(named_struct('key', concat(game, '/', page), 'meta', named_struct('league', 'nfl', 'gameId', string(game)),
        'sources', transform(es, e -> named_struct('revisionId', concat(e.play, ':', e.event_id), 'playId', e.play, 'observedAt', e.at, 'report', concat(e.event_type, '|', string(e.value)))),
        'releases', transform(es, e -> named_struct('playId', e.play, 'revisionId', concat(e.play, ':', e.event_id), 'at', e.at + 45000)),
        'shown', transform(filter(es, e -> e.event_type = 'view'), e -> named_struct('id', string(e.event_id), 'kind', 'guidance', 'shownAt', e.at, 'basisPlayId', e.play, 'visibility', 'visible')),
        'observations', transform(filter(es, e -> e.event_type = 'click'), e -> named_struct('id', string(e.event_id), 'kind', 'read_feedback', 'playId', e.play, 'at', e.at)))) as document""")
