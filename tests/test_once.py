"""Rows are described once, cells laid out once, and rules read a text without walking over its places."""

import math

import pytest
from pyspark.sql import functions as F

from downmark.functions import grammar as GR
from downmark.operators import games as G
from downmark.operators import shifts as SH


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drives(spark):
    return spark.range(6).selectExpr(
        "concat('d', id div 3) as drive_id", "string(id) as play_id", "id as position", "false as marker", "false as kickoff", "false as conversion", "'run' as outcome", "'run' as action",
        "'A' as start_team", "'#2 R.Back rush' as primary", "0 as penalties", "false as accepted", "false as f_penalty", "false as wiped", "false as clock_play", "false as turnover",
        "false as fourth_down_failure", "'' as kind", "false as f_touch", "'rush' as type", "false as changed", "1 as start_down", "int(60 - 4 * (id % 3)) as start_yards_to_goal",
        "named_struct('net', 4, 'play', 4, 'penalty', 0) as movement")


@pytest.mark.parametrize("summary", [G.drive_summary, G.drive_progress])
def test_drives_read_their_reports_once(spark, summary):
    assert plan(summary(drives(spark))).count("Range (") == 1


def test_drives_keep_their_figures(spark):
    rows = G.drive_summary(drives(spark)).select("drive_id", "plays", "verified", "net_yards").collect()
    assert sorted(map(tuple, rows)) == [("d0", 3, True, 12), ("d1", 3, True, 12)]


def test_moments_read_their_reports_once(spark):
    rows = spark.range(9).selectExpr("'g' as game_id", "string(id) as play_id", "id as position", "int(id) as gained", "4 as need", "3 as start_down", "int(id % 3) as air", "int(id % 2) as after")
    assert "Range (" not in plan(G.review_moments(rows))


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (10, 0.3), (200, 0.02), (5000, 0.61)])
def test_binomial_counts_by_table(spark, n, p):
    df = spark.range(1, 40).selectExpr(f"{n}L as n", f"{p}D as p", "id / 40D as u")
    got = df.withColumn("t", F.expr(SH.binomial_table("n", "p"))).selectExpr("u", f"{SH.binomial_draw('n', 'p', 'u', 't')} as x").collect()
    for row in got:
        upto, x = 0.0, 0
        while x < n:
            upto += math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p))
            if upto > row["u"]:
                break
            x += 1
        assert row["x"] == x


def test_cells_are_spread_before_they_are_drawn(spark):
    pairs = spark.range(4).selectExpr("'t' as team", "1999 as season", "string(id) as bucket", "10L as n_a", "12L as n_b", "3L as p_a", "4L as p_b")
    assert "REPARTITION_BY_NUM" in plan(SH.null_shift(pairs, 3))


@pytest.mark.parametrize("rule", [GR.yards("x"), GR.ruling("x"), GR.hurry("x"), GR.seen("x"), GR.players("x", "true")])
def test_rules_do_not_walk_over_places(rule):
    assert "sequence(" not in rule


def test_copies_are_classified_in_one_pass(spark):
    from downmark.operators import quality as Q
    rows = spark.range(6).selectExpr("'g' as game_id", "1 as period", "int(id div 2) as clock_seconds", "if(id < 4, 'Rush', 'Punt') as play_type_raw", "'a' as play_text", "1 as down", "10 as distance",
                                     "50 as yards_to_goal", "string(id) as play_id")
    table = Q.classification_table(rows)
    assert plan(table).count("Range (") == 1
    assert sorted((r.play_type_raw, r.kept, r.received, r.copies_removed) for r in table.collect()) == [("Punt", 1, 2, 1), ("Rush", 2, 4, 2)]


def test_profiles_read_their_plays_once(spark):
    from downmark.operators import history as H
    rows = spark.range(12).selectExpr("'nfl' as league", "2000 as season", "'A' as offense", "'B' as defense", "concat('g', id % 3) as game_id", "3 as down", "2 as distance", "50 as yards_to_goal", "2 as period",
                                      "500 as clock_seconds", "0 as score_diff", "id % 2 = 0 as converted", "id < 8 as is_rush", "id >= 8 as is_pass", "if(id = 5, null, int(id)) as clear_yards", "int(id) as yards_gained")
    cells = H.profile_cells(rows, min_plays=3, min_games=2)
    assert plan(cells).count("Range (") == 1
    got = [(r.side, r.team, r.games, r.n, r.conversions, r.run_n, r.run_known, r.pass_ten_plus, r.run_median, r.pass_median) for r in cells.collect()]
    assert sorted(got) == [("defense", "B", 3, 12, 6, 8, 7, 2, 3.0, 9.5), ("offense", "A", 3, 12, 6, 8, 7, 2, 3.0, 9.5)]


def test_held_out_counts_come_from_the_cells(spark):
    from downmark.operators import cells as C
    from downmark.operators import scoring as P
    rows = spark.range(40).selectExpr("'nfl' as league", "concat('T', id % 2) as offense", "int(1 + id % 5) as down", "int(id % 12) as distance", "int(id * 3) as yards_to_goal", "int(1998 + id % 3) as season", "int(1 + id % 7) as week",
                                      "id % 3 = 0 as is_pass", "id % 3 > 0 as is_rush", "false as is_special", "false as is_penalty_only", "'' as play_text", "id % 4 = 0 as success", "int(id) as yards_gained")
    counted = C.counted_cells(rows, stamp="season * 100 + week")
    ask = lambda df: sorted(tuple(r) for r in df.select("league", "team", "key", "plays", "passes", "successes", "explosives").collect())
    assert ask(P.counted(C.in_buckets(counted))) == ask(P.holdout_counts(rows))
    assert counted.agg(F.sum("n"), F.min("first_stamp"), F.max("last_stamp")).first()[:] == (40, 199801, 200007)


def test_lines_are_not_shuffled_for_suppliers_and_customers(spark, tmp_path):
    from downmark.plans import views as V
    columns = {"n_nationkey": "int(id % 3)", "n_name": "concat('N', id)", "c_custkey": "id", "c_nationkey": "int(id % 3)", "s_suppkey": "id", "s_nationkey": "int(id % 3)", "o_orderkey": "id", "o_custkey": "id % 5",
               "o_orderpriority": "'1-URGENT'", "o_orderstatus": "'F'", "l_orderkey": "id % 7", "l_partkey": "id", "l_suppkey": "id % 5", "l_linenumber": "int(id)", "l_quantity": "double(id)", "l_returnflag": "'A'",
               "l_linestatus": "'F'", "l_shipdate": "timestamp_ntz '1998-02-03 00:00:00'"}
    for name, prefix, n in (("nation", "n_", 3), ("customer", "c_", 5), ("supplier", "s_", 5), ("orders", "o_", 7), ("lineitem", "l_", 30)):
        spark.range(n).selectExpr(*[f"{v} as {c}" for c, v in columns.items() if c.startswith(prefix)]).write.parquet(f"{tmp_path}/{name}.parquet")
    df, before = V.plays(spark, str(tmp_path)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        assert "hashpartitioning(l_suppkey" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert df.count() == 30 and {(r.offense, r.defense) for r in df.filter("pk = 4").collect()} == {("N1", "N1")}


@pytest.mark.parametrize("summary", [G.drive_summary, G.drive_progress])
def test_drives_are_sorted_once(spark, summary):
    assert plan(summary(drives(spark))).count("Sort [drive_id") == 1


def test_names_and_facts_nobody_reads_are_not_looked_for(spark, monkeypatch):
    from downmark.functions import reports as R
    from downmark.plans import report_queries as RQ
    monkeypatch.setattr(R, "describe", lambda df: df)
    monkeypatch.setattr(RQ, "rows", lambda spark, sf: spark.range(1).selectExpr(
        "'#2 R.Back rush left for 3 yards' as primary", "'rush' as type", "false as marker", "false as f_penalty", "false as f_kneel", "false as f_spike", "false as f_sack", "'run' as outcome"))
    df = RQ.described(spark, "")
    assert "eligible" not in plan(df.select("action")) and "shotgun" not in plan(df.select("action"))
    assert "eligible" in plan(df.select("actor")) and "shotgun" in plan(df.select("facts"))
    row = df.first()
    assert (row.actor, row.facts, row.action) == ("#2 R.Back", ["Run to the left"], "run")


@pytest.mark.parametrize(("text", "yards"), [("#2 R.Back rush For 4 Yards", 4), ("rush for loss of 5 yards", -5), ("rush NO GAIN", 0), ("pass incomplete to #8", None), ("for 3 yards PENALTY AAA for 9 yards", 3),
                                             ("Penalty AAA for 9 yards", None), ("gained", None), (None, None)])
def test_yards_before_rulings(spark, text, yards):
    from downmark.functions import reports as R
    assert spark.createDataFrame([(text,)], "primary string").selectExpr(R.reported_yards()).first()[0] == yards


def test_protocol_counts_its_plays_once(spark):
    from downmark.operators import context as X
    rows = spark.range(600).selectExpr("'nfl' as league", "concat('T', id % 3) as offense", "int(1 + id % 4) as down", "int(1 + id % 12) as distance", "int(1 + id % 98) as yards_to_goal", "int(1996 + id % 5) as season",
                                       "int(1 + (id div 5) % 14) as week", "hash(id) % 3 = 0 as is_pass", "hash(id) % 3 <> 0 as is_rush", "false as is_special", "false as is_penalty_only", "'' as play_text",
                                       "int(id % 4 + 1) as period", "int(id * 7 % 900) as clock_seconds", "int(id % 29) - 14 as score_diff")
    got = X.protocol(rows, 2000)
    assert "Range (" not in plan(got)
    cut = lambda cond: X.context_cells(rows.filter(cond), extra=("week",))
    before, tuning, late, test = cut("season < 1999"), cut("season = 1999 and week <= 9"), cut("season = 1999 and week > 9"), cut("season = 2000")
    ks = X.tune(before, tuning, 1998)
    expected = X.fit_predict(before.unionByName(tuning).unionByName(late), test, ks, 1999)
    ask = lambda df: sorted((r.identity, r.bucket, r.context, r.week, r.plays, r.passes, round(r.pred, 9)) for r in df.collect())
    assert ask(got) == ask(expected) and len(ask(got)) > 50
