"""Hand-made rows for the situation functions, and the exhaustive bucket sweep."""

from pyspark.sql import functions as F

from downmark.functions import labels as L
from downmark.functions import situation as S


def one(spark, **cols):
    return spark.range(1).selectExpr(*[f"{v} as {k}" for k, v in cols.items()]).collect()[0]


def test_bucket_sweep(spark):
    df = spark.range(4 * 40 * 99).selectExpr("int(id div 3960) + 1 as down", "int(id div 99) % 40 as distance", "int(id % 99) + 1 as yards_to_goal")
    row = df.select(S.bucket().alias("k")).agg(F.count_distinct("k").alias("n"), F.count("k").alias("c")).collect()[0]
    assert (row.n, row.c) == (60, 4 * 40 * 99)


def test_probe_round_trip(spark):
    assert S.bucket_table(spark).filter(S.bucket() != F.col("key")).count() == 0


def test_bucket_outside_contract(spark):
    df = spark.createDataFrame([(None, 10, 50), (5, 10, 50), (3, None, 50), (3, 6, 0), (3, -1, 50)], "down int, distance int, yards_to_goal int")
    assert df.select(S.bucket().alias("k")).filter("k is not null").count() == 0


def test_success_flag(spark):
    df = spark.createDataFrame([(2, 10, 7, True), (2, 10, 6, False), (None, 10, 50, False), (1, 10, 5, True), (4, 3, 3, True), (3, None, 9, False)],
                               "down int, distance int, yards_gained int, want boolean")
    assert df.filter(S.success_flag() != F.col("want")).count() == 0


def test_shrinkage_ends(spark):
    df = spark.createDataFrame([(30.0, 0.7, 0.5)], "n double, raw double, league double")
    row = df.select(S.shrink_weight("n", 0).alias("a"), S.shrink_weight("n", float("inf")).alias("b"), S.shrink_weight("n", 60).alias("c"),
                    S.shrink("raw", S.weight_sql("n", 60), "league").alias("d"), S.shrink("null", "0.5D", "league").alias("e")).collect()[0]
    assert (row.a, row.b) == (1.0, 0.0) and abs(row.c - 1 / 3) < 1e-12 and abs(row.d - (0.5 + 0.2 / 3)) < 1e-12 and row.e == 0.5


def test_attribution_uses_thousandths(spark):
    df = spark.createDataFrame([(0.53, 0.5, 0.36, True), (0.529, 0.5, 0.36, False), (0.9, 0.5, 0.34, False), (None, 0.5, 0.9, False)],
                               "rate double, league_rate double, weight double, want boolean")
    assert df.filter(S.can_attribute() != F.col("want")).count() == 0


def test_text_clock(spark):
    rows = [("(7:05) run", 425), ("(15:00) x", 900), ("(15:01) x", None), ("(1:75) x", None), ("run (7:05)", None), (None, None)]
    df = spark.createDataFrame(rows, "play_text string, want int")
    assert df.filter(f"not ({L.text_clock()}) <=> want").count() == 0


def test_classify(spark):
    rows = [("Rush", "run for 3", "rush", "table"), ("Pass Reception", "NO PLAY", "penalty", "explicit-no-play"), ("Timeout", "", "drop", "admin"),
            ("Fumble", "Smith run, sacked later", "rush", "text"), ("Odd", "returned (Joe Kick)", "drop", "unknown-type-unresolved"),
            ("Safety", "nothing said", "drop", "unresolved"), ("Rush", "run. Original Play: no play", "rush", "table"), (None, "punt away", "special", "unknown-type-text")]
    df = spark.createDataFrame(rows, "play_type_raw string, play_text string, c string, h string")
    bad = L.classified(df).filter("category <> c or how <> h").collect()
    assert bad == []


def test_conversion_is_three_valued(spark):
    rows = [("Rush", "run for 3", 3, 3, True), ("Rush", "run, fumbled", 9, 3, None), ("Sack", "sacked", None, 3, None), ("Sack", "sacked", -3, 3, False),
            ("Pass Interception Return", "x", 0, 3, False), ("Passing Touchdown", "x", None, 3, True), ("Punt", "x", 40, 3, None)]
    df = spark.createDataFrame(rows, "play_type_raw string, play_text string, yards_gained int, distance int, want boolean")
    assert df.filter(f"not ({L.college_conversion()}) <=> want").count() == 0
