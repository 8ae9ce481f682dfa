"""Leakage, calibration and change-point behaviour."""

from pyspark.sql import functions as F

from downmark.operators import changepoints as CP
from downmark.operators import context as X
from downmark.plans import views as V

SF = "/root/testdata/sf0.001"


def test_held_out_labels_do_not_move_the_fit(spark):
    df = V.plays(spark, SF)
    flipped = df.withColumns({"is_pass": F.expr("if(season = 2000, not is_pass, is_pass)"), "is_rush": F.expr("if(season = 2000, not is_rush, is_rush)")})
    fits = [sorted(map(tuple, X.fit_context(X.context_cells(d.filter("season < 2000")), 1999)["prior"].selectExpr("league", "bucket", "round(prior, 9)").collect())) for d in (df, flipped)]
    assert fits[0] == fits[1]


def test_sigmoid_recovers_parameters(spark):
    cells = spark.range(1, 100).selectExpr("'x' as league", "1000000L as plays", "id / 100.0D as pred").withColumn(
        "passes", F.expr("bigint(round(1000000 / (1 + exp(-(0.8D * ln(pred / (1 - pred)) + 0.3D)))))"))
    row = X.fit_sigmoid(cells).collect()[0]
    assert abs(row.slope - 0.8) < 1e-3 and abs(row.intercept - 0.3) < 1e-3


def test_segmentation_finds_a_planted_shift(spark):
    rows = [("t", i, 0.3 + (i * 7 % 5) / 100.0 if i < 20 else 0.6 + (i * 7 % 5) / 100.0, 60) for i in range(40)] + [("u", i, 0.4 + (i * 3 % 4) / 100.0, 60) for i in range(24)]
    series = spark.createDataFrame(rows, "team string, idx int, adj double, n int")
    found = CP.segment(series, draws=99).collect()
    assert [(r.team, r["at"]) for r in found if r.team == "t"][:1] == [("t", 20)]
