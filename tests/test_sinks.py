"""Writers and readers that need files."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from downmark.plans import views as V
from downmark.plans.quality_queries import unified
from downmark.sources import documents as D
from downmark.sources import plays as P
from downmark.sources import sinks

SF = "/root/testdata/sf0.001"


def test_write_read_and_reject(spark):
    good = P.conform(unified(spark, SF).filter("season >= 1999").withColumn("play_index", F.lit(0)))
    path = tempfile.mkdtemp() + "/plays"
    P.write_plays(good, path)
    assert P.read_plays(spark, path).count() == good.count()
    with pytest.raises(ValueError):
        P.write_plays(good.withColumn("down", F.lit(7).cast("tinyint")), path + "2")
    with pytest.raises(ValueError):
        P.conform(good.drop("down"))


def test_week_payload_files(spark):
    folder = tempfile.mkdtemp()
    for name, text in (("1999_3_regular", "run for 4"), ("1999_1_postseason", "NO PLAY")):
        with open(f"{folder}/{name}.json", "w") as fh:
            json.dump([{"id": "1", "gameId": "g", "playType": "Rush", "playText": text, "down": 1, "distance": 120, "yardsGained": 140,
                        "clock": {"minutes": 1}}], fh)
    got = {r.week: r for r in P.shape_payload(P.read_week_payloads(spark, folder)).collect()}
    assert sorted(got) == [3, 16] and got[3].is_rush and got[16].is_penalty_only
    assert got[3].distance is None and got[3].yards_gained == 99 and got[3].clock_seconds == 60


def test_publish_and_freeze(spark):
    folder = tempfile.mkdtemp()
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "key string, n int, generated string")
    assert sinks.publish_if_changed(df, folder + "/p", None)
    assert not sinks.publish_if_changed(df.withColumn("generated", F.lit("y")), folder + "/p", df)
    mark = sinks.fingerprint(df)
    assert mark == sinks.fingerprint(df.orderBy(F.desc("key")))
    sinks.freeze(spark, folder + "/f", {"model": df}, {"input": (df, mark)})
    with pytest.raises(Exception):
        sinks.freeze(spark, folder + "/f", {"model": df}, {"input": (df, mark)})
    with pytest.raises(ValueError):
        sinks.freeze(spark, folder + "/g", {"model": df}, {"input": (df.limit(1), mark)})


def test_summary_file(spark):
    folder = tempfile.mkdtemp()
    doc = {"header": {"id": "7"}, "drives": {"previous": [{"id": "d1", "plays": [{"id": "1"}, {"id": "2"}]}], "current": {"id": "d2", "plays": [{"id": "3"}]}}}
    with open(folder + "/g.json", "w") as fh:
        json.dump(doc, fh)
    rows = D.game_reports(D.read_json(spark, folder, D.SUMMARY)).selectExpr("drive_id", "report.id as id").collect()
    assert [tuple(r) for r in rows] == [("d1", "1"), ("d1", "2"), ("d2", "3")]


def test_predictions_partitioned(spark):
    path = tempfile.mkdtemp() + "/p"
    sinks.write_predictions(V.plays(spark, SF).select("play_id", "season"), path)
    assert spark.read.parquet(path).count() == 4599
