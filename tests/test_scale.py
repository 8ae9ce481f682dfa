"""Blocked ordered operators against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from downmark import scale


def rows(spark):
    rng = random.Random(3)
    data = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"), i, rng.choice([None, 1, 2, 3]), rng.choice("ab")) for i in range(900)]
    return spark.createDataFrame(data, "key string, seq int, v int, c string").withColumn("block", F.expr("seq div 50"))


def same(a, b, cols):
    pick = lambda df: sorted((tuple(r) for r in df.select("key", "seq", *cols).collect()), key=str)
    assert pick(a) == pick(b)


def test_position_and_running(spark):
    df, w = rows(spark), W.partitionBy("key").orderBy("seq")
    same(scale.with_position(df, ["key"], "block", ["seq"]), df.withColumn("position", F.row_number().over(w)), ["position"])
    same(scale.with_running(df, ["key"], "block", ["seq"], {"t": F.coalesce("v", F.lit(0))}), df.withColumn("t", F.sum(F.coalesce("v", F.lit(0))).over(w)), ["t"])


def test_previous_next_and_last_known(spark):
    df, w = rows(spark), W.partitionBy("key").orderBy("seq")
    same(scale.with_previous(df, ["key"], "block", ["seq"], {"p": "seq"}), df.withColumn("p", F.lag("seq").over(w)), ["p"])
    same(scale.with_previous(df, ["key"], "block", ["seq"], {"p": "v"}, forward=True), df.withColumn("p", F.lead("v").over(w)), ["p"])
    same(scale.with_last_known(df, ["key"], "block", ["seq"], "l", F.col("v")), df.withColumn("l", F.last("v", True).over(w)), ["l"])


def test_islands(spark):
    df, w = rows(spark), W.partitionBy("key").orderBy("seq")
    plain = df.withColumn("n", F.expr("if(c <=> lag(c) over (partition by key order by seq), 0, 1)")).withColumn("island", F.sum("n").over(w))
    same(scale.with_island(df, ["key"], "block", ["seq"], ["c"]), plain, ["island"])
