"""Writers that decide whether, where and in which order to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import content_hash


def changed(new: DataFrame, old: DataFrame, ignore=("generated",)) -> DataFrame:
    """Rows present on one side only, the ignored columns left out."""
    cols = [c for c in new.columns if c not in ignore]
    a, b = new.select(*cols), old.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("new")).unionByName(b.exceptAll(a).withColumn("side", F.lit("old")))


def publish_if_changed(new: DataFrame, path: str, previous: DataFrame | None, ignore=("generated",)) -> bool:
    """Write only when something but the ignored columns moved."""
    if previous is not None and changed(new, previous, ignore).isEmpty():
        return False
    new.write.mode("overwrite").parquet(path)
    return True


def upsert(index: DataFrame, new: DataFrame, key: str = "key", at: str = "reviewed_at") -> DataFrame:
    """Newest entry per key, combined before the shuffle."""
    both = index.unionByName(new)
    rest = [c for c in both.columns if c not in (key, at)]
    return both.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*").select(*both.columns)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("season").parquet(path)


def freeze(spark: SparkSession, folder: str, tables: dict[str, DataFrame], inputs: dict[str, tuple[DataFrame, str]]) -> None:
    """Write an immutable set of tables, the manifest last.

    ``inputs`` maps a name to the frame and the fingerprint it was evaluated
    with; a different fingerprint refuses the freeze."""
    rows = []
    for name, (frame, expected) in inputs.items():
        got = fingerprint(frame)
        if got != expected:
            raise ValueError(f"input {name} differs from the evaluated one")
        rows.append((name, "input", got))
    for name, frame in tables.items():
        path = f"{folder}/{name}"
        frame.write.mode("errorifexists").parquet(path)
        rows.append((name, "table", fingerprint(spark.read.parquet(path))))
    spark.createDataFrame(rows, "name string, kind string, content_hash string").write.mode("errorifexists").parquet(f"{folder}/manifest")


def fingerprint(df: DataFrame) -> str:
    return content_hash(df, df.columns).collect()[0].content_hash


def write_partitions(df: DataFrame, path: str, keys=("season", "week")) -> None:
    """Replace only the partitions present in ``df``; weeks being played go to a path of their own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
