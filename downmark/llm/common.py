"""What the text operators share: white space, lower case, words and kept tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space is these six characters and nothing else.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a few numbers that one task writes.
ROWS_PER_TASK = 250_000
#: The same rule for ``str.translate`` inside tasks.
TO_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; null, empty and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` where the driver and all executors can reach it.

    It goes when the driver ends.
    """
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write the frame to the shared folder and read on from there.

    This cuts lineage: a lost executor costs a read of these files, not the work
    before them.  With ``rows``, the most that the frame can have, it is written by
    one task for every ``ROWS_PER_TASK`` of narrow rows instead of by all partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df if rows is None else df.coalesce(1 + rows // ROWS_PER_TASK)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the files of frames from ``keep`` that nothing reads any more; others are left alone."""
    for df in frames:
        path = getattr(df, "_kept_at", None) if isinstance(df, DataFrame) else None
        if path is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its own columns of these names under others, and the columns that give it back as it was."""
    other = {c: fresh(df, f"{c}_own") if c.lower() in names else c for c in df.columns}
    return df.select(*[F.col(c).alias(o) for c, o in other.items()]), [F.col(o).alias(c) for c, o in other.items()]


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
