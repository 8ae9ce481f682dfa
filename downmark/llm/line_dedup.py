"""Lines that many documents share are kept in one of them only.

Lines are exploded with their position, hashed in normal form, and the documents
of each hash are counted.  A line over the threshold goes everywhere except in
the largest document key that has it; what stays is put together by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, keep


def line_keys(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """(key, checksum of the text, position, hash) of every line whose normal form has ``min_chars`` code points."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = df.select(F.col(key).alias("id"), F.xxhash64(whole).alias("twin"), F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.length("line") >= min_chars)
    return bare.select("id", "twin", "pos", F.unhex(F.md5(ascii_lower(F.col("line")).cast("binary"))).alias("hash"))


def shared_lines(keys: DataFrame, min_docs: int = 5) -> DataFrame:
    """The hashes found in ``min_docs`` documents or more, with the largest key of each.

    Copies within a document fold first, then each hash: both steps combine before
    their shuffle, so a line of half the table is a few rows per task.
    """
    docs = keys.groupBy("hash", "id").agg(F.lit(1).alias("one"))
    return docs.groupBy("hash").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).filter(F.col("docs") >= min_docs)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every document with its shared lines dropped: key, ``text``, ``n_lines``, ``n_dropped``.

    A null or empty text is one empty line; it has no key of that length and stays.
    Rows with the same key count as one document and each keep a result row; a null
    key is not counted among the documents of a line and loses no lines.  Keepers
    are unique, so there are no ties.  An empty table gives an empty result; other
    columns are not read.
    """
    keys = keep(line_keys(df.filter(F.col(key).isNotNull()), key, text, min_chars), "lines")
    shared = keep(shared_lines(keys, min_docs), "shared-lines")
    hits = keys.join(shared, "hash").filter(F.col("id") < F.col("keeper"))
    dropped = keep(hits.groupBy("id", "twin").agg(F.collect_set("pos").alias("gone")), "dropped")
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("id"), F.xxhash64(whole).alias("twin"), whole.alias("whole")).join(dropped, ["id", "twin"], "left")
    lines = F.split("whole", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.element_at(lines, i + 1)), "\n"))
    gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return docs.select(F.col("id").alias(key), kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
