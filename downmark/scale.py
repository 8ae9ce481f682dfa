"""Ordered operators that do not need a whole group in one task.

A plain window puts all rows of a key on one task, so a key with a third of the
table is a third of the job.  Every function here takes a ``block``: a column
that never decreases along ``order`` inside a key (a day, a bucket of the
sequence number).  The window runs per (key, block); what crosses a block border
is carried by a table with one row per block, which is what the remaining
per-key window sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def _inner(keys, block, order):
    return W.partitionBy(*keys, block).orderBy(*order)


def _attach(df: DataFrame, carry: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(carry, list(on), "left")


def with_position(df: DataFrame, keys, block: str, order, name: str = "position") -> DataFrame:
    """1-based position of each row within its key."""
    local = df.withColumn("_local", F.row_number().over(_inner(keys, block, order)))
    sizes = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = _attach(local, carry, [*keys, block])
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_local", "_before")


def with_total_position(df: DataFrame, outer: str, block: str, order, name: str = "position") -> DataFrame:
    """1-based position of each row in the whole table.

    ``outer`` is a coarse column of few values (a week), ``block`` a finer one; neither
    decreases along ``order``.  Rows are numbered within ``outer`` as above, and only
    the sizes of the ``outer`` values meet in one task."""
    local = with_position(df, [outer], block, order, "_inner")
    sizes = df.groupBy(outer).agg(F.count("*").alias("_n"))
    before = W.orderBy(outer).rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(outer, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return _attach(local, carry, [outer]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_before", "_inner")


def with_running(df: DataFrame, keys, block: str, order, sums: dict[str, Column]) -> DataFrame:
    """Running totals within the key, current row included."""
    staged = df
    for name, value in sums.items():
        staged = staged.withColumn(f"_v_{name}", value)
    inner = _inner(keys, block, order).rowsBetween(W.unboundedPreceding, 0)
    local = staged
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(inner))
    totals = staged.groupBy(*keys, block).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, block, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
    out = _attach(local, carry, [*keys, block])
    for name in sums:
        total = F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_c_{name}", F.lit(0))
        out = out.withColumn(name, total)
    return out.drop(*[f"_{p}_{n}" for n in sums for p in "vlc"])


def with_previous(df: DataFrame, keys, block: str, order, columns: dict[str, Column | str],
                  forward: bool = False) -> DataFrame:
    """The value on the row before (or after) this one in the key, across blocks."""
    staged = df.withColumn(
        "_row", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]))
    inner = _inner(keys, block, order)
    step = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    local = staged.withColumn("_near", step("_row").over(inner))
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    edges = staged.groupBy(*keys, block).agg(pick("_row", place).alias("_edge"))
    carry = edges.select(*keys, block, step("_edge").over(W.partitionBy(*keys).orderBy(block)).alias("_far"))
    out = _attach(local, carry, [*keys, block])
    near = F.coalesce("_near", "_far")
    return out.select(*df.columns, *[near[n].alias(n) for n in columns])


def with_last_known(df: DataFrame, keys, block: str, order, name: str, value: Column,
                    include_current: bool = True) -> DataFrame:
    """The latest non-null value at or before this row in the key."""
    staged = df.withColumn("_v", value)
    end = 0 if include_current else -1
    inner = _inner(keys, block, order).rowsBetween(W.unboundedPreceding, end)
    local = staged.withColumn("_near", F.last("_v", ignorenulls=True).over(inner))
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    edges = (staged.groupBy(*keys, block)
             .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_edge")))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select(*keys, block, F.last("_edge", ignorenulls=True).over(before).alias("_far"))
    out = _attach(local, carry, [*keys, block])
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_v", "_near", "_far")


def with_island(df: DataFrame, keys, block: str, order, same_as: Sequence[Column | str],
                name: str = "island") -> DataFrame:
    """Number the runs of consecutive rows whose ``same_as`` columns do not change."""
    cols = {f"_p{i}": c for i, c in enumerate(same_as)}
    seen = with_previous(df, keys, block, order, {**cols, "_has": F.lit(True)})
    same = F.col("_has").isNotNull()
    for i, c in enumerate(same_as):
        same = same & (F.col(c) if isinstance(c, str) else c).eqNullSafe(F.col(f"_p{i}"))
    flagged = seen.withColumn("_new", F.when(same, 0).otherwise(1)).drop(*cols, "_has")
    return with_running(flagged, keys, block, order, {name: F.col("_new")}).drop("_new")


def hash_draw(*parts) -> Column:
    """A reproducible 32-bit draw from the row's own values, the same in any engine."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """``hash_draw`` scaled to [0, 1)."""
    return hash_draw(*parts) / F.lit(4294967296.0)
