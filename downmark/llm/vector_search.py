"""Exact top-k by inner product over norm-sorted blocks.

Vectors are turned into integers, rotated onto the axes of their second moments
(an SVD) and cut into blocks from the longest to the shortest.  The longest block
gives every query a first k-th score.  In each later block a candidate goes if
its length times the query's cannot reach that score, then if the first rotated
coordinates plus the Cauchy-Schwarz bound on the rest cannot; what remains is
scored in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import keep

#: Rows of a candidate block and of a query block: what one task holds at a time.
BLOCK, QUERIES = 2048, 4096
#: Norm bands the driver keeps the borders of; blocks cut a band further.
BANDS = 512
#: Rotated coordinates summed before the bound is taken.
HEAD = 24
#: Relative slack of the floating-point bounds; exact scores are integers.
SLACK = 1e-9


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, norm2) of the rows whose vectors are whole and finite; v is floor(scale * x), exact as doubles."""
    source = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    whole = source.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    # from 2^53 on a double is a whole number already
    ints = whole.select("id", F.transform("x", lambda e: F.when(F.abs(e * scale) < float(1 << 53), F.floor(e * scale).cast("double")).otherwise(e * scale)).alias("v"))
    return ints.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of a partition, one row per width of vector."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for width, x in _by_width(batch.column(0)):
            sums[width] = sums.get(width, 0.0) + x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=["width", "m"])


def _by_width(column: pa.Array):
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(set(sizes.tolist())) == 1:
        yield int(sizes[0]), flat.reshape(len(sizes), -1)
        return
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for width in sorted(set(sizes.tolist())):
        yield int(width), np.array([flat[a:a + width] for a in starts[sizes == width]]).reshape(-1, int(width))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each width of vector an orthogonal matrix, axes of largest second moment first.

    A width-by-width matrix per partition is summed; its size depends on the width alone.
    """
    parts = vectors.select("v").mapInArrow(_moments, "width int, m array<double>")
    cells = parts.select("width", F.posexplode("m").alias("cell", "x")).groupBy("width", "cell").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for width, own in cells.groupby("width"):
        matrix = np.zeros(width * width)
        matrix[own["cell"].to_numpy()] = own["x"].to_numpy()
        # moments beyond doubles tell no axes apart
        axes = np.linalg.eigh(matrix.reshape(width, width))[1] if np.isfinite(matrix).all() else np.eye(width)
        out[int(width)] = axes[:, ::-1].copy()
    return out


def with_blocks(vectors: DataFrame, block: int) -> tuple[DataFrame, int, list[tuple[int, float]]]:
    """``vectors`` with ``block``, 0 for the longest ones, the number of blocks, and for each band its last block and largest norm.

    Norm bands come from approximate quantiles; a band of more than a block (many
    equal norms, or more rows than bands hold) is cut by a hash of the id.
    """
    cuts = vectors.agg(F.percentile_approx("norm2", [i / BANDS for i in range(1, BANDS)], 10_000).alias("q")).first()["q"] or []
    borders = sorted(set(cuts), reverse=True)
    band = F.array_position(F.transform(F.array(*[F.lit(b) for b in [*borders, -1]]), lambda b: F.col("norm2") > b), True) if borders else F.lit(1)
    banded = keep(vectors.withColumn("band", band.cast("int")), "bands")
    told = banded.groupBy("band").agg(F.count("*").alias("count"), F.max("norm2").alias("top")).collect()  # at most BANDS rows
    sizes, tops = {r["band"]: r["count"] for r in told}, {r["band"]: float(r["top"]) ** 0.5 for r in told}
    first, cells, at, room = {}, {}, 0, 0
    for b in sorted(sizes):
        if sizes[b] > block:  # a block of its own, or several
            at += room > 0
            first[b], cells[b], room = at, -(-sizes[b] // block), 0
            at += cells[b]
        else:  # small bands share a block
            if room + sizes[b] > block:
                at, room = at + 1, 0
            first[b], cells[b] = at, 1
            room += sizes[b]
    total = at + (room > 0)
    place = vectors.sparkSession.createDataFrame([(b, first[b], cells[b]) for b in sizes], "band int, first int, cells int")
    out = banded.join(F.broadcast(place), "band").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    reach = [(first[b] + cells[b] - 1, tops[b]) for b in sorted(sizes)]
    return out.select("id", "v", "norm2", "block"), total, reach


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))][:k]  # ~ turns the order round without leaving the range


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole numbers given as doubles; in floats only where these are exact, held to the range of long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(e) for e in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def searcher(axes_of: dict[int, np.ndarray], k: int, head: int):
    """Top k of one block of queries in one block of candidates."""

    def run(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        widths = queries["v"].map(len) if len(queries) else pd.Series([], dtype=int)
        own = cands["v"].map(len) if len(cands) else pd.Series([], dtype=int)
        for width in sorted(set(widths) & set(own)):
            qs, cs = queries[widths == width], cands[own == width].sort_values(["norm2", "id"], ascending=[False, True])
            q, x = (np.array(d["v"].tolist(), dtype=np.float64).reshape(len(d), width) for d in (qs, cs))
            ids, floor = cs["id"].to_numpy(), qs["floor"].to_numpy(dtype=np.float64)
            qn, xn = np.sqrt(qs["norm2"].to_numpy(dtype=np.float64)), np.sqrt(cs["norm2"].to_numpy(dtype=np.float64))
            axes = axes_of[width]
            h = min(head, width)
            qr, xr = q @ axes[:, :h], x @ axes[:, :h]
            # norms beyond doubles bound nothing
            with np.errstate(all="ignore"):
                q_rest, x_rest = (np.nan_to_num(np.sqrt(np.maximum(0.0, n * n - (r * r).sum(axis=1))), nan=np.inf, posinf=np.inf) for n, r in ((qn, qr), (xn, xr)))
                slack = np.nan_to_num(1 + SLACK * qn * xn.max(initial=0), nan=np.inf, posinf=np.inf)
                lengths = np.nan_to_num(np.outer(qn, xn), nan=np.inf, posinf=np.inf)
            for i, query in enumerate(qs["id"].to_numpy()):
                reach = int(np.searchsorted(-lengths[i], -(floor[i] - slack[i]), side="right"))  # the longest come first
                if not reach:
                    continue
                with np.errstate(all="ignore"):
                    bound = xr[:reach] @ qr[i] + x_rest[:reach] * q_rest[i]
                at = np.flatnonzero(~(bound < floor[i] - slack[i]) & (ids[:reach] != query))
                if not len(at):
                    continue
                score = _dots(q[i:i + 1], x[at])[0]
                at, score = at[score >= floor[i]], score[score >= floor[i]]
                top = best_of(score, ids[at], k)
                out.append((np.full(len(top), query), ids[at][top], score[top]))
        cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return run


def _pairs(queries: DataFrame, cands: DataFrame, run) -> DataFrame:
    """Run ``run`` on every (query block, candidate block) pair; each side is listed once per block of the other."""
    out = queries.groupBy("block", "part").cogroup(cands.groupBy("block", "part"))
    return out.applyInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: F.Column | str, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256, block: int = BLOCK, query_block: int = QUERIES, head: int = HEAD) -> DataFrame:
    """The k highest integer inner products of every query with all rows but its own.

    ``is_query`` picks the query rows.  Columns: ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score``; ties go to the smaller id.  Rows whose id or vector is null
    or whose vector has a null or non-finite component take no part; vectors of
    different widths do not meet.  Rows repeated under one id are candidates each, but
    never of a query of that id, whose repeats are one query (the first by vector).  A
    query without candidates has no rows; so has an empty table.  Other columns are
    not read.  Finite components may be of any size; an inner product beyond the range of
    long counts as the end of that range, ties there going to the smaller id as ever.

    A query asks only the blocks whose longest vector can reach its k-th score so far.

    Each pair of blocks is one task's work, with both sides bounded in rows.  A
    candidate is dropped only by a bound that proves it lower than the k-th score.
    """
    vectors, blocks, reach = with_blocks(integer_vectors(df, key, vector, scale), block)
    chosen = df.filter(is_query).select(F.col(key).alias("id")).distinct()
    vectors = keep(vectors, "vectors")
    if not blocks:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    axes = rotations(vectors)
    queries = vectors.join(chosen, "id", "left_semi").groupBy("id").agg(F.min(F.struct("v", "norm2")).alias("q")).select("id", "q.v", "q.norm2")
    parts = max(1, -(-queries.count() // query_block))
    queries = keep(queries.withColumn("part", F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(parts)).cast("int")), "queries")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    seeds = queries.withColumn("block", F.lit(0)).withColumn("floor", F.lit(float(np.finfo(np.float64).min)))
    longest = vectors.filter("block = 0").withColumn("part", every_part)
    seeded = keep(_pairs(seeds, longest, searcher(axes, k, head)), "seeded")
    floors = _best(seeded, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    if blocks == 1:
        found = seeded
    else:
        asked = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(np.finfo(np.float64).min))))
        # bands come longest first: those in reach are the first ones
        bands = F.array(*[F.struct(F.lit(last).alias("last"), F.lit(norm).alias("norm")) for last, norm in reach])
        near = F.filter(bands, lambda b: ~(b["norm"] * F.sqrt("norm2") * (1 + 1e-6) + 1 < F.col("floor")))
        asked = asked.withColumn("_last", F.array_max(F.transform(near, lambda b: b["last"]))).filter("_last >= 1")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("_last")))).drop("_last")
        later = vectors.filter("block > 0").withColumn("part", every_part)
        found = seeded.union(_pairs(asked, later, searcher(axes, k, head)))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
