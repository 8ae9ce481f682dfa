"""Named queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

import functools

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def prepare(spark):
    """Session settings the queries plan with.

    The play view derives some twenty columns from three keys.  Inferring
    filters through all those aliases takes the planner exponential time, and
    there is nothing to gain: the filters that matter are written out.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its DuckDB twin."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep
