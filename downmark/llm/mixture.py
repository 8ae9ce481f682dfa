"""Mixing sources to target weights by budgets that flow down a tree.

The levels of the tree are columns (domain, language, source).  Each node gives
its budget to its children by weight, none more than its whole subtree can supply;
what a child cannot use goes to its siblings, and a node only receives what its
subtree can use.  A shortage is therefore made good among siblings before any
ancestor sees it.  A leaf then takes a prefix, in tokens, of its records in an
order drawn anew for every epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..scale import with_running
from .common import fresh, keep, words


def token_count(text: Column) -> Column:
    """Words of the text; the unit of all budgets."""
    return F.size(words(text)).cast("long")


def _weight(level: str, weights: Mapping[str, int] | None) -> Column:
    """The weight of a node by its name, 1 where none is given."""
    out = F.lit(1)
    for name, weight in (weights or {}).items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def pour(nodes: DataFrame, parents: Sequence[str], budget: str, cap: str, weight: str, name: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, up to ``cap`` each.

    Children in order of cap/weight: one is full if its cap lies under the level
    that the rest of the budget reaches over it and the children after it.  The
    windows see the children of one node.  Shares are rounded down.
    """
    order = W.partitionBy(*parents).orderBy(F.col(cap) / F.col(weight), *[c for c in nodes.columns if c.startswith("n_")])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    left = F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = nodes.withColumn("_level", left / F.sum(weight).over(after))
    full = F.col(cap) <= F.col("_level") * F.col(weight)
    # the level of the first child that is not full holds for all after it
    found = level.withColumn("_full", full).withColumn("_at", F.max(F.when(~F.col("_full"), F.col("_level"))).over(W.partitionBy(*parents)))
    share = F.when(F.col("_full"), F.col(cap)).otherwise(F.floor(F.col("_at") * F.col(weight)))
    return found.withColumn(name, F.greatest(share, F.lit(0)).cast("long")).drop("_level", "_full", "_at")


def budgets(leaves: DataFrame, levels: Sequence[str], total: Column | int, max_epochs: int,
            weights: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``budget``: the tokens each leaf supplies.

    Weights of zero switch a node off.  The table has one row per leaf.
    """
    out = leaves.withColumn("_cap", F.col("tokens") * max_epochs)
    names = [f"n_{i}" for i in range(len(levels))]
    for i, level in enumerate(levels):
        out = out.withColumn(f"_w{i}", _weight(level, (weights or {}).get(level))).withColumn(names[i], F.col(level))
    live = F.lit(True)
    for i in range(len(levels)):
        live = live & (F.col(f"_w{i}") > 0)
    out = out.filter(live).withColumn("_b", F.lit(total).cast("long") if isinstance(total, int) else total).withColumn("_root", F.lit(0))
    for i in range(len(levels)):
        path = ["_root", *names[:i]]
        nodes = out.groupBy(*path, names[i]).agg(F.sum("_cap").alias("_c"), F.first(f"_w{i}").alias("_w"), F.first("_b").alias("_pb"))
        shared = pour(nodes, path, "_pb", "_c", "_w", "_nb").select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate([*path, names[i]])], "_nb")
        same = F.lit(True)
        for j, c in enumerate([*path, names[i]]):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
        out = out.join(shared, same).withColumn("_b", F.col("_nb")).drop("_nb", *[f"_k{j}" for j in range(i + 2)])
    return out.select(*levels, "tokens", F.col("_b").alias("budget"))


def mix(df: DataFrame, levels: Sequence[str], fraction: float | None = None, total: int | None = None,
        max_epochs: int = 4, weights: Mapping[str, Mapping[str, int]] | None = None,
        key: str = "doc_id", text: str = "text", seed: int = 7, checksum: str | None = None) -> DataFrame:
    """How often each record is taken: key, levels, ``tokens``, ``budget``, ``copies``.

    The token total is ``total``, or ``fraction`` of all tokens.  A leaf with budget
    ``b`` and ``t`` tokens takes all records ``b div t`` times and of the next epoch
    the records, by md5 of (seed, epoch, key, checksum of the text), whose tokens up
    to and with themselves fit into what is left; the prefix never exceeds a budget.

    Null levels are nodes of their own (weight 1).  Null or empty texts have no
    tokens and are taken whenever the prefix reaches them; a leaf without tokens
    has budget 0 and takes none.  Repeated rows share a place in the order, broken
    by nothing else, and are taken together or not at all; ties in the order only
    occur between such rows.  An empty table gives an empty result; other columns
    are not read.  ``checksum`` names a column for the md5 of the text.

    The order is cut into 4,096 blocks by the hash, and only block totals meet per
    leaf, so a source with a third of the rows is no task of its own.
    """
    if (fraction is None) == (total is None):
        raise ValueError("give either fraction or total")
    sized = keep(df.select(F.col(key), *levels, token_count(F.col(text)).alias("tokens"),
                           F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_sum")), "sized")
    leaves = sized.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    if total is None:
        whole = leaves.agg(F.floor(F.sum("tokens") * F.lit(fraction)).cast("long").alias("n")).first()["n"] or 0
    else:
        whole = total
    shares = budgets(leaves, levels, int(whole), max_epochs, weights)
    shares = keep(shares.withColumn("_full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
                  .withColumn("_rest", F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(-1)), "shares")
    same = F.lit(True)
    for c in levels:
        same = same & sized[c].eqNullSafe(shares[c])
    placed = (sized.join(shares, same).select(key, *[sized[c] for c in levels], sized["tokens"], "budget", "_full", "_rest", "_sum")
              .withColumn("_order", F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("_full").cast("string"), F.col(key).cast("string"), "_sum").cast("binary")))
              .withColumn("_block", F.substring("_order", 1, 3)))
    # equal rows have one place: the sum up to it takes all of them
    at_place = placed.groupBy(*levels, "_block", "_order").agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n"), F.first(key).alias(key), F.first("tokens").alias("tokens"),
                                                               F.first("_sum").alias("_sum"), F.first("budget").alias("budget"), F.first("_full").alias("_full"), F.first("_rest").alias("_rest"))
    run = _running(at_place, levels)
    taken = F.col("_full") + F.when(F.col("_upto") <= F.col("_rest"), 1).otherwise(0)
    out = run.withColumn("copies", taken.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return out.select(key, *levels, "tokens", "budget", "copies", *([F.col("_sum").alias(checksum)] if checksum else []))


def _running(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Tokens up to and with each place; null levels are made comparable for the carry join."""
    keys = [f"_l{i}" for i in range(len(levels))]
    for k, c in zip(keys, levels):
        df = df.withColumn(k, F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    return with_running(df, keys, "_block", ["_order"], {"_upto": F.col("_t")}).drop(*keys)


def take(df: DataFrame, levels: Sequence[str], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that ``mix`` takes, each as often as it says; all columns as they are.

    Rows are matched by key, levels and checksum of the text; repeated rows are taken
    together.
    """
    sums, keys, copies, each = (fresh(df, n) for n in ("taken_sum", "taken_key", "taken_copies", "taken_copy"))
    places = [fresh(df, f"taken_{i}") for i in range(len(levels))]
    chosen = mix(df.select(key, text, *[c for c in levels if c not in (key, text)]), levels, key=key, text=text, checksum=sums, **options).filter("copies > 0")
    chosen = keep(chosen.select(F.col(key).alias(keys), sums, *[F.col(c).alias(p) for c, p in zip(levels, places)], F.col("copies").alias(copies)).distinct(), "chosen")
    same = F.col(key).eqNullSafe(F.col(keys)) & (F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")) == F.col(sums))
    for c, p in zip(levels, places):
        same = same & F.col(c).eqNullSafe(F.col(p))
    out = df.join(chosen, same).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*df.columns)
