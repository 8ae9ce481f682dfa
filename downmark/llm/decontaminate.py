"""Finds benchmark items in documents.

A window of an item's own length is laid at every start from which it holds as many
five-word shingles of the item, in whatever order, as the similarity asks for; no
other window can reach it.  Every window gets a SimHash
fingerprint.  A multi-index over the items' fingerprints (eight blocks of eight
bits, each listed with up to one bit changed, on either side) returns all items of
the window's length within the radius, and what it returns is verified by the
exact weighted similarity of the two shingle lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, keep, words

SHINGLE = 5
BLOCKS, BLOCK_BITS = 8, 8
#: With up to this many differing bits, one of the blocks differs in two at most.
MAX_RADIUS = 3 * BLOCKS - 1
#: Five standard deviations over the distance that similarity 0.8 gives on average.
RADIUS = 22


def shingles(tokens: Column) -> Column:
    """The hash of every run of five words, repeats included; none of fewer words."""
    run = F.transform(F.sequence(F.lit(0), F.size(tokens) - SHINGLE), lambda i: F.xxhash64(*[tokens[i + j] for j in range(SHINGLE)]))
    return F.when(F.size(tokens) >= SHINGLE, run).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """The bits set in more than half of the hashes: every shingle weighs as often as it occurs."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L AS int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | shiftleft(cast({ones} * 2 > size({hashes}) AS bigint), b))")


def block_values(fp: Column) -> Column:
    """(block, value) of each block of a fingerprint, as it is and with each of its bits changed."""
    masks = [0, *[1 << i for i in range(BLOCK_BITS)]]
    return F.array(*[
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).bitwiseXOR(F.lit(m)).cast("int").alias("value"))
        for b in range(BLOCKS) for m in masks])


def shared_weight(a: Column, b: Column) -> Column:
    """How many shingles two lists share, each as often as in the list where it is rarer."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda list_, h: F.size(F.filter(list_, lambda x: x == h))
    repeats = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(repeats)


def benchmark_items(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n_words, marks, fp) of the items that have five words or more."""
    read = items.select(F.col(key).alias("item"), words(ascii_lower(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    out = read.select("item", F.size("w").alias("n_words"), shingles(F.col("w")).alias("marks")).filter(F.col("n_words") >= SHINGLE)
    return out.withColumn("fp", simhash("marks"))


def _starts(similarity: float) -> Column:
    """(start, aligned) of the windows with enough shingles of the item in them, from ``met`` (pos, offset), ``length`` and ``n_words``.

    ``aligned`` tells windows that begin where a shared shingle puts the item, moved to
    the edge if they would begin or end outside the document.
    """
    # of a window of w shingles and an item of m, at least similarity * (w + m) / (1 + similarity) must be shared
    marks, last = f"(n_words - {SHINGLE - 1})", "greatest(0, length - n_words)"
    wide = f"least({marks}, length - {SHINGLE - 1})"
    need = f"greatest(1, cast(ceil({similarity}D * ({wide} + {marks}) / {1 + similarity}D - 1e-9D) AS int))"
    at, lines = "array_sort(array_distinct(met.pos))", "array_distinct(transform(met, x -> greatest(0, least(x.pos - x.offset, length - n_words))))"
    return F.expr(f"""flatten(transform(array(struct({at} AS at, {lines} AS lines, {need} AS need)), g ->
        transform(array_distinct(flatten(transform(filter(sequence(0, size(g.at)), i -> i + g.need <= size(g.at) AND g.at[i + g.need - 1] - g.at[i] < {wide}),
            i -> sequence(greatest(0, g.at[i + g.need - 1] - {wide} + 1), least(g.at[i], {last}))))),
            s -> struct(s AS start, array_contains(g.lines, s) AS aligned))))""")


def find(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
         similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(id, twin, item, start, n_words, similarity): the best window of every item in every document.

    ``twin`` is a checksum of the text, so that rows that share a key (or have none)
    stay apart; equal rows are reported once.  ``start`` counts words from 0; of
    equally similar windows those in line with a shared shingle come before others,
    and then the first is given.  Texts are compared in lower-case A-Z.
    A document shorter than the item is one window.  Null, empty and short texts
    (under five words) and such items match nothing; empty tables give an empty
    result; other columns are not read.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must be 0 to {MAX_RADIUS}")
    bench = keep(benchmark_items(items, item_key, item_text), "items")
    marks = bench.select("item", "n_words", F.posexplode("marks").alias("offset", "mark"))
    docs = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("twin"), F.col(text).alias("whole"))
    read = docs.select("id", "twin", words(ascii_lower(F.col("whole"))).alias("w")).withColumn("length", F.size("w"))
    placed = read.select("id", "twin", "length", F.posexplode(shingles(F.col("w"))).alias("pos", "mark"))
    anchored = placed.join(broadcast_if_small(marks), "mark")
    shared = anchored.groupBy("id", "twin", "item").agg(F.first("length").alias("length"), F.first("n_words").alias("n_words"), F.collect_set(F.struct("pos", "offset")).alias("met"))
    spots = shared.select("id", "twin", "n_words", F.explode(_starts(similarity)).alias("s"))
    spots = spots.groupBy("id", "twin", "s.start", "n_words").agg(F.max("s.aligned").alias("aligned"))
    spots = keep(spots.groupBy("id", "twin").agg(F.collect_list(F.struct("start", "n_words", "aligned")).alias("spots")), "spots")
    # only documents with an anchor are read again
    same = docs["id"].eqNullSafe(spots["id"]) & (docs["twin"] == spots["twin"])
    again = docs.join(spots, same).select(docs["id"], docs["twin"], "spots", words(ascii_lower(F.col("whole"))).alias("w"))
    again = again.select("id", "twin", "spots", F.explode(F.array(shingles(F.col("w")))).alias("all"))  # worked out once a row, not once a window
    cut = again.select("id", "twin", F.explode(F.transform("spots", lambda s: F.struct(
        s["start"].alias("start"), s["n_words"].alias("n_words"), s["aligned"].alias("aligned"), F.slice("all", s["start"] + 1, s["n_words"] - (SHINGLE - 1)).alias("window")))).alias("s"))
    windows = keep(cut.select("id", "twin", "s.*").withColumn("fp", simhash("window")), "windows")
    # the index: windows of one fingerprint and length ask it once
    asked = windows.select("fp", "n_words").distinct().select("fp", "n_words", F.explode(block_values(F.col("fp"))).alias("b")).select("fp", "n_words", "b.*")
    listed = bench.select(F.col("fp").alias("item_fp"), "n_words", "item", F.explode(block_values(F.col("fp"))).alias("b")).select("item_fp", "n_words", "item", "b.*")
    met = asked.join(broadcast_if_small(listed), ["n_words", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    met = keep(met.select("fp", "n_words", "item").distinct(), "candidates")
    pairs = windows.join(met, ["fp", "n_words"]).join(broadcast_if_small(bench.select("item", "marks")), "item")
    shared = pairs.withColumn("shared", shared_weight(F.col("window"), F.col("marks")))
    scored = shared.withColumn("similarity", F.col("shared") / (F.size("window") + F.size("marks") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("id", "twin", "item").agg(F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("back"), "n_words")).alias("top"))
    return best.select("id", "twin", "item", (-F.col("top.back")).alias("start"), "top.n_words", "top.similarity")


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` that hold no item; all columns as they are."""
    found = keep(find(df, items, key, text, similarity=similarity, radius=radius).select("id", "twin").distinct(), "contaminated")
    return df.join(found, F.col(key).eqNullSafe(found["id"]) & (F.xxhash64(text) == found["twin"]), "left_anti")
