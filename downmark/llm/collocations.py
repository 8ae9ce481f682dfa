"""Phrase mining with an FM-index over word numbers for every shard.

A shard is a stretch of some million words of a partition of the corpus, cut between
pieces of text.  Its index is the Burrows-Wheeler transform of its word numbers, with a
separator after every piece.  An n-gram is an interval of the sorted suffixes; the map from
a suffix to the one after its first word (which the transform gives by sorting it) extends
intervals by a word, and the two intervals an n-gram lies between, without its last and
without its first word, are its left and right parents.

Counts of the shards are summed level by level.  An n-gram can only be frequent if both
its parents are, so every shard extends just those of its intervals whose n-grams are
frequent in the whole corpus.  What a shard has of a level goes to the buckets of a hash
in packed arrays; a bucket sums its n-grams over all shards, numbers the frequent ones, and
sends (interval, number), packed too, back to the shards that have them.  N-grams of a level
are the pair of their parents' numbers, so no words are shuffled over level one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import files
from .common import ascii_lower, broadcast_if_small, keep, release, shared_path

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
#: Words a shard closes at.
SHARD_WORDS = 1 << 21
#: Bytes of text and words for which there is a bucket more.
BUCKET_BYTES, BUCKET_ROWS = 1 << 24, 1 << 20
#: Rows of two numbers that a join may broadcast.
BROADCAST_ROWS = 500_000


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """All suffixes in order; zeros are separators, each a letter of its own that comes before all words.

    The last letter is a separator.  Suffixes known to their first words are told apart
    by the rank of what follows, over twice as many words each time; those that are told
    apart take no further part.
    """
    n = len(ids)
    ends = ids == 0
    first = np.where(ends, np.cumsum(ends) - 1, ids.astype(np.int64) - 1 + int(ends.sum()))
    sizes = np.bincount(first)
    rank = (np.cumsum(sizes) - sizes)[first]
    del ends
    left = np.flatnonzero(sizes[first] > 1)
    step = 1
    while len(left):
        key = rank[left] * n + rank[left + step]
        left = left[np.argsort(key)]
        old, key = rank[left], rank[left] * n + rank[left + step]
        new = np.ones(len(left) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        group = np.ones(len(left), bool)
        group[1:] = old[1:] != old[:-1]
        at = np.arange(len(left))
        rank[left] = old + np.maximum.accumulate(np.where(new[:-1], at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        left = left[~(new[:-1] & new[1:])]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def transform(ids: np.ndarray) -> np.ndarray:
    """The word before every suffix, in the order of the suffixes."""
    return ids[suffix_order(ids) - 1].astype(np.int32)


class Index:
    """What a shard's transform answers: where words begin, and the suffix after the first word."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bwt))]).astype(np.int64)
        self.after = np.argsort(bwt, kind="stable")

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the interval of every word number, separators left out."""
        return self.starts[1:-1], np.diff(self.starts)[1:]

    def rows(self, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The number given to the interval each suffix lies in, -1 where there is none."""
        out = np.full(len(self.bwt), -1, np.int64)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        out[at] = np.repeat(number, size)
        return out

    def extended(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(left parent, right parent, start, size) of the intervals one word longer whose parents are both known."""
        left, right = known, known[self.after]
        ok = (left >= 0) & (right >= 0)
        new = np.ones(len(ok), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        edges = np.concatenate([np.flatnonzero(new), [len(ok)]])
        start, size = edges[:-1], np.diff(edges)
        mine = ok[start]
        start, size = start[mine], size[mine]
        return left[start], right[start], start, size

    def occurrences(self, word: int, row: int) -> int:
        """How often a word stands before one of the first ``row`` suffixes."""
        own = self.after[self.starts[word]:self.starts[word + 1]]
        return int(np.searchsorted(own, row))

    def before(self, word: int, start: int, stop: int) -> tuple[int, int]:
        """The interval of the phrase with ``word`` set before the one of the interval given."""
        first = int(self.starts[word])
        return first + self.occurrences(word, start), first + self.occurrences(word, stop)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte of equal weight, compressed."""
    parts = [np.ascontiguousarray(c.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in flat]


def _shards(folder: str, shard_words: int, buckets: int):
    """Write the index of every shard; give back its words by bucket and language, packed with their intervals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, defaultdict[str, int]] = {}
        ids, following = array("i"), count(1)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, following
            shard = uuid.uuid4().int >> 65
            index = Index(transform(np.frombuffer(ids, np.int32)))
            files.write_whole(f"{folder}/{shard}.bwt", zstandard.ZstdCompressor(level=1).compress(index.bwt.tobytes()))
            start, size = index.words()
            for lang, own in numbers.items():
                words = np.array(list(own), object)
                at = np.array(list(own.values())) - 1
                home = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own]) % buckets
                order = np.argsort(home, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                    text = zstandard.ZstdCompressor(level=1).compress("\n".join(words[part]).encode("utf-8", "surrogatepass"))
                    yield pa.RecordBatch.from_arrays([pa.array([int(home[part[0]])]), pa.array([shard]), pa.array([lang], pa.string()), pa.array([text], pa.binary()),
                                                      pa.array([pack(start[at[part]], size[at[part]])], pa.binary())], names=["bucket", "shard", "lang", "words", "blob"])
            numbers.clear()
            ids, following = array("i"), count(1)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in PIECE.split(text.as_py()):
                    words = WORD.findall(piece)
                    if words:
                        own = numbers.get(lang)
                        if own is None:
                            own = numbers[lang] = defaultdict(following.__next__)
                        ids.extend(map(own.__getitem__, words))
                        ids.append(0)
                        if len(ids) >= shard_words:
                            yield from close()
        if ids:
            yield from close()

    return run


#: What a bucket tells: totals of a language (0), frequent phrases (1), for each shard the packed (start, size, number) of its intervals with such a phrase (2).
TOLD = "kind int, shard bigint, blob binary, number bigint, lang string, phrase string, left bigint, right bigint, count bigint"
_TOLD = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("blob", pa.binary()), ("number", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()),
                   *[(n, pa.int64()) for n in ("left", "right", "count")]])


def _told(kind: int, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.array([kind] * n if f.name == "kind" else [None] * n, f.type) for f in _TOLD], schema=_TOLD)


def _intervals(shard: int, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """The intervals of one shard that a bucket has numbers for, as one row."""
    return _told(2, 1, shard=[shard], blob=[pack(np.diff(start, prepend=0), size, number)])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The packed rows of each bucket, from rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and held:
                yield bucket, held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield bucket, held


def _frequent_words(least: int):
    """Totals, the frequent words of each bucket, and where the shards have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            counts: dict[tuple[str, str], int] = defaultdict(int)
            totals: dict[str, int] = defaultdict(int)
            opened = []
            for row in rows:
                words = zstandard.ZstdDecompressor().decompress(row["words"]).decode("utf-8", "surrogatepass").split("\n")
                start, size = unpack(row["blob"], 2)
                opened.append((row["shard"], row["lang"], words, start, size))
                totals[row["lang"]] += int(size.sum())
                for w, n in zip(words, size.tolist()):
                    counts[row["lang"], w] += n
            yield _told(0, len(totals), lang=list(totals), count=list(totals.values()))
            kept = sorted(k for k, n in counts.items() if n >= least)
            number = {k: (bucket << 32) + i for i, k in enumerate(kept)}
            yield _told(1, len(kept), number=list(number.values()), lang=[k[0] for k in kept], phrase=[k[1] for k in kept], count=[counts[k] for k in kept])
            for shard, lang, words, start, size in opened:
                found = np.array([number.get((lang, w), -1) for w in words], np.int64)
                at = np.flatnonzero(found >= 0)
                if len(at):
                    yield _intervals(shard, start[at], size[at], found[at])

    return run


def _extend(folder: str, buckets: int):
    """All one word longer than a shard's frequent intervals, by bucket and packed; rows come sorted by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            data = zstandard.ZstdDecompressor().decompress(files.open_mapped(f"{folder}/{shard}.bwt"))
            index = Index(np.frombuffer(data, np.int32))
            start, size, number = (np.concatenate(x) for x in zip(*[(np.cumsum(d), *rest) for d, *rest in held]))
            left, right, start, size = index.extended(index.rows(start, size, number))
            if not len(start):
                return
            mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            home = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                yield pa.RecordBatch.from_arrays([pa.array([int(home[part[0]])]), pa.array([shard]),
                                                  pa.array([pack(np.diff(start[part], prepend=0), size[part], left[part], right[part])], pa.binary())], names=["bucket", "shard", "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != shard:
                    if held:
                        yield from close()
                    shard, held = name, []
                held.append(unpack(blob.as_py(), 3))
        if held:
            yield from close()

    return run


def _frequent_grams(least: int):
    """The frequent pairs of parents of each bucket, and where the shards have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            parts = [unpack(row["blob"], 4) for row in rows]
            start, size, left, right = (np.concatenate(x) for x in zip(*[(np.cumsum(d), *rest) for d, *rest in parts]))
            order = np.lexsort((right, left))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
            first = np.flatnonzero(new)
            total = np.add.reduceat(size[order], first)
            good = total >= least
            rank = np.where(good, np.cumsum(good) - 1, -1)
            found = np.empty(len(order), np.int64)
            found[order] = np.repeat(rank, np.diff(np.append(first, len(order))))
            one = order[first[good]]
            yield _told(1, len(one), number=(bucket << 32) + np.arange(len(one)), left=left[one], right=right[one], count=total[good])
            edges = np.cumsum([0, *(len(p[0]) for p in parts)])
            for row, a, b in zip(rows, edges[:-1], edges[1:]):
                at = a + np.flatnonzero(found[a:b] >= 0)
                if len(at):
                    yield _intervals(row["shard"], start[at], size[at], (bucket << 32) + found[at])

    return run


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, longest: int = 5, shard_words: int = SHARD_WORDS,
                     bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals (lang, n), and for each length from one to ``longest`` words the phrases found ``min_count`` times.

    A phrase is (number, lang, phrase, left, right, count); ``left`` and ``right`` are the
    numbers of the phrases without its last and its first word, null for single words.
    The number of buckets follows the bytes of text and the words.
    """
    spark = df.sparkSession
    folder = shared_path(spark, "shards")
    source = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    # shards have names of their own, so what is told of them is written before it is read by others
    packed = keep(source.mapInArrow(_shards(folder, shard_words, 1 + size // bucket_bytes), "bucket bigint, shard bigint, lang string, words binary, blob binary"), "words")
    told = keep(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent_words(min_count), TOLD), "told-1")
    release(packed)
    totals = keep(told.filter("kind = 0").groupBy("lang").agg(F.sum("count").alias("n")), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    level = keep(told.filter("kind = 1").select("number", "lang", "phrase", "left", "right", "count"), "phrases-1")
    levels = [level]
    for k in range(2, longest + 1):
        open_ = told.filter("kind = 2").select("shard", "blob").repartition("shard").sortWithinPartitions("shard")
        grams = open_.mapInArrow(_extend(folder, 1 + words // bucket_rows), "bucket bigint, shard bigint, blob binary")
        before, told = told, keep(grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent_grams(min_count), TOLD), f"told-{k}")
        release(before)
        one = level.select(F.col("number").alias("left"), "lang", F.col("phrase").alias("head"))
        two = level.select(F.col("number").alias("right"), F.substring_index("phrase", " ", -1).alias("last"))
        rows = told.filter("kind = 1").select("number", "left", "right", "count")
        level = keep(rows.join(broadcast_if_small(one), "left").join(broadcast_if_small(two), "right")
                     .select("number", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "left", "right", "count"), f"phrases-{k}")
        levels.append(level)
    release(told)
    return totals, levels


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its known size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _wide(*factors: Column) -> Column:
    """The exact product as a decimal of 38 digits."""
    out = factors[0].cast("decimal(38,0)")
    for f in factors[1:]:
        out = (out * f.cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def floor_ratio(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) of counts, exactly: products of three counts stay below 38 digits up to 10^11 each."""
    whole, share = _wide(F.lit(1000), a, n), _wide(l, r)
    return ((whole - whole % share) / share).cast("decimal(38,0)").cast("long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase of two to ``longest`` words counts where its words stand side by side in a
    piece of text; ``a`` is how often, ``l`` and ``r`` how often its two parts by the cut of
    lowest ``score`` (the first of several), n all words of the language.  A phrase that one
    longer by a word on either side is found as often as is left out.  Null texts are empty
    and give nothing, as do blank ones; a null language is ``und``; repeated rows count
    again; an empty table gives an empty result; other columns are not read.
    """
    totals, levels = frequent_phrases(df, text, lang, min_count, longest, shard_words)
    rows, out = [lv.count() for lv in levels], None
    for k in range(2, longest + 1):
        level = levels[k - 1].withColumnRenamed("count", "a")
        # the cut after j words: its first part is the left parent taken k - j times, the rest the right parent taken j times
        for side, j_of in (("left", lambda s: k - s), ("right", lambda s: s)):
            level = level.withColumn("_at", F.col(side))
            for s in range(1, k):
                size, at = k - s, levels[k - s - 1]
                part = at.select(F.col("number").alias("_at"), F.col("count").alias(f"{side[0]}{j_of(s)}"), *([F.col(side).alias("_next")] if size > 1 else []))
                level = level.join(_sized(part, rows[size - 1]), "_at").drop("_at")
                if size > 1:
                    level = level.withColumnRenamed("_next", "_at")
        if k < longest:
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("number"), "count").groupBy("number").agg(F.max("count").alias("most"))
            level = level.join(_sized(longer, 2 * rows[k]), "number", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a")))
        level = level.join(F.broadcast(totals), "lang")
        cuts = F.array(*[F.struct(floor_ratio(F.col("a"), F.col("n"), F.col(f"l{j}"), F.col(f"r{j}")).alias("score"), F.lit(j).alias("j"),
                                  F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)])
        part = level.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        out = part if out is None else out.unionByName(part)
    scored = keep(out, "scored")
    release(*levels)
    return _best(scored, top)


def _best(scored: DataFrame, top: int, parts: int = 256) -> DataFrame:
    """The first ``top`` phrases of each language, first within parts of it, so that no task sees a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
