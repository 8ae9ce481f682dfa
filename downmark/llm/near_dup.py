"""Near-duplicates by SimHash fingerprints and deletion variants.

For a radius of four or five bits, 64 bits are cut into three segments: one of them
differs in a bit at most, so two fingerprints that close agree in a segment with
one bit left out.  Every fingerprint is listed under its 64 segments-without-a-bit,
equal listings meet by key, and the pairs found there are verified bit by bit.  A
larger radius takes more, shorter segments.

A crowded listing gives a spanning forest instead of all its pairs; the components
are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, keep, release
from .components import Forest, contract, popcount, roots

#: Listings up to the first size are compared pair by pair, larger ones by a forest, those
#: over the second in cells of that size.
SMALL, CELL = 256, 4096
_KEY_BITS = 30


def segments(radius: int) -> list[tuple[int, int]]:
    """First bit and width of the segments, the fewest (but three) of which one differs in one bit at most."""
    n = max(3, radius // 2 + 1)
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    cuts = zip(starts[:last].tolist(), ends[min(size, len(words)) - 1:].tolist())
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in cuts]), dtype=">u8").astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def remix(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other hashes of the same shingles, for another fingerprint of the text."""
    if table == 0:
        return hashes
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * table) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, tables: int = 1) -> DataFrame:
    """(id, fp, ...): ``tables`` fingerprints of every whole text, as signed longs ``fp``, ``fp1``, ..."""
    names = [f"fp{t or ''}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((tables, batch.num_rows), dtype=np.uint64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                hashes = shingle_hashes(t, shingle)
                for k in range(tables):
                    found[k, i] = simhash(remix(hashes, k))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f.view(np.int64)) for f in found]], names=["id", *names])

    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def listings(fp: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The 64 listing keys of each fingerprint: the bit left out and the rest of its segment."""
    out = np.empty((len(fp), 64), dtype=np.int64)
    for start, width in cuts:
        value = (fp >> np.uint64(start)) & np.uint64((1 << width) - 1)
        for i in range(width):
            rest = ((value >> np.uint64(i + 1)) << np.uint64(i)) | (value & np.uint64((1 << i) - 1))
            out[:, start + i] = (np.int64(start + i) << np.int64(24)) | rest.astype(np.int64)
    return out


def home(x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The bit whose listing a pair with difference ``x`` is reported from: one of those they share."""
    out = np.full(len(x), -1, dtype=np.int64)
    for start, width in reversed(cuts):
        part = (x >> np.uint64(start)) & np.uint64((1 << width) - 1)
        bit = np.where(part == 0, 0, np.log2(np.maximum(part, 1).astype(np.float64)).astype(np.int64))
        out = np.where(popcount(part) <= 1, start + bit, out)
    return out


def _lister(cuts: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, len(every), 4096):
                fp = every[i:i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(listings(fp.view(np.uint64), cuts).ravel()), pa.array(np.repeat(fp, 64)), pa.array(np.repeat(nodes[i:i + 4096], 64))],
                                                 names=["bucket", "fp", "node"])

    return run


def forest_links(fp: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(place, places near it) that span every component; work shrinks as places are reached."""
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = popcount(fp[left] ^ fp[at]) <= radius
            if near.any():
                out.append((int(at), left[near]))
                front.extend(left[near].tolist())
                left = left[~near]
    return out


def linker(radius: int):
    """Links from rows sorted by bucket, as stars; holds one bucket and the links of a partition."""
    cuts = segments(radius)

    def found(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray, forest: Forest) -> None:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        sizes = np.diff(edges)
        bit = (bucket & ((1 << _KEY_BITS) - 1)) >> 24

        def link(i: np.ndarray, j: np.ndarray) -> None:
            x = fp[i] ^ fp[j]
            at = np.flatnonzero(popcount(x) <= radius)
            at = at[home(x[at], cuts) == bit[i[at]]]
            for a, b in zip(node[i[at]].tolist(), node[j[at]].tolist()):
                forest.union(a, b)

        # buckets of a few rows all at once, by distance of the rows; then one bucket at a time
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 16), sizes))
        for step in range(1, 16):
            i, j = few[:-step], few[step:]
            same = bucket[i] == bucket[j]
            if not same.any():
                break
            link(i[same], j[same])
        for k in np.flatnonzero((sizes > 16) & (sizes <= SMALL)).tolist():
            own = fp[edges[k]:edges[k + 1]]
            i, j = np.nonzero(popcount(own[:, None] ^ own[None, :]) <= radius)
            up = i < j
            if up.any():
                link(edges[k] + i[up], edges[k] + j[up])
        for k in np.flatnonzero(sizes > max(SMALL, 16)).tolist():
            own = node[edges[k]:edges[k + 1]]
            for at, near in forest_links(fp[edges[k]:edges[k + 1]], radius):
                for other in own[near].tolist():
                    forest.union(int(own[at]), other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held = tuple(np.concatenate(x) for x in zip(held, (bucket, fp.view(np.uint64), node)))
            done = int(np.searchsorted(held[0], held[0][-1]))
            if done:
                found(*(x[:done] for x in held), forest)
                held = tuple(x[done:] for x in held)
        if len(held[0]):
            found(*held, forest)
        yield forest.stars()

    return run


def crowded(fps: DataFrame, cuts: list[tuple[int, int]], cell: int) -> DataFrame:
    """(bucket, cells) of the listings that may hold over ``cell`` fingerprints.

    Such a listing joins two values of a segment, one of them with over half a cell.
    Only those are spelled out, so this stays a small part of the fingerprints.
    """
    values = fps.select(F.explode(F.array(*[
        F.struct(F.lit(start).alias("start"), F.lit(width).alias("width"), F.expr(f"shiftrightunsigned(fp, {start}) & {(1 << width) - 1}L").alias("v"))
        for start, width in cuts])).alias("s")).select("s.*")
    heavy = values.groupBy("start", "width", "v").agg(F.count("*").alias("n")).filter(F.col("n") > cell // 2)
    bits = heavy.withColumn("i", F.explode(F.expr("sequence(0, width - 1)")))
    keys = bits.withColumn("bucket", F.expr("shiftleft(cast(start + i AS bigint), 24) | shiftleft(shiftright(v, i + 1), i) | (v & (shiftleft(1L, i) - 1))"))
    sizes = keys.groupBy("bucket").agg((F.sum("n") + (2 - F.count("*")) * (cell // 2)).alias("n"))
    return sizes.filter(F.col("n") > cell).select("bucket", F.ceil(F.col("n") / cell).cast("int").alias("cells"))


def near_links(fps: DataFrame, radius: int = 4, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the ``node`` of all rows whose ``fp`` are within ``radius`` bits, up to connection.

    The expected work for a fingerprint is 64 times the fingerprints over two to the
    width of a segment less one; over a radius of five it soon grows with the square.
    """
    cuts = segments(radius)
    listed = fps.select("fp", "node").mapInArrow(_lister(cuts), "bucket long, fp long, node long")
    large = keep(crowded(fps, cuts, cell), "crowded")
    if not large.isEmpty():
        # every two cells of a crowded listing meet once, in a bucket of their own
        mine = F.pmod(F.xxhash64("fp", "node"), F.col("cells")).cast("int")
        cells = listed.join(large, "bucket", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
        code = F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.least(mine, "other") * 65536 + F.greatest(mine, "other") + 1).cast("long")
        listed = cells.select((F.shiftleft(code, _KEY_BITS) + F.col("bucket")).alias("bucket"), "fp", "node")
    return listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(linker(radius), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """key, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints within ``radius`` bits link; the component's id is its smallest key.
    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows each get a row.  Null keys get a component id too, which is null
    only if the whole component has no key.  An empty table gives an empty result;
    other columns are not read.
    """
    docs = keep(fingerprints(df, key, text, shingle), "fingerprints")
    fps = keep(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tops = roots(near_links(fps.select("fp", F.col("fp").alias("node")), radius).mapInArrow(contract, "a long, b long"))
    tree = keep(fps.join(tops, fps.fp == tops.a, "left").select("fp", F.coalesce("b", "fp").alias("top"), "least"), "tree")
    ids = keep(tree.groupBy("top").agg(F.min("least").alias("component_id")), "ids")
    member = keep(tree.join(ids, "top").select("fp", "component_id"), "member")
    return docs.join(member, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Slots of the table of how often shingles occur, the chunks it is summed in, and the fineness of its ranks.
SLOTS, CHUNKS, FINE = 1 << 22, 64, 8
#: The words of a text's fingerprint of 256 bits.
FPS = ("fp", "fp1", "fp2", "fp3")
#: The words of a text's parities: of each of 64 slots a word, whether an odd number of its shingles fall there.
ODD = tuple(f"odd{i}" for i in range(8))
#: Rounds that compare a component with one other, while they join over one in so many of those compared; two at least.
ROUNDS, JOINED = 8, 8


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _tally(shingle: int):
    """How many texts of a partition have a shingle in each slot, in compressed chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                counts[np.unique(_slots(shingle_hashes(text.as_py(), shingle)))] += 1
        pack = zstandard.ZstdCompressor(level=1).compress
        for c, part in enumerate(counts.reshape(CHUNKS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=["chunk", "counts"])

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed counts of each chunk on a logarithmic scale, a byte a slot; rows come sorted by chunk."""
    chunk, total = None, None

    def out() -> pa.RecordBatch:
        scale = np.minimum(255, np.floor(FINE * np.log2(1.0 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([scale.tobytes()], pa.binary())], names=["chunk", "ranks"])

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for c, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            if c != chunk:
                if chunk is not None:
                    yield out()
                chunk, total = c, np.zeros(SLOTS // CHUNKS, np.uint64)
            total += np.frombuffer(unpack(packed.as_py()), np.uint32)
    if chunk is not None:
        yield out()


def rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """A rank for every slot of shingle hashes, higher where more texts have one; ``texts`` has one column.

    Four megabytes whatever the corpus, so it may go to the driver and to every task.
    """
    tallied = texts.mapInArrow(_tally(shingle), "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    ranks = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8)
    for row in tallied.mapInArrow(_ranks, "chunk int, ranks binary").collect():  # CHUNKS rows
        ranks[row["chunk"]] = np.frombuffer(bytes(row["ranks"]), np.uint8)
    return ranks.ravel()


def prefix_length(size: int, least: float) -> int:
    """How many shingles, first in any order that all texts share, meet those of every text that is ``least`` alike."""
    return size - math.ceil(least * size - 1e-9) + 1 if size else 1


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes, and the same with repeats told apart, so that lists compare as sets."""
    found = np.sort(hashes)
    first = np.searchsorted(found, found)
    return found, found ^ ((np.arange(len(found)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def parities(told: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles fall in each slot, as words; texts differ in at least as many shingles as bits."""
    odd = np.bincount((told >> np.uint64(55)).astype(np.int64), minlength=64 * len(ODD)) & 1
    return np.packbits(odd.astype(np.uint8)).view(">u8").astype(np.uint64)


def rare_first(hashes: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    """The shingles a text is listed under: its rarest, as many as ``least`` asks for; zero for a text without words."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    found, told = numbered(hashes)
    return told[np.lexsort((told, ranks[_slots(found)]))][:prefix_length(len(hashes), least)]


def _sketches(shingle: int, least: float, ranks):
    """Fingerprint of 256 bits, parities, number of shingles and the shingles that a text is listed under."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, prefix = np.empty((len(FPS) + len(ODD), batch.num_rows), dtype=np.uint64), [], []
            for i, t in enumerate(batch.column(1)):
                hashes = shingle_hashes(t.as_py(), shingle)
                found[:len(FPS), i] = [simhash(remix(hashes, k)) for k in range(len(FPS))]
                found[len(FPS):, i] = parities(numbered(hashes)[1])
                sizes.append(len(hashes))
                prefix.append(rare_first(hashes, ranks.value, least).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f.view(np.int64)) for f in found], pa.array(sizes, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                                             names=["id", *FPS, *ODD, "size", "prefix"])

    return run


def _marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [numbered(shingle_hashes(t.as_py(), shingle))[1].view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "marks"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes whose bucket another node has too, each once, from rows sorted by bucket and node; holds one row over a batch."""
    last, matched = None, False
    row = lambda b, n: pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["bucket", "node"])
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if last is not None:
            bucket, node = np.append(last[0], bucket), np.append(last[1], node)
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
        bucket, node = bucket[new], node[new]
        keep_ = np.zeros(len(bucket), bool)
        same = bucket[1:] == bucket[:-1]
        keep_[1:] |= same
        keep_[:-1] |= same
        keep_[0] |= matched
        yield row(bucket[:-1][keep_[:-1]], node[:-1][keep_[:-1]])
        last, matched = (bucket[-1], node[-1]), bool(keep_[-1])
    if matched:
        yield row([last[0]], [last[1]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return popcount(a ^ b).sum(axis=-1, dtype=np.int64)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (bucket, fingerprint, parities, size, node, top) sorted by bucket, cut between buckets."""
    held = (np.empty(0, np.int64), np.empty((0, len(FPS)), np.uint64), np.empty((0, len(ODD)), np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, *words, size, node, top = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(FPS) + len(ODD) + 4))
        fps, odd = (np.stack(x, axis=1).view(np.uint64) for x in (words[:len(FPS)], words[len(FPS):]))
        held = tuple(np.concatenate(x) for x in zip(held, (bucket, fps, odd, size, node, top)))
        done = int(np.searchsorted(held[0], held[0][-1]))
        if done:
            yield tuple(x[:done] for x in held)
            held = tuple(x[done:] for x in held)
    if len(held[0]):
        yield held


def _across(limit: int, least: float):
    """Pairs (a, b), a < b, of a bucket that no link joins yet, of like sizes, within ``limit`` bits and, by their parities, maybe ``least`` alike; rows sorted by bucket."""
    share = differing(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            ends = np.unique(np.sort(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for bucket, fps, odd, size, node, top in _whole_buckets(batches):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            sizes = np.diff(edges)
            last = np.repeat(edges[1:], sizes)
            for i in np.flatnonzero(np.repeat(sizes > 1, sizes)).tolist():
                rest = slice(i + 1, last[i])
                like = np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]) - 1e-9
                at = i + 1 + np.flatnonzero((top[rest] != top[i]) & like & (_apart(fps[rest], fps[i]) <= limit))
                near = node[at[_apart(odd[at], odd[i]) <= share * (size[at] + size[i]) + 1e-6]]
                if len(near):
                    out.append(np.stack([np.full(len(near), node[i]), near], axis=1))
                    held += len(near)
                    if held > 1 << 17:
                        yield flush()
                        out, held = [], 0
        yield flush()

    return run


def differing(least: float) -> float:
    """The largest share of the shingles of both that two texts ``least`` alike do not have in common."""
    return (1 - least) / (1 + least)


def across_pairs(rows: DataFrame, limit: int, least: float, cell: int = CELL) -> DataFrame:
    """(a, b) of all pairs of ``rows`` (bucket, fingerprint, parities, size, node, top) that share a bucket and not a ``top``.

    Buckets of more than ``cell`` rows are cut in cells, every two of which meet in a
    bucket of their own; the cut changes where texts meet, not whether.
    """
    rows = rows.select("bucket", *FPS, *ODD, "size", "node", "top")
    large = keep(rows.groupBy("bucket").count().filter(F.col("count") > cell).select("bucket", F.ceil(F.col("count") / cell).cast("int").alias("cells")), "crowded")
    if not large.isEmpty():
        mine = F.pmod(F.xxhash64("fp", "node"), F.col("cells")).cast("int")
        cells = rows.join(broadcast_if_small(large), "bucket", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
        code = F.xxhash64("bucket", F.least(mine, "other"), F.greatest(mine, "other"))
        rows = cells.select(F.when(F.col("cells").isNull(), F.col("bucket")).otherwise(code).alias("bucket"), *FPS, *ODD, "size", "node", "top")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across(limit, least), "a long, b long").distinct()


def _labelled(met: DataFrame, often: DataFrame, tops: DataFrame) -> DataFrame:
    """Listings with the component of each text and how often it is listed, of the buckets that hold more than one component."""
    labels = often.join(tops.select(F.col("a").alias("node"), F.col("b").alias("_b")), "node", "left").select("node", "listed", F.coalesce("_b", "node").alias("top"))
    rows = met.select("bucket", "node").join(labels, "node")
    open_ = keep(rows.groupBy("bucket").agg(F.min("top").alias("low"), F.max("top").alias("high")).filter("low <> high").select("bucket"), "open")
    out = keep(rows.join(open_, "bucket", "left_semi"), "listed")
    release(open_)
    return out


def _stars(rows: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b), one of each component: its first text in a bucket with the first of all of the bucket; the most listed come first.

    Of the pairs not ``tested`` yet that with the most buckets is taken, so that no round
    has more pairs than components, however many listings a group of copies shares.
    """
    place = F.struct((-F.col("listed")).alias("back"), "node")
    firsts = rows.groupBy("bucket", "top").agg(F.min(place).alias("one"))
    centres = firsts.groupBy("bucket").agg(F.min("one").alias("two"))
    pairs = firsts.join(centres, "bucket").filter("one.node <> two.node")
    pairs = pairs.groupBy("top", F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b")).agg(F.count("*").alias("n"))
    pairs = pairs.join(tested, ["a", "b"], "left_anti")
    return pairs.groupBy("top").agg(F.max(F.struct("n", "a", "b")).alias("s")).select("s.a", "s.b").distinct()


def near_copies(listed: DataFrame, nodes: DataFrame, marks_of, least: float, limit: int, cell: int = CELL) -> DataFrame | None:
    """(a, b): every text that a chain of links of ``least`` joins to one of smaller number, with the smallest; None if none is.

    ``listed`` are (node, prefix), a text's as often as it likes, and ``nodes`` (node,
    fingerprint, parities, size), each once.  The links of ``near_links``, by the first word
    of the fingerprint and its deletion variants, come first: each text is compared with the
    first of its fingerprint, and each such with the first that chains of links reach.  Then
    rounds compare every component with one other, by the most listed texts of their buckets,
    so that a group of copies costs a comparison a copy and round.  After these, every
    pair of texts that shares a bucket, is within ``limit`` bits, may be ``least`` alike by
    its parities and is not joined yet is compared, so no link between two components is
    missed, however large the group.  Exact similarities decide all of them; only the
    shingles of texts in a pair are laid out.
    """
    listed = listed.select(F.explode("prefix").alias("bucket"), "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    met = keep(listed.mapInArrow(_met, "bucket long, node long"), "met")
    if met.isEmpty():
        release(met)
        return None
    often = keep(met.groupBy("node").agg(F.count("*").alias("listed")), "often")
    sketch = keep(nodes.join(often, "node", "left_semi").select("node", *FPS, *ODD, "size"), "sketch")
    side = lambda end: sketch.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in (*FPS, *ODD, "size")])
    apart = lambda names: sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))
    like = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9
    like = like & (apart(ODD) <= differing(least) * (F.col("size_a") + F.col("size_b")) + 1e-6)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        marks = keep(marks_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "marks")
        one, two = (marks.select(F.col("node").alias(end), F.col("marks").alias(as_)) for end, as_ in (("a", "one"), ("b", "two")))
        found = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("one") + F.size("two")).alias("both"), F.size(F.array_intersect("one", "two")).alias("same"))
        found = keep(found.filter((F.col("both") == 0) | (F.col("same") / (F.col("both") - F.col("same")) >= least)).select("a", "b"), name)
        release(marks)
        return found

    def joined(tops: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The components after the pairs are compared, and how many of the pairs are links."""
        near = keep(pairs.join(side("a"), "a").join(side("b"), "b").filter(like & (apart(FPS) <= limit)).select("a", "b"), "close")
        found = verified(near, "links")
        out = roots(found if tops is None else tops.union(found))
        n = found.count()
        release(near, found, tops)
        return out, n

    # a text that shares no listing has no link of ``least``, so the fingerprints of the others will do
    same = keep(sketch.select("fp", "node").groupBy("fp").agg(F.min("node").alias("first")), "same")
    reached = roots(near_links(same.select("fp", F.col("first").alias("node")), cell=cell).mapInArrow(contract, "a long, b long"))
    equal = sketch.join(same, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    tested = [keep(equal.union(reached.select(F.col("b").alias("a"), F.col("a").alias("b"))), "variants")]
    release(same, reached)
    tops, _ = joined(None, tested[0])
    every = tested[0]
    rows = _labelled(met, often, tops)
    release(met)
    for k in range(ROUNDS):
        if rows.isEmpty():
            break
        pairs = keep(_stars(rows, every), "stars")
        tops, links = joined(tops, pairs)
        tested.append(pairs)
        every = every.union(pairs)
        old, rows = rows, _labelled(rows, often, tops)
        release(old)
        if k and links * JOINED < pairs.count():
            break
    if not rows.isEmpty():
        pairs = keep(across_pairs(rows.join(sketch, "node"), limit, least, cell).join(every, ["a", "b"], "left_anti"), "across")
        found = verified(pairs, "links")
        if not found.isEmpty():
            old, tops = tops, roots(tops.union(found))
            release(old)
        release(pairs, found)
    release(rows, often, sketch, *tested)
    return tops


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8,
                   limit: int = 84, cell: int = CELL) -> DataFrame:
    """The rows of ``df`` without near-duplicates: one row of each group, all columns as they are.

    Two texts link if they share ``least`` of their shingles, repeats counted; a group is
    all texts that chains of links join, and its row with the smallest key stays.  SimHash
    fingerprints within four bits, met through deletion variants, are the first candidates.
    What they leave out is found exactly: texts
    that share one of their rarest shingles are candidates too: in an order of shingles common
    to all texts, here by how many texts have them, any two texts that are ``least`` alike
    share one of the first (1 - ``least``) of either.  Of these, fingerprints of 256 bits
    leave out pairs over ``limit`` bits apart (0.8 gives 39 on average, 48 in texts of a
    few shingles), parities those that differ in too many shingles, and exact similarities decide.

    Null keys come last, and of texts with one key that of the smaller hash stays; of rows
    that agree in key and text any one stays.  Null and empty texts are one text, and blank
    texts are all alike.  An empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    node = F.xxhash64(whole)
    ranks = df.sparkSession.sparkContext.broadcast(rarity(df.select(whole.alias("text")), shingle))  # 4 MB
    source = df.select(F.struct(F.col(key).alias("key"), node.alias("node")).alias("id"), whole.alias("text"))
    rows = source.mapInArrow(_sketches(shingle, least, ranks), f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in (*FPS, *ODD)) + ", size long, prefix array<long>")
    rows = keep(rows, "sketches")
    first = F.min(F.struct(F.col("id.key").isNull().alias("none"), F.col("id.key").alias("key"))).alias("least")
    nodes = keep(rows.groupBy("id.node").agg(first, *[F.first(n).alias(n) for n in (*FPS, *ODD, "size")]), "nodes")

    def marks_of(some: DataFrame) -> DataFrame:
        # one row of each text: that of its smallest key
        own = broadcast_if_small(nodes.join(some, "node", "left_semi").select(F.col("node").alias("own"), F.col("least.key").alias("own_key")))
        texts = df.select(F.col(key).alias("key"), node.alias("node"), whole.alias("text"))
        return texts.join(own, (F.col("node") == F.col("own")) & F.col("key").eqNullSafe(F.col("own_key")), "left_semi").select("node", "text").mapInArrow(_marks(shingle), "node long, marks array<long>")

    tops = near_copies(rows.select("id.node", "prefix"), nodes, marks_of, least, limit, cell)
    stay = nodes.select("node", "least")
    if tops is not None:
        grouped = nodes.select("node", "least").join(tops, nodes.node == tops.a, "left").withColumn("top", F.coalesce("b", "node"))
        stay = grouped.groupBy("top").agg(F.min(F.struct("least", "node")).alias("s")).select("s.node", "s.least")
    mine, theirs, keys = fresh(df, "node"), fresh(df, "stays"), fresh(df, "stay_key")
    stay = keep(stay.select(F.col("node").alias(theirs), F.col("least.key").alias(keys)), "stay")
    out = df.withColumn(mine, node).join(stay, (F.col(mine) == F.col(theirs)) & F.col(key).eqNullSafe(F.col(keys)))
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([key, mine])
    release(rows, nodes, tops)
    return out.select(*df.columns)
