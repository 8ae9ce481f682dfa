"""Sharding over fixed virtual slots.

Every record hashes into one of a few thousand slots, the bytes of each slot are
summed, and a versioned map says which shard a slot belongs to.  Adding a shard
edits the map: some slots move to it, all others stay, so no record moves between
old shards.  The map has one row per slot whatever the data; it is the only thing
the driver sees.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import shared_path

SLOTS = 4096
#: Bytes counted for a record besides its text.
RECORD_BYTES = 8
#: Rows a repeated row is spelled out in at a time.
_STRETCH = 1024


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot belongs to, and how often that was edited."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def write(self, spark: SparkSession, path: str) -> None:
        """Add this version to the history at ``path``."""
        self.frame(spark).write.mode("append").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest by default."""
        rows = spark.read.parquet(path)
        wanted = rows.agg(F.max("version")).first()[0] if version is None else version
        found = rows.filter(F.col("version") == wanted).orderBy("vslot").collect()
        return SlotMap(wanted, found[0]["n_shards"], tuple(r["shard"] for r in found))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, i, s) for i, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, n_shards int, vslot int, shard int")


def new_map(weights: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
    """Heaviest slot first, each to the lightest shard so far."""
    heap = [(0, s) for s in range(n_shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda i: (-weights.get(i, 0), i)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return SlotMap(1, n_shards, tuple(shard_of))


def grow(old: SlotMap, weights: dict[int, int]) -> SlotMap:
    """One more shard: slots go from the heaviest shards to it until it has its share."""
    loads = [0] * old.n_shards
    slots_of: list[list[int]] = [[] for _ in range(old.n_shards)]
    for slot, shard in enumerate(old.shard_of):
        loads[shard] += weights.get(slot, 0)
        slots_of[shard].append(slot)
    share = sum(loads) / (old.n_shards + 1)
    for own in slots_of:
        own.sort(key=lambda i: (weights.get(i, 0), i))
    shard_of, new_load = list(old.shard_of), 0
    heap = [(-load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    while heap:
        load, shard = heapq.heappop(heap)
        while slots_of[shard]:
            slot = slots_of[shard].pop()
            weight = weights.get(slot, 0)
            if weight and new_load + weight <= share and -load - weight >= share * 0.98:
                new_load += weight
                shard_of[slot] = old.n_shards
                heapq.heappush(heap, (load + weight, shard))
                break
    return SlotMap(old.version + 1, old.n_shards + 1, tuple(shard_of))


def rebalanced(old: SlotMap, weights: dict[int, int], tolerance: float = 0.02) -> SlotMap:
    """The map edited for changed weights; itself if no shard is off by ``tolerance`` of a share.

    Slots go from the heaviest shard to the lightest, that which brings both closest
    first, until they are within the tolerance or no move helps."""
    loads = [0] * old.n_shards
    slots_of: list[list[int]] = [[] for _ in range(old.n_shards)]
    for slot, shard in enumerate(old.shard_of):
        loads[shard] += weights.get(slot, 0)
        slots_of[shard].append(slot)
    room, shard_of, settled = sum(loads) / old.n_shards * tolerance, list(old.shard_of), set()
    while len(settled) < old.n_shards:
        top, low = max(set(range(old.n_shards)) - settled, key=lambda s: (loads[s], -s)), min(range(old.n_shards), key=lambda s: (loads[s], s))
        apart = loads[top] - loads[low]
        if apart <= room:
            break
        fits = [i for i in slots_of[top] if 0 < weights.get(i, 0) < apart]
        if not fits:  # one slot too large to share
            settled.add(top)
            continue
        slot = min(fits, key=lambda i: (abs(2 * weights.get(i, 0) - apart), i))
        for shard, sign in ((top, -1), (low, 1)):
            loads[shard] += sign * weights.get(slot, 0)
        slots_of[top].remove(slot)
        slots_of[low].append(slot)
        shard_of[slot] = low
    return old if shard_of == list(old.shard_of) else SlotMap(old.version + 1, old.n_shards, tuple(shard_of))


def stored_map(spark: SparkSession, history: str, weights: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
    """The latest map at ``history``, edited there if the weights ask for it; a first one if there is none.

    What is used is always what was read back."""
    path = spark._jvm.org.apache.hadoop.fs.Path(history)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new_map(weights, n_shards, slots).write(spark, history)
        return SlotMap.read(spark, history)
    found = SlotMap.read(spark, history)
    if found.n_shards != n_shards or len(found.shard_of) != slots:
        raise ValueError(f"the map at {history} has {found.n_shards} shards and {len(found.shard_of)} slots")
    edited = rebalanced(found, weights)
    if edited is not found:
        edited.write(spark, history)
        found = SlotMap.read(spark, history)
    return found


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the fixed part."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def with_slot(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``size``, ``text_crc32`` and ``vslot`` of each record.

    The slot hashes the key with the text's checksum, so that a key that many
    different rows share (a null one, say) does not fill one slot.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    out = df.select(F.col(key), record_size(F.col(text)).alias("size"), crc.alias("text_crc32"))
    return out.withColumn("vslot", F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(slots)).cast("int"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def shard_records(df: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text",
                  slots: int = SLOTS, slot_map: SlotMap | None = None, history: str | None = None) -> DataFrame:
    """The shard of every record and its place there (``slot``, gapless from 0).

    Shards come out near equal in bytes (law ``bytes``).  Columns: key, ``size``,
    ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null under this
    law), ``vslot``, ``map_version``.  A null text counts as empty, a null key is a
    key like any other, equal rows all stay and get places of their own, an empty
    table gives an empty result.  Columns besides key and text are not read.

    The map is the latest one stored at ``history`` (a new folder by default), edited
    there if the bytes have outgrown it, unless ``slot_map`` gives one.  Rows that agree in
    key, checksum and size are counted before they are numbered, so a row repeated over a
    third of the table is one row of its slot.  Places are numbered per virtual slot; what comes before a slot in its shard is
    known from the slot totals, so no task sees a whole shard.
    """
    spark = df.sparkSession
    slotted = with_slot(df, key, text, slots)
    totals = {r["vslot"]: (r["bytes"], r["rows"]) for r in slot_bytes(slotted).collect()}  # at most `slots` rows
    weights = {s: b for s, (b, _) in totals.items()}
    found = slot_map or stored_map(spark, history or shared_path(spark, "slot-map"), weights, n_shards, slots)
    before, filled = [], [0] * found.n_shards
    for slot, shard in enumerate(found.shard_of):
        before.append((slot, shard, filled[shard]))
        filled[shard] += totals.get(slot, (0, 0))[1]
    places = spark.createDataFrame(before, "vslot int, shard int, _before long")
    within = W.partitionBy("vslot").orderBy(key, "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    counted = slotted.groupBy(key, "text_crc32", "size", "vslot").agg(F.count("*").alias("_n"))
    placed = counted.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    # repeated rows again, by stretches of a bounded length
    stretch = placed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _STRETCH))))
    each = F.explode(F.sequence(F.col("_s") * _STRETCH, F.least(F.col("_n"), (F.col("_s") + 1) * _STRETCH) - 1))
    numbered = stretch.withColumn("_i", each).withColumn("_local", F.col("_first") + F.col("_i"))
    joined = numbered.join(F.broadcast(places), "vslot")  # one row per slot, a fixed number
    return joined.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_local")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(found.version).alias("map_version"))
