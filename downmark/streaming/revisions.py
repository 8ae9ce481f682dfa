"""Live feed jobs: revisions, delayed release, running clocks, picks and delay samples."""

from __future__ import annotations

import itertools
import pickle
import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import STATE_STORE, shared_folder

# Stateful processors also run in a worker of the driver that does not see shipped archives:
# their classes travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REVISION = "game bigint, play string, event_id bigint, at bigint, content string, version int, late boolean"
RELEASE = "game bigint, play string, event_id bigint, observed_at bigint, released_at bigint, content string, revised boolean"
CLOCKS = "game bigint, event_id bigint, clock_key int, run int"


def read_feed(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed and read its sink back."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Revisions(StatefulProcessor):
    """Emits a report only when its content differs from the play's last one.

    State per game: last content, version and newest order of each of its plays, read and
    written once a batch.  A report older than the play's newest one is kept but flagged as late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "play string, content string, version int, newest bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        plays = {x[0]: (x[1], x[2], x[3]) for x in self.last.get()}
        for row in sorted(rows, key=lambda x: x.event_id):
            content, version, newest = plays.get(row.play, (None, 0, -1))
            late, same = row.event_id < newest, row.content == content
            version += not same
            plays[row.play] = (row.content, version, max(newest, row.event_id))
            if not same:
                yield Row(game=key[0], play=row.play, event_id=row.event_id, at=row.at, content=row.content, version=version, late=late)
        self.last.put([(play, *known) for play, known in plays.items()])

    def close(self) -> None:
        pass


class RepeatedClock(StatefulProcessor):
    """Emits when a game's clock has been the same for three reports in a row."""

    def __init__(self, least: int = 3):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "clock_key int, length int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.run.get() if self.run.exists() else None
        clock, length = (state[0], state[1]) if state else (None, 0)
        for row in sorted(rows, key=lambda x: x.event_id):
            length = length + 1 if row.clock_key == clock else 1
            clock = row.clock_key
            if length == self.least:
                yield Row(game=key[0], event_id=row.event_id, clock_key=clock, run=length)
        self.run.update((clock, length))

    def close(self) -> None:
        pass


#: Keys that the plays or games of a feed are dealt over.
PARTS = 1024


def dealt(feed: DataFrame, by, columns, parts: int) -> DataFrame:
    """The feed's ``columns`` behind the ``part`` that holds all rows of a key ``by``.

    Games and plays are many and small.  A part answers for all of its own at once, so a
    trigger calls the state store a few times a part and not a few times a play."""
    return feed.select(F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int").alias("part"), *columns)


class Held:
    """What a part knows of each of its keys, as a log of packed changes.

    ``read`` merges the log; ``write`` appends what a trigger changed, None for a key that
    goes, and packs the log anew once it has ``most`` entries, ``size`` keys in each."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, most: int = 16, size: int = 20_000):
        self.log, self.most, self.size = handle.getListState(name, "changes binary"), most, size

    def read(self) -> dict:
        known, self.entries = {}, 0
        for (packed,) in self.log.get():
            known.update(pickle.loads(packed))
            self.entries += 1
        return {k: v for k, v in known.items() if v is not None}

    def write(self, known: dict, changed: dict) -> None:
        if not changed:
            return
        packed = self._packed(changed)
        if self.entries + len(packed) <= self.most + len(known) // self.size:
            self.log.appendList(packed)
            return
        packed = self._packed(known)
        if packed:
            self.log.put(packed)
        else:
            self.log.clear()

    def _packed(self, values: dict) -> list:
        items = iter(values.items())
        return [(pickle.dumps(dict(some)),) for some in iter(lambda: list(itertools.islice(items, self.size)), [])]


class DelayedRelease(StatefulProcessor):
    """Holds each report until observed + delay.

    A report of the play that is observed before then takes its place and waits its
    own delay, so a version that was corrected in time never shows.  A correction of
    a report that has been shown is released as ``revised``.  State per (game, play), kept
    by part: how often one has been shown, and the reports that wait.  Reports may come in any
    order within the lateness of the watermark: what is released is decided when the
    watermark passes its due time, by when every report that could replace it is here.
    A part has a timer for the first report that waits and releases all that is due.
    """

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held, self.swept = handle, Held(handle, "waiting"), set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, changed, first = self.held.read(), {}, None
        for _, game, play, event_id, at, content, _ in rows:
            if event_id is None:  # a tick of the clock, not a report
                continue
            due = at + self.delay
            held = known.setdefault((game, play), (0, {}))
            held[1][due, event_id] = (at, content)
            changed[game, play] = held
            first = due if first is None else min(first, due)
        if first is not None:
            self.handle.registerTimer(first)
            self.held.write(known, changed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key in self.swept:
            return
        self.swept.add(key)
        now, known, changed, first = timerValues.getCurrentWatermarkInMs(), self.held.read(), {}, None
        for (game, play), (n, waiting) in known.items():
            places = sorted(waiting)
            ready = [x for x in places if x[0] <= now]
            for i, (due, event_id) in enumerate(ready):
                after = places[i + 1] if i + 1 < len(places) else None
                # replaced by a later one before it was shown, or not the last of those due together
                if after is None or waiting[after][0] > due:
                    at, content = waiting[due, event_id]
                    yield Row(game=game, play=play, event_id=event_id, observed_at=at, released_at=due, content=content, revised=n > 0)
                    n += 1
            if ready:
                for x in ready:
                    del waiting[x]
                changed[game, play] = (n, waiting)
            if len(ready) < len(places):
                first = places[len(ready)][0] if first is None else min(first, places[len(ready)][0])
        known.update(changed)
        self.held.write(known, changed)
        if first is not None:
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def revisions(feed: DataFrame) -> DataFrame:
    with_state_store(feed.sparkSession)
    return feed.groupBy("game").transformWithState(Revisions(), REVISION, "Append", "None")


def repeated_clocks(feed: DataFrame, least: int = 3) -> DataFrame:
    with_state_store(feed.sparkSession)
    return feed.groupBy("game").transformWithState(RepeatedClock(least), CLOCKS, "Append", "None")


def delayed_release(feed: DataFrame, delay: int, lateness: str, time: str = "ts", parts: int = PARTS) -> DataFrame:
    """Releases fire when the watermark passes observed + delay.

    ``lateness`` says how much later than a newer report one may still come; the
    watermark drops what is later, and counts it in the query's progress."""
    with_state_store(feed.sparkSession)
    timed = dealt(feed.withWatermark(time, lateness), ("game", "play"), ("game", "play", "event_id", "at", "content", time), parts)
    return timed.groupBy("part").transformWithState(DelayedRelease(delay), RELEASE, "Append", "EventTime")


def release_all(feed: DataFrame, delay: int, lateness: str, folder: str, time: str = "ts") -> DataFrame:
    """``delayed_release`` of a feed that has an end: when all of it is read, the clock runs on.

    A second run of the same query reads one tick, far enough after the last report
    for the watermark to pass everything that waits; then the state is empty."""
    spark = feed.sparkSession
    ticks = f"{folder}/ticks"
    fields = {f.name: f.dataType for f in feed.schema.fields}
    feed.sparkSession.createDataFrame([], feed.schema).write.mode("append").parquet(ticks)
    clock = spark.readStream.schema(feed.schema).parquet(ticks)
    released = delayed_release(feed.union(clock), delay, lateness, time)

    def go() -> None:
        (released.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination())

    go()
    end = spark.sql(f"select timestamp '9999-01-01 00:00:00' - interval {lateness} as at").first()["at"]
    values = [F.lit(end).cast(t).alias(n) if n == time else F.lit(-1).cast(t).alias(n) if n == "game" else F.lit(None).cast(t).alias(n) for n, t in fields.items()]
    spark.range(1).select(*values).write.mode("append").parquet(ticks)
    go()
    return spark.read.schema(released.schema).parquet(f"{folder}/out")


def settle_picks(picks: DataFrame, results: DataFrame, within: str = "2 hours") -> DataFrame:
    """Stream-stream join of picks and results of the same game within a time bound."""
    p = picks.withWatermark("pick_ts", within).alias("p")
    r = results.withWatermark("result_ts", within).alias("r")
    cond = F.expr(f"p.game = r.game and result_ts >= pick_ts and result_ts <= pick_ts + interval {within}")
    return p.join(r, cond).select("p.pick_id", "p.game", "r.result_id", "pick_ts", "result_ts")


def delay_samples(receipts: DataFrame, taps: DataFrame, within: str = "90 seconds") -> DataFrame:
    """A viewer's tap between a receipt and the bound after it."""
    a = receipts.withWatermark("receipt_ts", within).alias("a")
    b = taps.withWatermark("tap_ts", within).alias("b")
    cond = F.expr(f"a.game = b.game and tap_ts >= receipt_ts and tap_ts <= receipt_ts + interval {within}")
    return a.join(b, cond).selectExpr("a.game", "receipt_id", "tap_id", "unix_micros(tap_ts) - unix_micros(receipt_ts) as micros")


def first_settlement(settled: DataFrame) -> DataFrame:
    """Only the first result counts."""
    return settled.groupBy("pick_id", "game").agg(F.expr("min_by(result_id, struct(result_ts, result_id)) as result_id"))


def latest_situation(batch: DataFrame) -> DataFrame:
    """Of several situations due at once only the last one is published."""
    return batch.groupBy("game").agg(F.expr("max_by(struct(event_id, play, content), event_id) as s")).select("game", "s.*")


def situation_kinds(changes: DataFrame) -> DataFrame:
    """New snap, context-only refresh or no snap, from a report and the one before it."""
    return changes.selectExpr("*", "case when play is null then 'no_snap' when prev_play is null or prev_play <> play then 'new_snap' else 'context' end as emitted")


def publish_batches(feed: DataFrame, summarize, folder: str) -> None:
    """foreachBatch: recompute only the touched games and replace their partitions."""
    spark = feed.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append").partitionBy("game").parquet(f"{folder}/log")
        touched = batch.select("game").distinct()
        whole = spark.read.parquet(f"{folder}/log").join(touched, "game", "left_semi").dropDuplicates(["game", "event_id"])
        (summarize(whole).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("game").parquet(f"{folder}/summary"))

    feed.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
