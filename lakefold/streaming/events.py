"""Event-log operators on Structured Streaming.

Each returns a streaming DataFrame; ``run_available`` drains one into files and reads them back.
Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import ensure_checkpoint_dir

WATERMARK = "10 minutes"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1,
                      schema: StructType | None = None) -> DataFrame:
    """The parquet files of a table in the folder as a stream of files; a table may be one file, several, or a folder of parts."""
    schema = schema or spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}*.parquet")
    )


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None, idle_batches: bool = True) -> DataFrame:
    """Process everything available, write the output as files in the shared folder, read it back.

    In update mode each trigger's rows land with their batch number in ``_batch``.  State with a time to live asks for
    batches without data for ever; without ``idle_batches`` the run ends with the data.
    """
    spark = stream.sparkSession
    root = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, state = f"{root}/out", f"{root}/state"
    # every shuffle partition is a state store; a local session gains nothing from more stores than cores
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), spark.sparkContext.defaultParallelism)))
    idle = spark.conf.get(_IDLE)
    spark.conf.set(_IDLE, str(idle_batches).lower())
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
            schema = stream.schema
        else:
            def write(batch: DataFrame, number: int) -> None:
                batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={number}")

            query = writer.foreachBatch(write).start()
            schema = stream.withColumn("_batch", F.lit(0).cast("bigint")).schema
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set(_IDLE, idle)
    reader = spark.read.schema(schema)
    return reader.parquet(out) if mode == "append" else reader.option("recursiveFileLookup", "true").parquet(out)


def event_counts_stream(events: DataFrame, event: str, ts: str, width: str, watermark: str = WATERMARK) -> DataFrame:
    counted = events.withWatermark(ts, watermark).groupBy(F.window(ts, width), event).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), event, "events")


def current_state_stream(events: DataFrame, key: str, ts: str, order_id: str, value: str) -> DataFrame:
    """Last value per key; run in update mode."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, order_id)).alias("value"), F.max(ts).alias("as_of"))


def first_occurrence_stream(events: DataFrame, keys: list[str], ts: str, watermark: str = WATERMARK) -> DataFrame:
    """``once`` within the watermark delay."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


class _Once(StatefulProcessor):
    """Remembers that a key was delivered, for ``ttl_ms`` of processing time or for good."""

    def __init__(self, ts: str, order_id: str, ttl_ms: int | None) -> None:
        self.order, self.ttl = [ts, order_id], ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes BOOLEAN", self.ttl) if self.ttl else handle.getValueState("seen", "yes BOOLEAN")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:  # the rows must be taken from the pipe
                pass
            return
        first = None
        for pdf in rows:
            here = pdf.sort_values(self.order).head(1)
            first = here if first is None else pd.concat([first, here]).sort_values(self.order).head(1)
        if first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def once_stream(events: DataFrame, keys: list[str], ts: str, order_id: str, ttl: str | None = None) -> DataFrame:
    """``once`` without a watermark: the first arrival of a key is delivered and never again.

    The memory of a key is durable state: it outlives late repeats and restarts of the query.  It ends after ``ttl`` of
    processing time (such as ``"30 days"``), if one is given; without it the state has one entry per key for good.  A
    query with ``ttl`` runs on a trigger interval, or until its data ends with ``run_available(idle_batches=False)``.
    """
    _use_rocksdb(events.sparkSession)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    return events.groupBy(*keys).transformWithStateInPandas(_Once(ts, order_id, ttl_ms), events.schema, "Append", "ProcessingTime" if ttl else "None")


def debounce_stream(events: DataFrame, keys: list[str], ts: str, order_id: str, wait: str, watermark: str = WATERMARK) -> DataFrame:
    """Last event of every burst; an open burst appears once the watermark has passed it."""
    rest = [c for c in events.columns if c not in keys]
    return (
        events.withWatermark(ts, watermark)
        .groupBy(*keys, F.session_window(ts, wait).alias("_burst"))
        .agg(F.max_by(F.struct(*rest), F.struct(ts, order_id)).alias("_last"))
        .select(*keys, "_last.*")
    )


#: Width of the time cells on which events meet closed subscriptions, and the cells that one may touch; a longer one meets its name's events.
CELL_SECONDS, MOST_CELLS = 7200, 64
#: Wider where a cell's events are sorted and not compared one by one: the state has fewer keys and a subscription fewer cells.
SORTED_CELL_SECONDS = 21600


def _cell(us: Column, seconds: int = CELL_SECONDS) -> Column:
    return F.floor(us / (seconds * 1_000_000)).cast("bigint")


def _places_of_event(us: Column, buckets: int, seconds: int = CELL_SECONDS) -> Column:
    """The event's cell (even), and every bucket of the open and long subscriptions of its name (odd)."""
    return F.concat(F.array(_cell(us, seconds) * 2), F.array(*[F.lit(2 * b + 1).cast("bigint") for b in range(buckets)]))


def _places_of_subscription(on_us: Column, off_us: Column, spread: Column, buckets: int, seconds: int = CELL_SECONDS) -> Column:
    """The cells that a closed subscription touches, or one bucket by ``spread``: an event meets it in exactly one place."""
    first, last = _cell(on_us, seconds), _cell(off_us - 1, seconds)
    bucket = F.array((F.pmod(spread, F.lit(buckets)) * 2 + 1).cast("bigint"))
    cells = F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda c: c * 2))
    return F.when(off_us.isNull() | (last - first >= MOST_CELLS), bucket).otherwise(cells)


def delivered_events_stream(events: DataFrame, subscriptions: DataFrame, watermark: str = WATERMARK, longest: str | None = None, buckets: int = 4) -> DataFrame:
    """Stream-stream interval join; a null ``off_ts`` is still open.

    Both sides are joined on name and place (see ``_places_of_subscription``), so a busy name is spread over its time
    and the rows compared are in proportion to the deliveries.  ``buckets`` spreads the open and long subscriptions.

    Without ``longest`` no subscription ends by itself, so the state keeps all of them.  With ``longest``, an interval
    such as ``"30 days"``, the caller states that no subscription is active for longer: later events are not delivered
    to it, and the state drops it once the watermark has passed that time.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spread = F.xxhash64(*subscriptions.columns)
    e = events.withWatermark("ts", watermark).withColumn("_place", F.explode(_places_of_event(us("ts"), buckets))).alias("e")
    s = subscriptions.withWatermark("on_ts", watermark).withColumn("_place", F.explode(_places_of_subscription(us("on_ts"), us("off_ts"), spread, buckets))).alias("s")
    within = "e.event = s.event AND e._place = s._place AND e.ts >= s.on_ts AND (s.off_ts IS NULL OR e.ts < s.off_ts)"
    bound = f" AND e.ts < s.on_ts + INTERVAL {longest}" if longest else ""
    return e.join(s, F.expr(within + bound)).drop(F.col("s.event")).drop("_place")


_OPEN = 2**62
_DELIVERY_COLUMNS = ["event", "_place", "_ts", "_us", "_off", "_event", "_sub"]


class _Deliveries(StatefulProcessor):
    """Open subscriptions of a name and the events that a later row may still meet; timers drop both.

    A subscription goes when the watermark reaches its end, an event when the watermark passes its time: rows that
    would still meet them are late by then.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.subs = handle.getListState("subs", "on_us BIGINT, off_us BIGINT, body STRING")
        self.events = handle.getListState("events", "us BIGINT, body STRING")

    def _pairs(self, subs: list[tuple], events: list[tuple]) -> Iterator[pd.DataFrame]:
        """The events inside each subscription's interval, by their sorted places; a subscription is sent once for many events."""
        if not subs or not events:
            return
        events = sorted(events, key=lambda e: e[0])
        times, bodies = np.array([e[0] for e in events]), [e[1] for e in events]
        on, off = (np.array(c) for c in zip(*((s[0], s[1]) for s in subs)))
        lo, hi = np.searchsorted(times, on), np.searchsorted(times, off)
        met, owners, size = [], [], 0
        for s, a, b in zip(subs, lo, hi):
            for at in range(a, b, 10_000):
                met.append(bodies[at : min(b, at + 10_000)])
                owners.append(s[2])
                size += len(met[-1])
                if size >= 10_000:
                    yield pd.DataFrame({"events": met, "sub": owners})
                    met, owners, size = [], [], 0
        if met:
            yield pd.DataFrame({"events": met, "sub": owners})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        old_subs, old_events = list(self.subs.get()), list(self.events.get())
        pdf.columns = _DELIVERY_COLUMNS  # a union's columns arrive unnamed
        own = pdf["_sub"].notna()
        new_subs = [(int(u), int(o), b) for u, o, b in zip(pdf.loc[own, "_us"], pdf.loc[own, "_off"], pdf.loc[own, "_sub"])]
        new_events = [(int(u), b) for u, b in zip(pdf.loc[~own, "_us"], pdf.loc[~own, "_event"])]
        yield from self._pairs(new_subs, old_events + new_events)
        yield from self._pairs(old_subs, new_events)
        now = timers.getCurrentWatermarkInMs() * 1000
        self._keep([s for s in old_subs + new_subs if s[1] > now], [e for e in old_events + new_events if e[0] >= now])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803 - passed by name
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([s for s in self.subs.get() if s[1] > now], [e for e in self.events.get() if e[0] >= now])
        return iter(())

    def _keep(self, subs: list[tuple], events: list[tuple]) -> None:
        for state, rows in ((self.subs, subs), (self.events, events)):
            if rows:
                state.put(rows)
            elif state.exists():
                state.clear()
        ends = [s[1] for s in subs if s[1] < _OPEN] + [e[0] + 1 for e in events]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ends:  # one timer a name, at the next end; it sets its successor
            self.handle.registerTimer(-(-min(ends) // 1000) + 1)

    def close(self) -> None:
        pass


def delivered_events_bounded_stream(events: DataFrame, subscriptions: DataFrame, watermark: str = WATERMARK, buckets: int = 1) -> DataFrame:
    """Each event beside every subscription ``(event, on_ts, off_ts, ...)`` active at its time; closed ones leave the state.

    Both inputs share one watermark; rows of either that come later than it are dropped.  A key is a name and a
    place (see ``_places_of_subscription``): closed subscriptions meet events on time cells, and ``buckets`` spreads the
    open and long ones of a name over that many keys, each of which sees the name's events.
    """
    _use_rocksdb(events.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("string")
    e = events.select(
        "event", F.explode(_places_of_event(us("ts"), buckets, SORTED_CELL_SECONDS)).alias("_place"), F.col("ts").cast("timestamp").alias("_ts"), us("ts").alias("_us"),
        F.lit(0).cast("bigint").alias("_off"), F.to_json(F.struct(*[c for c in events.columns if c != "ts"], us("ts").alias("ts"))).alias("_event"), none.alias("_sub"))
    extra = [c for c in subscriptions.columns if c != "event"]
    boxed = F.to_json(F.struct(*[us(c).alias(c) if c in ("on_ts", "off_ts") else F.col(c) for c in extra]))
    s = subscriptions.select(
        "event", F.explode(_places_of_subscription(us("on_ts"), us("off_ts"), F.xxhash64(boxed), buckets, SORTED_CELL_SECONDS)).alias("_place"), F.col("on_ts").cast("timestamp").alias("_ts"), us("on_ts").alias("_us"),
        F.coalesce(us("off_ts"), F.lit(_OPEN)).alias("_off"), none.alias("_event"), boxed.alias("_sub"))
    both = e.unionByName(s).withWatermark("_ts", watermark)
    met = both.groupBy("event", "_place").transformWithStateInPandas(
        _Deliveries(), "events ARRAY<STRING>, sub STRING", "Append", "EventTime")

    def read(body: str, frame: DataFrame, times: tuple[str, ...], columns: list[str]) -> Column:
        types = {f.name: "BIGINT" if f.name in times else f.dataType.simpleString() for f in frame.schema if f.name in columns}
        return F.from_json(body, ", ".join(f"`{n}` {t}" for n, t in types.items()))

    def opened(frame: DataFrame, box: str, times: tuple[str, ...], columns: list[str]) -> list[Column]:
        kinds = {f.name: f.dataType for f in frame.schema}
        values = {c: F.col(box)[c] for c in columns}
        return [F.timestamp_micros(values[c]).cast(kinds[c]).alias(c) if c in times else values[c].alias(c) for c in columns]

    # a subscription is read once for its events, before they are told apart
    met = met.select("events", read("sub", subscriptions, ("on_ts", "off_ts"), extra).alias("_s")).select("_s", F.explode("events").alias("_body"))
    met = met.select("_s", read("_body", events, ("ts",), events.columns).alias("_e"))
    return met.select(*opened(events, "_e", ("ts",), events.columns), *opened(subscriptions, "_s", ("on_ts", "off_ts"), extra))


class _LastValue(StatefulProcessor):
    """Keeps the last value of a key and emits (old, new) for each arrival in (ts, id) order."""

    def __init__(self, key: str, ts: str, order_id: str, value: str) -> None:
        self.names = (key, ts, order_id, value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value STRING")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        key_name, ts, order_id, value = self.names
        pdf = pd.concat(list(rows)).sort_values([ts, order_id])
        before = self.last.get()[0] if self.last.exists() else None
        new = pdf[value]
        old = new.shift(1)
        old.iloc[0] = before
        self.last.update((new.iloc[-1],))
        yield pd.DataFrame({key_name: key[0], ts: pdf[ts].to_numpy(), order_id: pdf[order_id].to_numpy(),
                            "old_value": old.to_numpy(), "new_value": new.to_numpy()})

    def close(self) -> None:
        pass


class _LastEmission(StatefulProcessor):
    """Keeps the time a key last emitted and lets the next event through ``limit`` later."""

    def __init__(self, ts: str, order_id: str, limit_us: int) -> None:
        self.ts, self.order_id, self.limit = ts, order_id, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.order_id])
        last = self.last.get()[0] if self.last.exists() else -(2**62)
        keep = []
        for us in pdf[self.ts].astype("datetime64[us]").astype("int64").to_numpy():
            hit = us >= last + self.limit
            keep.append(hit)
            last = int(us) if hit else last
        self.last.update((last,))
        yield pdf[keep]

    def close(self) -> None:
        pass


def _use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def state_changes_stream(events: DataFrame, key: str, ts: str, order_id: str, value: str) -> DataFrame:
    """Old and new value per set, for string values; arrivals of one trigger are ordered by (ts, id)."""
    _use_rocksdb(events.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"`{key}` {types[key]}, `{ts}` {types[ts]}, `{order_id}` {types[order_id]}, old_value STRING, new_value STRING"
    return events.select(key, ts, order_id, value).groupBy(key).transformWithStateInPandas(
        _LastValue(key, ts, order_id, value), schema, "Append", "None"
    )


def throttle_stream(events: DataFrame, key: str, ts: str, order_id: str, limit_seconds: float) -> DataFrame:
    _use_rocksdb(events.sparkSession)
    return events.groupBy(key).transformWithStateInPandas(
        _LastEmission(ts, order_id, int(limit_seconds * 1_000_000)), events.schema, "Append", "None"
    )
