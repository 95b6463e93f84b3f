"""Event-log operators against brute force, with one key that holds half of all rows, and stream = batch over many triggers."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakefold.operators import events as OE
from lakefold.streaming import events as SE

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(5)
    keys = ["hot"] * 400 + [f"k{rnd.randrange(40)}" for _ in range(400)]
    rows = [(k, START + timedelta(seconds=rnd.randrange(20000), microseconds=rnd.randrange(3) * 500000), i, rnd.choice("abc")) for i, k in enumerate(keys)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


@pytest.fixture(scope="module")
def events(spark, log):
    return spark.createDataFrame(log, "key STRING, ts TIMESTAMP, id BIGINT, value STRING").repartition(4).cache()


def by_key(log):
    groups = {}
    for row in log:
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("chunk", [10, 700, 3600, 10**6])
def test_state_changes(events, log, chunk):
    want = {r[2]: (rows[i - 1][3] if i else None, r[3]) for rows in by_key(log).values() for i, r in enumerate(rows)}
    got = {r.id: (r.old_value, r.new_value) for r in OE.state_changes(events, "key", "ts", "id", "value", chunk).collect()}
    assert got == want


def throttled(log, limit):
    kept = set()
    for rows in by_key(log).values():
        last = None
        for r in rows:
            if last is None or r[1] - last >= timedelta(seconds=limit):
                kept.add(r[2])
                last = r[1]
    return kept


@pytest.mark.parametrize("limit, chunk", [(60, 3600), (60, 61), (60, 10**6), (300, 500), (7, 100), (900, 10)])
def test_throttle(events, log, limit, chunk):
    assert {r.id for r in OE.throttle(events, "key", "ts", "id", limit, chunk).collect()} == throttled(log, limit)


@pytest.mark.parametrize("wait, chunk", [(60, 3600), (60, 30), (5, 10**6)])
def test_debounce(events, log, wait, chunk):
    want = {r[2] for rows in by_key(log).values() for i, r in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] - r[1] >= timedelta(seconds=wait)}
    assert {r.id for r in OE.debounce(events, ["key"], "ts", "id", wait, chunk).collect()} == want


@pytest.fixture(scope="module")
def burst():
    """Half of all rows are one key's within one hour, many at the same time."""
    rnd = random.Random(8)
    rows = [("hot", START + timedelta(seconds=rnd.randrange(40), microseconds=rnd.randrange(2) * 500000), i, rnd.choice("abc")) for i in range(2000)]
    rows += [(f"k{rnd.randrange(40)}", START + timedelta(seconds=rnd.randrange(90000)), 2000 + i, rnd.choice("abc")) for i in range(2000)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


def test_burst_in_one_chunk(spark, burst):
    frame = spark.createDataFrame(burst, "key STRING, ts TIMESTAMP, id BIGINT, value STRING").repartition(4).cache()
    sizes = OE.in_segments(frame, ["key"], "ts", "id", 3600, 100).groupBy("key", "_chunk").count().orderBy(F.desc("count")).collect()
    assert sum(r["count"] for r in sizes) == len(burst) and sizes[0]["count"] <= 250 and sum(r.key == "hot" for r in sizes) >= 15
    want = {r[2]: (rows[i - 1][3] if i else None, r[3]) for rows in by_key(burst).values() for i, r in enumerate(rows)}
    assert {r.id: (r.old_value, r.new_value) for r in OE.state_changes(frame, "key", "ts", "id", "value", segment_rows=100).collect()} == want
    for limit in (1, 7, 60, 900):
        assert {r.id for r in OE.throttle(frame, "key", "ts", "id", limit, segment_rows=100).collect()} == throttled(burst, limit)
    for wait in (1, 60):
        kept = {r[2] for rows in by_key(burst).values() for i, r in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] - r[1] >= timedelta(seconds=wait)}
        assert {r.id for r in OE.debounce(frame, ["key"], "ts", "id", wait, segment_rows=100).collect()} == kept


@pytest.mark.parametrize("bucket", [60, 5000, 86400])
def test_delivered(spark, events, log, bucket):
    rnd = random.Random(9)
    subs = [(i, rnd.choice(["hot", "k1", "k2"]), START + timedelta(seconds=a), None if i % 5 == 0 else START + timedelta(seconds=a + rnd.randrange(9000)))
            for i, a in enumerate(rnd.randrange(20000) for _ in range(40))]
    frame = spark.createDataFrame(subs, "sub INT, event STRING, on_ts TIMESTAMP, off_ts TIMESTAMP")
    want = {(s[0], r[2]) for s in subs for r in log if r[0] == s[1] and r[1] >= s[2] and (s[3] is None or r[1] < s[3])}
    rows = OE.delivered_events(events.withColumnRenamed("key", "event"), frame, bucket_seconds=bucket).select("sub", "id").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.fixture(scope="module")
def streamed(spark, log, tmp_path_factory):
    """The log as five files in time order, one per trigger."""
    folder = tmp_path_factory.mktemp("log")
    for n in range(5):
        part = log[n * 160:(n + 1) * 160]
        cols = list(zip(*part))
        pq.write_table(pa.table({"key": cols[0], "ts": pa.array(cols[1], pa.timestamp("us", "UTC")), "id": cols[2], "value": cols[3]}), folder / f"log-{n}.parquet")
    schema = spark.read.parquet(str(folder)).schema
    return lambda: SE.read_table_stream(spark, str(folder), "log", 1, schema)


def test_stream_state_changes(streamed, log):
    want = {r[2]: (rows[i - 1][3] if i else None, r[3]) for rows in by_key(log).values() for i, r in enumerate(rows)}
    got = {r.id: (r.old_value, r.new_value) for r in SE.run_available(SE.state_changes_stream(streamed(), "key", "ts", "id", "value")).collect()}
    assert got == want


def test_stream_throttle(streamed, log):
    assert {r.id for r in SE.run_available(SE.throttle_stream(streamed(), "key", "ts", "id", 60)).collect()} == throttled(log, 60)


def test_stream_counts_and_state(streamed, log):
    counted = SE.run_available(SE.event_counts_stream(streamed(), "value", "ts", "10 minutes", "0 seconds"))
    assert 0 < counted.agg(F.sum("events")).collect()[0][0] <= len(log)
    updates = SE.run_available(SE.current_state_stream(streamed(), "key", "ts", "id", "value"), "update")
    got = {r.key: r.value for r in updates.groupBy("key").agg(F.max_by("value", "_batch").alias("value")).collect()}
    assert got == {k: rows[-1][3] for k, rows in by_key(log).items()}


def _write_log(folder, name, rows):
    cols = list(zip(*rows))
    pq.write_table(pa.table({"key": cols[0], "ts": pa.array(cols[1], pa.timestamp("us", "UTC")), "id": cols[2], "value": cols[3]}), folder / f"{name}.parquet")


def test_once_survives_watermark_and_restart(spark, tmp_path):
    """A repeat hours later, in another trigger or after a restart, is not delivered again."""
    data, state = tmp_path / "data", tmp_path / "state"
    data.mkdir()
    late = START + timedelta(days=30)
    batches = [[("a", START, 1, "x"), ("a", START, 0, "x"), ("b", START, 2, "x")], [("a", late, 3, "x"), ("c", late, 4, "x")], [("b", late, 5, "x"), ("d", late, 6, "x")]]
    for n, rows in enumerate(batches):
        _write_log(data, f"log-{n}", rows)
        schema = spark.read.parquet(str(data)).schema
        out = SE.run_available(SE.once_stream(SE.read_table_stream(spark, str(data), "log", 1, schema), ["key"], "ts", "id"), folder=str(state))
    assert sorted((r.key, r.id) for r in out.collect()) == [("a", 0), ("b", 2), ("c", 4), ("d", 6)]


def test_once_forgets_after_its_time(spark, tmp_path):
    data, state = tmp_path / "data", tmp_path / "state"
    data.mkdir()
    for n in range(2):
        _write_log(data, f"log-{n}", [("a", START, n, "x")])
        schema = spark.read.parquet(str(data)).schema
        out = SE.run_available(SE.once_stream(SE.read_table_stream(spark, str(data), "log", 1, schema), ["key"], "ts", "id", ttl="1 millisecond"), folder=str(state), idle_batches=False)
    assert sorted(r.id for r in out.collect()) == [0, 1]


@pytest.mark.parametrize("buckets", [1, 3])
def test_bounded_deliveries_leave_no_state(spark, tmp_path, buckets):
    """Events and subscriptions over several triggers equal the batch; once all is closed and passed the state is empty."""
    rnd = random.Random(4)
    events = sorted(((rnd.choice("pq"), START + timedelta(seconds=rnd.randrange(20000)), i) for i in range(300)), key=lambda r: r[1])
    subs = [(i, rnd.choice("pq"), START + timedelta(seconds=a), START + timedelta(seconds=a + rnd.randrange(1, 5000))) for i, a in enumerate(sorted(rnd.randrange(20000) for _ in range(40)))]
    end = START + timedelta(days=2)
    rows = [("e", name, ts, i, None) for name, ts, i in events] + [("s", name, on, i, off) for i, name, on, off in subs]
    rows = sorted(rows, key=lambda r: r[2]) + [("e", "none", end, -1, None)]
    data = tmp_path / "data"
    data.mkdir()
    size = -(-len(rows) // 4)
    for n in range(4):
        cols = list(zip(*rows[n * size:(n + 1) * size]))
        pq.write_table(pa.table({"kind": cols[0], "event": cols[1], "ts": pa.array(cols[2], pa.timestamp("us", "UTC")), "id": pa.array(cols[3], pa.int64()), "off_ts": pa.array(cols[4], pa.timestamp("us", "UTC"))}), data / f"log-{n}.parquet")
    schema = spark.read.parquet(str(data)).schema
    log = lambda: SE.read_table_stream(spark, str(data), "log", 1, schema)
    met = SE.delivered_events_bounded_stream(log().where("kind = 'e'").select("event", "ts", "id"), log().where("kind = 's'").selectExpr("id AS sub", "event", "ts AS on_ts", "off_ts"), "10 minutes", buckets)
    query = met.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r["sub"], r.id) for r in spark.read.schema(met.schema).parquet(str(tmp_path / "out")).collect()]
    want = {(s, i) for s, name, on, off in subs for n, ts, i in events if n == name and on <= ts < off}
    assert len(got) == len(set(got)) and set(got) == want
    kept = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "subs").load()
    assert kept.count() == 0


def test_interval_from_long_ago_makes_no_buckets(spark, events):
    subs = spark.createDataFrame([(1, "hot", datetime(1990, 1, 1), None), (2, "hot", datetime(1990, 1, 1), datetime(1991, 1, 1))], "sub INT, event STRING, on_ts TIMESTAMP, off_ts TIMESTAMP")
    rows = OE.delivered_events(events.withColumnRenamed("key", "event"), subs, bucket_seconds=1)
    assert rows.where("sub = 1").count() == 400 and rows.where("sub = 2").count() == 0
