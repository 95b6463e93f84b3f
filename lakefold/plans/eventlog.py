"""Queries: event-log operators, batch and streaming, over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as OE
from ..streaming import events as SE
from ..streaming.ingest import detect_stream
from ..sources.files import stream_paths
from .tables import ALL_FILES, of_tables, query, table

CHUNK = 86400  # one day keeps the test table's chunks non-trivial


def _events(spark, sf):
    return table(spark, sf, "events")


_CHANGES = """
    SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value, event_type AS new_value FROM events
    """


@query("state_changes", _CHANGES)
def state_changes(spark, sf):
    rows = _events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    return OE.state_changes(rows, "user_id", "ts", "event_id", "event_type", CHUNK).select("user_id", "event_id", "old_value", "new_value")


_CURRENT = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id"


@query("current_state", _CURRENT)
def current_state(spark, sf):
    return OE.current_state(_events(spark, sf), "user_id", "ts", "event_id", "event_type")


@query(
    "first_occurrence",
    """
    SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
    """,
)
def first_occurrence(spark, sf):
    rows = _events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    return OE.first_occurrence(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("event_counts", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def event_counts(spark, sf):
    return OE.event_counts(_events(spark, sf), "event_type")


@query("event_counts_windowed", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_counts_windowed(spark, sf):
    counted = OE.event_counts(_events(spark, sf), "event_type", "ts", "1 hour")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events")


def _subscriptions(events):
    """A signup opens a six-hour subscription to clicks or views; some stay open for the rest of the log."""
    on = events.filter("event_type = 'signup'")
    return on.select(
        F.col("event_id").alias("sub_id"),
        F.when(F.col("event_id") % 2 == 0, "click").otherwise("view").alias("event"),
        F.col("ts").alias("on_ts"),
        F.when(F.col("event_id") % 100 != 0, F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("off_ts"),
    )


_SUBS = """s AS (SELECT event_id AS sub_id, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'view' END AS event, ts AS on_ts,
                 CASE WHEN event_id % 100 <> 0 THEN ts + INTERVAL 6 HOUR END AS off_ts FROM events WHERE event_type = 'signup')"""


@query(
    "delivered_events",
    f"""
    WITH {_SUBS} SELECT sub_id, event_id FROM events e JOIN s ON e.event_type = s.event AND e.ts >= on_ts AND (off_ts IS NULL OR e.ts < off_ts)
    """,
)
def delivered_events(spark, sf):
    rows = _events(spark, sf)
    points = rows.select("event_id", "ts", F.col("event_type").alias("event"))
    return OE.delivered_events(points, _subscriptions(rows)).select("sub_id", "event_id")


_DEBOUNCED = """
    SELECT user_id, event_id FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY coalesce(lead(ts) OVER w - ts >= INTERVAL 2 HOUR, true)
    """


@query("debounce", _DEBOUNCED)
def debounce(spark, sf):
    return OE.debounce(_events(spark, sf).select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 7200, CHUNK).select("user_id", "event_id")


# emitted set by following each user's chain of emissions
_THROTTLED = """
    WITH RECURSIVE chain AS (
      SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
      UNION ALL
      SELECT c.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 2 HOUR) AS ts
      FROM chain c WHERE c.ts IS NOT NULL)
    SELECT user_id, min(event_id) AS event_id FROM events JOIN chain USING (user_id, ts) GROUP BY user_id, ts
    """


@query("throttle", _THROTTLED)
def throttle(spark, sf):
    rows = _events(spark, sf).select("user_id", "ts", "event_id")
    return OE.throttle(rows, "user_id", "ts", "event_id", 7200, CHUNK).select("user_id", "event_id")


@query(
    "load_progress",
    """
    SELECT user_id, max(value) AS progress, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id
    """,
)
def load_progress(spark, sf):
    return OE.load_progress(_events(spark, sf), "user_id", "ts", "event_id", "event_type", "value")


# half of the log is one key's within one hour, many rows at the same time
_BURST = """b AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS k, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_seconds(event_id % 3600) ELSE ts END AS t,
    event_id, event_type FROM events)"""


def _burst(spark, sf):
    even = F.col("event_id") % 2 == 0
    return _events(spark, sf).select(
        F.when(even, F.lit(-1)).otherwise(F.col("user_id")).cast("bigint").alias("k"),
        F.when(even, F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") % 3600)).otherwise(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type")


@query("state_changes_burst", f"WITH {_BURST} SELECT event_id, lag(event_type) OVER (PARTITION BY k ORDER BY t, event_id) AS old_value, event_type AS new_value FROM b")
def state_changes_burst(spark, sf):
    return OE.state_changes(_burst(spark, sf), "k", "t", "event_id", "event_type", segment_rows=500).select("event_id", "old_value", "new_value")


@query("debounce_burst", f"WITH {_BURST} SELECT event_id FROM b WINDOW w AS (PARTITION BY k ORDER BY t, event_id) QUALIFY coalesce(lead(t) OVER w - t >= INTERVAL 1 SECOND, true)")
def debounce_burst(spark, sf):
    return OE.debounce(_burst(spark, sf), ["k"], "t", "event_id", 1, segment_rows=500).select("event_id")


@query(
    "throttle_burst",
    f"""
    WITH RECURSIVE {_BURST}, chain AS (
      SELECT k, min(t) AS t FROM b GROUP BY k
      UNION ALL
      SELECT c.k, (SELECT min(e.t) FROM b e WHERE e.k = c.k AND e.t >= c.t + INTERVAL 2 MINUTE) AS t FROM chain c WHERE c.t IS NOT NULL)
    SELECT min(event_id) AS event_id FROM b JOIN chain USING (k, t) GROUP BY k, t
    """,
)
def throttle_burst(spark, sf):
    return OE.throttle(_burst(spark, sf), "k", "t", "event_id", 120, segment_rows=500).select("event_id")


# ------------------------------------------------------------------ streaming


def _stream(spark, sf):
    return SE.read_table_stream(spark, sf, "events", ALL_FILES).withColumn("ts", F.col("ts").cast("timestamp"))


@query("state_changes_stream", _CHANGES)
def state_changes_stream(spark, sf):
    out = SE.run_available(SE.state_changes_stream(_stream(spark, sf), "user_id", "ts", "event_id", "event_type"))
    return out.select("user_id", "event_id", "old_value", "new_value")


@query("current_state_stream", _CURRENT)
def current_state_stream(spark, sf):
    updates = SE.run_available(SE.current_state_stream(_stream(spark, sf), "user_id", "ts", "event_id", "event_type"), "update")
    return updates.groupBy("user_id").agg(F.max_by("value", "_batch").alias("value"))


@query("first_occurrence_stream", "SELECT user_id, event_type, count(*) FILTER (false) AS repeats FROM events GROUP BY user_id, event_type")
def first_occurrence_stream(spark, sf):
    """All rows arrive in one trigger, so each name is delivered once."""
    out = SE.run_available(SE.first_occurrence_stream(_stream(spark, sf), ["user_id", "event_type"], "ts"))
    return out.groupBy("user_id", "event_type").agg((F.count(F.lit(1)) - 1).alias("repeats"))


@query("once_stream", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def once_stream(spark, sf):
    """The first arrival of each name, remembered without a watermark."""
    rows = _stream(spark, sf).select("user_id", "event_type", "ts", "event_id")
    return SE.run_available(SE.once_stream(rows, ["user_id", "event_type"], "ts", "event_id")).select("user_id", "event_type", "event_id")


@query(
    "event_counts_stream",
    """
    WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type, count(*) AS events FROM events GROUP BY ALL)
    SELECT strftime(b, '%Y-%m-%d %H:%M') AS window_start, event_type, events FROM w
    WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    """,
)
def event_counts_stream(spark, sf):
    """Windows the final watermark has closed."""
    out = SE.run_available(SE.event_counts_stream(_stream(spark, sf), "event_type", "ts", "1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events")


@query(
    "debounce_stream",
    """
    WITH q AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
    SELECT user_id, event_id FROM q WHERE coalesce(nx - ts >= INTERVAL 2 HOUR, true)
      AND ts + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    """,
)
def debounce_stream(spark, sf):
    rows = _stream(spark, sf).select("user_id", "ts", "event_id")
    return SE.run_available(SE.debounce_stream(rows, ["user_id"], "ts", "event_id", "2 hours")).select("user_id", "event_id")


@query("throttle_stream", _THROTTLED)
def throttle_stream(spark, sf):
    rows = _stream(spark, sf).select("user_id", "ts", "event_id")
    return SE.run_available(SE.throttle_stream(rows, "user_id", "ts", "event_id", 7200)).select("user_id", "event_id")


@query(
    "delivered_events_stream",
    f"""
    WITH {_SUBS} SELECT sub_id, event_id FROM events e JOIN s ON e.event_type = s.event AND e.ts >= on_ts AND (off_ts IS NULL OR e.ts < off_ts)
    """,
)
def delivered_events_stream(spark, sf):
    points = _stream(spark, sf).select("event_id", "ts", F.col("event_type").alias("event"))
    out = SE.run_available(SE.delivered_events_stream(points, _subscriptions(_stream(spark, sf))))
    return out.select("sub_id", "event_id")


@query(
    "delivered_events_bounded_stream",
    f"""
    WITH {_SUBS} SELECT sub_id, event_id FROM events e JOIN s ON e.event_type = s.event AND e.ts >= on_ts AND (off_ts IS NULL OR e.ts < off_ts)
    """,
)
def delivered_events_bounded_stream(spark, sf):
    """The same deliveries with a state from which ended subscriptions and passed events go."""
    points = _stream(spark, sf).select("event_id", "ts", F.col("event_type").alias("event"))
    out = SE.run_available(SE.delivered_events_bounded_stream(points, _subscriptions(_stream(spark, sf)), buckets=4))
    return out.select("sub_id", "event_id")


@query(
    "detect_stream",
    """
    SELECT name || '.parquet' AS name, 'unknown' AS type, 'unrouted' AS family FROM (VALUES ('benchmark'), ('conversations'), ('customer'),
      ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) v(name)
    """,
)
def detect_stream_query(spark, sf):
    """The table files arriving as a stream: none has a registered extension or signature."""
    found = detect_stream(stream_paths(spark, sf, glob="*.parquet"))
    out = SE.run_available(found)
    return of_tables(out, F.col("type"), F.col("family"))
