"""Batch twins of the streaming operators over events: the same functions on a table."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..session import table
from ..streaming import operators as streaming
from ._register import query


@query("SELECT date_trunc('day', ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_windows(spark, sf_dir):
    """Extension: tumbling windows."""
    r = streaming.tumbling(table(spark, sf_dir, "events"), "user_id")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("""
SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY 1, 2
""")
def ext_sliding_windows(spark, sf_dir):
    """Extension: windows of a day every twelve hours."""
    r = streaming.sliding(table(spark, sf_dir, "events"), "event_type")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s
""")
def ext_session_windows(spark, sf_dir):
    """Extension: sessions that end after six quiet hours."""
    r = streaming.sessions(table(spark, sf_dir, "events"), "user_id")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("SELECT a.user_id, a.ts AS left_ts, b.ts AS right_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def ext_stream_join(spark, sf_dir):
    """Extension: views followed by a purchase within the hour."""
    e = table(spark, sf_dir, "events")
    r = streaming.joined_streams(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")
    return r.select("user_id", F.col("left_ts").cast("timestamp_ntz").alias("left_ts"), F.col("right_ts").cast("timestamp_ntz").alias("right_ts"))
