"""STM-*: streams over the tables; each run drains what is there, so that it equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.plans.registry import query, table
from melisma.streaming import plays, sessions


@query("""SELECT kind, id, count(*) AS plays, max(ts) AS last_played FROM (SELECT 'track' AS kind, event_id % 500 AS id, ts FROM events UNION ALL SELECT 'release', (event_id % 500) // 12, ts FROM events UNION ALL SELECT 'artist', user_id, ts FROM events) GROUP BY 1, 2""")
def stm01_play_counts(spark, d):
    stream = plays.events(spark, d, "events.parquet", table(spark, d, "events").schema)
    track = F.col("event_id") % 500
    return plays.drained(plays.play_totals(stream.select(track.alias("track_id"), F.floor(track / 12).alias("release_id"), F.col("user_id").alias("artist_id"), "ts")))


def _messages(spark, d):
    """Conversations as sessions: the first turn creates, then joins, tracks and pauses."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("join", "nowPlaying", "pause", "position", "resume", "leave")]), (F.col("turn") % 6 + 1).cast("int"))
    return table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") == 0, "host").otherwise(F.concat(F.lit("p"), F.col("turn").cast("string"))).alias("peer_id"),
        F.when(F.col("turn") == 0, "create").otherwise(kind).alias("type"), F.col("text").alias("track"), F.col("turn").cast("double").alias("position"),
    )


@query("""SELECT 's' || conv_id AS session_id, turn AS seq, count(CASE WHEN turn > 0 AND turn % 6 = 0 THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS listeners FROM (SELECT DISTINCT conv_id, turn FROM conversations)""")
def stm04_listeners(spark, d):
    return sessions.replay(_messages(spark, d)).select("session_id", "seq", "listeners")


#: The state after each turn, as SQL: the first turn creates the session and nothing ends it.
_STATES = """(SELECT 's' || conv_id AS session_id, turn AS seq, true AS active, last_value(CASE WHEN k = 1 THEN text END IGNORE NULLS) OVER w AS track,
 coalesce(last_value(CASE WHEN k IN (1, 4) THEN true WHEN k = 2 THEN false END IGNORE NULLS) OVER w, false) AS playing,
 coalesce(last_value(CASE WHEN k BETWEEN 1 AND 4 THEN turn END IGNORE NULLS) OVER w, 0)::DOUBLE AS position, count(CASE WHEN k = 0 AND turn > 0 THEN 1 END) OVER w::INTEGER AS listeners
FROM (SELECT conv_id, turn, min(text) AS text, CASE WHEN turn = 0 THEN -1 ELSE turn % 6 END AS k FROM conversations GROUP BY 1, 2) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"SELECT * FROM {_STATES}")
def stm03_session_state(spark, d):
    return sessions.replay(_messages(spark, d))


@query(f"SELECT * EXCLUDE (seq, r) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM {_STATES}) WHERE r = 1")
def stm06_status(spark, d):
    return sessions.status(sessions.replay(_messages(spark, d)))


@query("SELECT 'message' AS source, 'unknown type: ' || role AS message FROM conversations")
def stm10_dispatch(spark, d):
    return sessions.dispatched(table(spark, d, "conversations").select(F.col("role").alias("type")))[1]


@query("SELECT event_id, round(CASE WHEN event_type = 'view' THEN value + datediff('microsecond', ts, TIMESTAMP '2024-02-01') / 1000000.0 ELSE value END, 1) AS position FROM events")
def stm08_interpolated(spark, d):
    now = F.lit("2024-02-01").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.round(sessions.heard_position(F.col("value"), F.col("event_type") == "view", F.col("ts"), now), 1).alias("position"))
