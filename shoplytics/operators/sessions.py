"""Sessions and duplicates of the click stream (re-aim of the collector's
``sessionId`` / ``firstInSession`` / ``detectedDuplicate`` fields).

A session of a party is a run of its events with no gap longer than the
session timeout.  Batch: gaps-and-islands in two levels - the previous
event time per party (two-level lag), a session starts where the gap
exceeds the timeout, the session number is the running count of starts
(two-level running sum) - so a party with a third of all events still spans
many tasks.  Stream: ``session_window`` / ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.functions.times import epoch_micros, to_instant

from shoplytics.operators import ordering

# Fixed value: session timeout of the collector.
SESSION_TIMEOUT_SECONDS = 30 * 60


def mark_sessions(events: DataFrame, party: str = "party", ts: str = "ts",
                  tiebreak: str = "event_id",
                  timeout_s: int = SESSION_TIMEOUT_SECONDS) -> DataFrame:
    """Per event: ``first_in_session`` and ``session_no`` (1-based per party)."""
    us = epoch_micros(ts)
    order = ["__us", tiebreak]
    # One range partitioning (and checkpoint) serves both two-level passes.
    r = ordering.stage(events.withColumn("__us", us), [party], order)
    prev = ordering.staged_lag(r, [party], order, "__us", "__prev_us")
    first = F.col("__prev_us").isNull() | (F.col("__us") - F.col("__prev_us") > timeout_s * 10**6)
    marked = prev.withColumn("first_in_session", first)
    numbered = ordering.staged_running_sum(marked, [party], order,
                                           F.col("first_in_session").cast("int"), "session_no")
    return ordering.unstage(numbered).drop("__us", "__prev_us")


def sessions(marked: DataFrame, party: str = "party", ts: str = "ts",
             timeout_s: int = SESSION_TIMEOUT_SECONDS) -> DataFrame:
    """One row per session: start, end (last event + timeout, as a session
    window reports it) and event count - a hash aggregate."""
    return (marked.groupBy(party, "session_no")
                  .agg(F.min(ts).alias("session_start"),
                       (F.max(ts) + F.expr(f"INTERVAL {timeout_s} SECONDS")).alias("session_end"),
                       F.count(F.lit(1)).alias("n_events")))


def _instant(df: DataFrame, ts: str) -> DataFrame:
    """Event time as TIMESTAMP (watermarks need it); NTZ wall clock is read
    as UTC, a TIMESTAMP column is kept."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return df.withColumn(ts, to_instant(ts))
    return df


def stream_sessions(events: DataFrame, party: str = "party", ts: str = "ts",
                    watermark: str | None = "2 minutes",
                    timeout_s: int = SESSION_TIMEOUT_SECONDS) -> DataFrame:
    """Streaming form: session windows per party behind a watermark
    (``watermark=None`` when the input already carries one)."""
    e = _instant(events, ts)
    if watermark:
        e = e.withWatermark(ts, watermark)
    return (e.groupBy(party, F.session_window(ts, f"{timeout_s} seconds").alias("s"))
             .agg(F.count(F.lit(1)).alias("n_events"))
             .select(party, F.col("s.start").alias("session_start"),
                     F.col("s.end").alias("session_end"), "n_events"))


def drop_duplicate_events(events: DataFrame, key: str = "event_id", ts: str = "ts",
                          watermark: str = "2 minutes") -> DataFrame:
    """Streaming duplicate removal by event id within the watermark (the
    output keeps the watermark for the operators after it)."""
    return (_instant(events, ts).withWatermark(ts, watermark)
                                .dropDuplicatesWithinWatermark([key]))


def flag_duplicates(events: DataFrame, key: str = "event_id",
                    order_cols: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Batch ``detected_duplicate``: every copy of an event id after the
    first in ``order_cols`` order (two-level row number per id, so an id
    repeated millions of times is not ranked in one task)."""
    rn = ordering.group_row_number(events, [key], list(order_cols), "__copy")
    return rn.withColumn("detected_duplicate", F.col("__copy") > 1).drop("__copy")
