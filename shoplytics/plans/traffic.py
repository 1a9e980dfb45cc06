"""Registered traffic, archive and session queries (A1, M1, M14, M15, C7, C13,
S2, S4, S6, S8, S9, ST1 to ST5, F11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.functions.times import epoch_millis

from shoplytics.operators import traffic
from shoplytics.plans.registry import register
from shoplytics.sources import bindings
from shoplytics.sources.bindings import click_events, use_utc


@register("events_per_minute", ["A1", "ST2", "C7"], bench=True, sql="""
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start,
       time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end,
       event_type,
       count(*) AS "count"
FROM events
GROUP BY ALL
""")
def events_per_minute(spark, sf_dir):
    """Events per 1-minute tumbling window and event type."""
    return traffic.count_per_window(click_events(spark, sf_dir), "ts", "event_type")


@register("events_all", ["M14"], sql="""
SELECT event_id, ts, user_id AS shopper, event_type,
       json_extract_string(props, '$.k') AS item
FROM events
""")
def events_all(spark, sf_dir):
    """Identity job over the bound click events."""
    return traffic.all_events(click_events(spark, sf_dir))


@register("event_time_projection", ["M15", "C7"], sql="""
SELECT event_type AS "eventType", epoch_ms(CAST(floor(epoch_us(ts) / 1000) AS BIGINT)) AS ts
FROM events
""")
def event_time_projection(spark, sf_dir):
    """Two-column projection: event type and epoch-ms time back to a timestamp."""
    use_utc(spark)
    ev = click_events(spark, sf_dir).select(
        "event_type", epoch_millis("ts").alias("timestamp"))
    return (traffic.with_event_time(ev, "timestamp", "event_type")
            .select("eventType", F.col("ts").cast("timestamp_ntz").alias("ts")))


@register("events_per_minute_stream", ["ST1", "ST2", "ST4", "ST5", "S2", "S8"], sql="""
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start,
       time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end,
       event_type,
       count(*) AS "count"
FROM events
GROUP BY ALL
""")
def events_per_minute_stream(spark, sf_dir):
    """The per-minute count as a watermarked stream over the event files,
    final state read back from the per-batch update table."""
    from shoplytics.streaming.traffic import events_per_minute_stream as run
    return run(spark, sf_dir)


_EVENT_COLS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@register("events_archive_roundtrip", ["S6", "S2", "ST5"], sql=_EVENT_COLS_SQL)
def events_archive_roundtrip(spark, sf_dir):
    """Events streamed into the rolling Parquet archive, then read back."""
    from shoplytics.sources import archive
    from shoplytics.sources.tables import table
    from shoplytics.streaming import runner
    from shoplytics.streaming.traffic import event_table_stream
    out = runner.scratch(spark, "archive")
    q = archive.rolling_file_sink(event_table_stream(spark, sf_dir), out + "/data",
                                  out + "/ckpt", interval=None).start()
    q.awaitTermination()
    schema = table(spark, sf_dir, "events").schema
    return archive.read_archive(spark, out + "/data", schema).select(
        "event_id", "ts", "user_id", "event_type", "value", "props")


@register("event_props_parsed", ["S4", "C13"], sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def event_props_parsed(spark, sf_dir):
    """Event properties parsed with a declared schema and flattened."""
    from shoplytics.sources import archive
    from shoplytics.sources.tables import table
    ev = table(spark, sf_dir, "events")
    return archive.parse_json_records(ev, "k bigint", col="props", keep=("event_id",))


@register("events_json_roundtrip", ["S9", "C13"], sql=_EVENT_COLS_SQL)
def events_json_roundtrip(spark, sf_dir):
    """Events dumped as JSON lines and parsed back with the table schema."""
    from shoplytics.sources import archive
    from shoplytics.sources.tables import table
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value", "props")
    return archive.parse_json_records(archive.to_json_lines(ev), ev.schema)


@register("event_sessions", ["M1"], sql="""
WITH e AS (SELECT user_id, ts, event_id,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
f AS (SELECT *, prev IS NULL OR ts - prev > INTERVAL 30 MINUTE AS first_in_session FROM e),
n AS (SELECT *, CAST(sum(CAST(first_in_session AS INTEGER)) OVER (PARTITION BY user_id
               ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
               AS session_no
      FROM f)
SELECT user_id AS party, session_no, min(ts) AS session_start,
       max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
FROM n GROUP BY 1, 2
""")
def event_sessions(spark, sf_dir):
    """Sessions per party (30-minute inactivity timeout): start, end and
    event count, from two-level gaps-and-islands - the collector's
    ``sessionId`` / ``firstInSession`` fields derived from the events."""
    from shoplytics.operators import sessions as se
    from shoplytics.sources.tables import table
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("party"), "ts", "event_id")
    return se.sessions(se.mark_sessions(ev)).select(
        "party", "session_no", "session_start", "session_end", "n_events")


# Per run of a job: the latest event time of all runs before it.
_MARKS = "marks AS (SELECT a.arrival, max(b.us) AS mark FROM (SELECT DISTINCT arrival FROM e) a " \
         "LEFT JOIN e b ON b.arrival < a.arrival GROUP BY a.arrival)"


@register("events_per_minute_late", ["ST3", "ST1", "A1"], sql=f"""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM ({bindings.arriving_sql()})), {_MARKS},
r AS (
  SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, event_type,
         coalesce(epoch_us(time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute') <= mark - 120000000, false) AS late
  FROM e JOIN marks USING (arrival))
SELECT window_start, event_type, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late FROM r GROUP BY ALL
""")
def events_per_minute_late(spark, sf_dir):
    """Per-minute counts of a job run once per arrival of files, and beside them the rows that came
    after their window had ended by the watermark, which the job writes to a table of their own."""
    from shoplytics.streaming import folds, runner
    base = runner.scratch(spark, "late")
    rows = bindings.arriving_events(spark, sf_dir).select("event_id", "ts", "event_type", "arrival")
    folds.replay(spark, rows, "arrival", base, folds.late_step(), folds.LATE_STATE)
    late = traffic.count_per_window(folds.read(spark, base, "late"), "ts", "event_type")
    both = folds.read(spark, base, "counts").withColumn("kind", F.lit("kept")).drop("batch") \
        .unionByName(late.withColumn("kind", F.lit("late")))
    return both.groupBy("window_start", "event_type").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(k) for k in ("kept", "late")])


@register("events_flagged_stream", ["F11", "ST5"], sql=f"""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM ({bindings.sent_again_sql()})), {_MARKS},
r AS (
  SELECT e.event_id, e.ts, e.arrival, mark, row_number() OVER (PARTITION BY e.event_id, e.arrival ORDER BY e.ts) AS n,
         (SELECT max(b.us) FROM e b WHERE b.event_id = e.event_id AND b.arrival < e.arrival) AS before
  FROM e JOIN marks USING (arrival))
SELECT event_id, ts, n > 1 OR coalesce(before >= mark - 518400000000, false) AS detected_duplicate,
       event_id % 97 = 0 AS detected_corruption FROM r
""")
def events_flagged_stream(spark, sf_dir):
    """Events with copies and damaged ones, in several runs: flags for the copies of an event still
    remembered and for bodies that don't fit their checksum.  All rows are kept."""
    from shoplytics.streaming import folds, runner
    base = runner.scratch(spark, "flags")
    rows = bindings.events_sent_again(spark, sf_dir).select("event_id", "ts", "props", "checksum", "arrival")
    folds.replay(spark, rows, "arrival", base, folds.duplicate_step(), folds.DUPLICATE_STATE)
    return folds.read(spark, base, "flagged").select("event_id", "ts", "detected_duplicate", "detected_corruption")


@register("event_sessions_stream", ["M1", "ST5"], sql="""
WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id AS party, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
FROM n GROUP BY user_id, no
""")
def event_sessions_stream(spark, sf_dir):
    """Sessions merged from run to run, late events within the watermark included: the closed ones
    and those still open after the last run."""
    from shoplytics.streaming import folds, runner
    base = runner.scratch(spark, "sessions")
    rows = bindings.arriving_events(spark, sf_dir).select(F.col("user_id").alias("party"), "ts", "arrival")
    folds.replay(spark, rows, "arrival", base, folds.session_step(), folds.SESSION_STATE)
    return folds.all_sessions(spark, base).select(
        "party", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")
