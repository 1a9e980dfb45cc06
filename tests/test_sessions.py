"""Sessions and duplicates: two-level batch form against session windows
and a plain model."""

import datetime as dt

from pyspark.sql import functions as F

from shoplytics.operators import sessions as ss


def _events(spark):
    base = dt.datetime(2024, 1, 1)
    mins = {1: [0, 10, 45, 50, 200], 2: [5, 6], 3: [0]}
    rows, eid = [], 0
    for party, ms in mins.items():
        for m in ms:
            rows.append((party, base + dt.timedelta(minutes=m), eid))
            eid += 1
    return spark.createDataFrame(rows, "party long, ts timestamp_ntz, event_id long")


def test_batch_sessions_equal_session_windows(spark):
    ev = _events(spark)
    got = sorted((r["party"], r["session_start"], r["session_end"], r["n_events"])
                 for r in ss.sessions(ss.mark_sessions(ev)).collect())
    win = (ev.withColumn("ts", F.col("ts").cast("timestamp"))
             .groupBy("party", F.session_window("ts", "30 minutes").alias("s"))
             .agg(F.count(F.lit(1)).alias("n")))
    want = sorted((r["party"], r["s"]["start"].replace(tzinfo=None), r["s"]["end"].replace(
        tzinfo=None), r["n"]) for r in win.collect())
    assert [g[0] for g in got] == [1, 1, 1, 2, 3]
    assert [(a, c) for a, _, _, c in got] == [(a, c) for a, _, _, c in want]


def test_flag_duplicates(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 5), (1, 2)], "event_id long, ts long")
    got = sorted((r["event_id"], r["ts"], r["detected_duplicate"])
                 for r in ss.flag_duplicates(df).collect())
    assert got == [(1, 1, False), (1, 2, True), (1, 3, True), (2, 5, False)]


def test_stream_sessions_and_dedup(spark, tmp_path):
    import os
    import time

    import pandas as pd

    from shoplytics.streaming import runner
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base, 1), (1, base + dt.timedelta(minutes=10), 2),
            (1, base + dt.timedelta(minutes=10), 2),                 # duplicate event id
            (2, base + dt.timedelta(minutes=5), 3),
            (1, base + dt.timedelta(minutes=90), 4)]
    os.makedirs(str(tmp_path / "in"))
    p = str(tmp_path / "in" / "part-000.parquet")
    pd.DataFrame(rows, columns=["party", "ts", "event_id"]).to_parquet(
        p, coerce_timestamps="us", allow_truncated_timestamps=True)
    os.utime(p, (time.time() - 100, time.time() - 100))
    src = spark.readStream.schema("party long, ts timestamp_ntz, event_id long").parquet(
        str(tmp_path / "in"))
    deduped = ss.drop_duplicate_events(src)
    res = runner.run_to_table(deduped, lambda d: ss.stream_sessions(d, watermark=None),
                              ["party", "session_start"],
                              str(tmp_path / "out"), str(tmp_path / "ckpt"), mode="append")
    got = sorted((r["party"], r["n_events"]) for r in res.collect())
    # party 1: {0, 10 min} (the duplicate dropped) and party 2: {5 min} are
    # closed by the watermark (90 - 2 min); party 1's session at 90 min is
    # still open at the end of the input, so append mode does not emit it
    assert got == [(1, 2), (2, 1)]
