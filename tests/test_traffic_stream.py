"""Streaming traffic job: the reference's two stream tests and late data."""

import datetime as dt
import os
import time

import pandas as pd
from pyspark.sql import functions as F

from shoplytics.operators import traffic
from shoplytics.sources import archive
from shoplytics.sources.schemas import TIMED_EVENT
from shoplytics.streaming import runner


def _write_batches(spark, folder, batches):
    """One parquet file per micro-batch, with increasing modification times."""
    os.makedirs(folder, exist_ok=True)
    t0 = time.time() - 1000
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"part-{i:03d}.parquet")
        pd.DataFrame(rows, columns=["eventType", "timestamp"]).astype(
            {"timestamp": "int64"}).to_parquet(path)
        os.utime(path, (t0 + i, t0 + i))


def _run(spark, tmp_path, batches, job, keys):
    src_dir = str(tmp_path / "in")
    _write_batches(spark, src_dir, batches)
    src = archive.stream_archive(spark, src_dir, TIMED_EVENT, max_files_per_trigger=1)
    return runner.run_to_table(src, job, keys, str(tmp_path / "out"), str(tmp_path / "ckpt"))


def test_identity_stream(spark, tmp_path):
    batches = [[("preview", 1500000)], [("pageView", 1500000)], [("preview", 1500000)]]
    src_dir = str(tmp_path / "in")
    _write_batches(spark, src_dir, batches)
    src = archive.stream_archive(spark, src_dir, TIMED_EVENT, max_files_per_trigger=1)
    q = runner.start(src, traffic.all_events, fmt="memory", mode="update",
                     checkpoint=str(tmp_path / "ckpt"), query_name="identity_out",
                     available_now=True)
    q.awaitTermination()
    rows = sorted(tuple(r) for r in spark.table("identity_out").collect())
    assert rows == sorted([("preview", 1500000), ("pageView", 1500000), ("preview", 1500000)])


def test_events_per_minute_stream(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    batches = [[("preview", 1538143025000)], [("preview", 1538143027000)],
               [("pageView", 1538143025000)]]
    res = _run(spark, tmp_path, batches, traffic.events_per_minute,
               ["window_start", "eventType"])
    got = {(r.eventType, r.window_start, r.window_end, r["count"]) for r in res.collect()}
    # 15:57 at UTC+2 in the reference test is 13:57 UTC.
    start, end = dt.datetime(2018, 9, 28, 13, 57), dt.datetime(2018, 9, 28, 13, 58)
    assert got == {("preview", start, end, 2), ("pageView", start, end, 1)}


def test_late_row_dropped_after_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = 1538143025000
    batches = [
        [("preview", base)],                    # on time
        [("preview", base + 10 * 60_000)],      # far ahead: watermark moves to +8 min
        [("preview", base + 10 * 60_000 + 1)],  # filler: the watermark is now in force
        [("preview", base + 1)],                # late: window ended before the watermark
    ]
    res = _run(spark, tmp_path, batches, traffic.events_per_minute,
               ["window_start", "eventType"])
    counts = {r.window_start: r["count"] for r in res.collect()}
    assert counts[dt.datetime(2018, 9, 28, 13, 57)] == 1     # late row not counted
    assert counts[dt.datetime(2018, 9, 28, 14, 7)] == 2


def test_stream_equals_batch_on_events(spark):
    from tests.conftest import SF001
    from shoplytics.plans.registry import load_all
    reg = load_all()
    a = reg["events_per_minute"].run(spark, SF001)
    b = reg["events_per_minute_stream"].run(spark, SF001)
    assert a.count() == b.count()
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_reference_window_string_in_amsterdam(spark, tmp_path):
    """The reference test expects ``2018-09-28 15:57:00`` for 1538143025000:
    that is the window start rendered in a UTC+2 zone."""
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
        res = _run(spark, tmp_path, [[("preview", 1538143025000)]], traffic.events_per_minute,
                   ["window_start", "eventType"])
        r = res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("s"),
                       F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("e"),
                       "eventType", "count").first()
        assert tuple(r) == ("2018-09-28 15:57:00", "2018-09-28 15:58:00", "preview", 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["preview", "pageView", "impression"]),
                          st.integers(min_value=0, max_value=90_000)),
                min_size=1, max_size=25),
       st.lists(st.integers(min_value=1, max_value=24), max_size=3))
def test_stream_equals_batch_for_any_split(spark, tmp_path_factory, steps, cuts):
    """Events in time order, split into micro-batches anywhere: the watermarked
    stream counts what the batch job counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    t, events = 1538143025000, []
    for etype, gap in steps:
        t += gap
        events.append((etype, t))
    bounds = sorted({c for c in cuts if c < len(events)})
    chunks = [events[a:b] for a, b in zip([0] + bounds, bounds + [len(events)])]
    tmp = tmp_path_factory.mktemp("split")
    res = _run(spark, tmp, chunks, traffic.events_per_minute, ["window_start", "eventType"])
    got = sorted((r.eventType, r.window_start, r["count"]) for r in res.collect())
    batch = traffic.events_per_minute(spark.createDataFrame(events, TIMED_EVENT))
    want = sorted((r.eventType, r.window_start, r["count"]) for r in batch.collect())
    assert got == want


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    """One file or a folder of files: the stream sees the same events."""
    from shoplytics.streaming import traffic as st
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    key = ["window_start", "event_type"]
    one, many = (sorted(map(tuple, st.events_per_minute_stream(spark, d).select(*key, "count").collect()))
                 for d in (sf, str(tmp_path)))
    assert one == many and sum(r[2] for r in one) == spark.read.parquet(f"{sf}/events.parquet").count()
