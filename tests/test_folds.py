"""Streams that carry a table: late rows, flags and sessions over any split into runs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shoplytics.streaming import folds

T0 = dt.datetime(2024, 1, 1)


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    rows = [(0, "a", _at(10)), (0, "a", None), (1, "a", _at(700)), (2, "a", _at(20)),   # its window ended long before
            (2, "b", _at(570)),                       # window end 600 > 700 - 120
            (2, "b", _at(530)),                       # window end 540 <= 580: late
            (3, "b", _at(710))]
    df = _rows(spark, rows, "arrival int, event_type string, ts timestamp_ntz")
    base = str(tmp_path / "f")
    folds.replay(spark, df, "arrival", base, folds.late_step(), folds.LATE_STATE)
    late = {(r.event_type, r.ts) for r in folds.read(spark, base, "late").collect()}
    assert late == {("a", _at(20)), ("b", _at(530))}
    kept = folds.read(spark, base, "counts").agg(F.sum("count")).first()[0]
    assert kept == 4  # the row without a time has no window


def test_copies_across_runs_are_flagged_and_ids_forgotten(spark, tmp_path):
    day = 86400
    rows = [(0, 1, _at(0)), (0, 1, _at(5)), (0, 2, _at(0)), (0, None, _at(1)), (0, None, _at(1)),
            (1, 2, _at(day)),                          # remembered
            (2, 3, _at(20 * day)), (3, 1, _at(20 * day)),   # 1 and 2 are forgotten by now
            (3, 3, _at(20 * day + 1))]
    df = _rows(spark, [r + ("x", 0) for r in rows], "arrival int, event_id long, ts timestamp_ntz, props string, checksum long") \
        .withColumn("checksum", F.when(F.col("event_id") == 2, F.lit(7)).otherwise(F.crc32(F.col("props").cast("binary"))))
    base = str(tmp_path / "f")
    folds.replay(spark, df, "arrival", base, folds.duplicate_step(), folds.DUPLICATE_STATE)
    got = sorted((r.batch, r.event_id or 0, r.ts, r.detected_duplicate, r.detected_corruption)
                 for r in folds.read(spark, base, "flagged").collect())
    assert [(b, e, d) for b, e, _, d, _ in got] == [
        (0, 0, False), (0, 0, False), (0, 1, False), (0, 1, True), (0, 2, False),
        (1, 2, True), (2, 3, False), (3, 1, False), (3, 3, True)]
    assert {e for _, e, _, _, damaged in got if damaged} == {2}
    state = spark.read.parquet(f"{base}/state").filter("batch = 3")
    assert sorted(r.event_id for r in state.filter("event_id IS NOT NULL").collect()) == [1, 3]
    assert spark.read.parquet(f"{base}/state").select("batch").distinct().count() == 2


def _sessions(rows, timeout):
    out = []
    for party in {p for p, _ in rows}:
        times = sorted(t for p, t in rows if p == party)
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > timeout:
                out.append((party, _at(start), _at(last + timeout), n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((party, _at(start), _at(last + timeout), n))
    return sorted(out)


def test_sessions_over_any_split_equal_the_sessions_of_all_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(p, rng.randrange(0, 40_000)) for p in (1, 1, 1, 2, 3) for _ in range(30)]
    rows += [(4, 0), (4, 1800), (4, 3601)]  # a gap of the timeout joins, one second more does not
    for n, runs in enumerate((1, 4)):
        df = _rows(spark, [(rng.randrange(runs), p, _at(t)) for p, t in rows] + [(0, 9, None)],
                   "arrival int, party long, ts timestamp_ntz")
        base = str(tmp_path / f"f{n}")
        folds.replay(spark, df, "arrival", base, folds.session_step(), folds.SESSION_STATE)
        got = sorted((r.party, r.session_start.replace(tzinfo=None), r.session_end.replace(tzinfo=None), r.n_events)
                     for r in folds.all_sessions(spark, base).collect())
        assert got == _sessions(rows, 1800)


def test_closed_sessions_leave_the_carried_table(spark, tmp_path):
    df = _rows(spark, [(0, 1, _at(0)), (1, 1, _at(50_000)), (2, 1, _at(50_100))], "arrival int, party long, ts timestamp_ntz")
    base = str(tmp_path / "f")
    folds.replay(spark, df, "arrival", base, folds.session_step(delay_s=3600), folds.SESSION_STATE)
    assert folds.read(spark, base, "closed").count() == 1
    assert sorted(r.n_events for r in folds.all_sessions(spark, base).collect()) == [1, 2]
