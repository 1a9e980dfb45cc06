"""The top-pick stream equals a plain sequential model of the consumer
(counter, refresh at 10, keep best half by draw, fill to 4 at random),
for any split of the events into micro-batches (ST6, ST11, T3-T6)."""

import datetime as dt
import json
import hashlib
import os
import time

import numpy as np
import pandas as pd

from shoplytics.functions import random as R
from shoplytics.operators import toppick as tp
from shoplytics.streaming import toppick as stp

SEED = 3
CATALOG = [str(i) for i in range(20)]


def _events(n=140, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(n):
        kind = "imp" if rng.random() < 0.6 else "click"
        out.append((e, e, str(rng.integers(0, 12)), kind == "click", kind == "imp"))
    return out


def _model(events, compat=False):
    perm = sorted(CATALOG, key=lambda i: (hashlib.md5(f"{SEED}|{i}".encode()).hexdigest(), i))

    def refresh(state, epoch):
        items = sorted(state)
        draws = sorted((-R.beta_py(SEED, f"{epoch}:{it}", state[it][0] + 1,
                                   max(state[it][1] - state[it][0], 0) + 1), it) for it in items)
        kept = [it for _, it in draws[:(1 if len(items) == 1 else len(items) // 2)]]
        n_random = max(tp.NUM_ITEMS - len(kept), 0)
        start = R.hash48_py(SEED, "fill", epoch) % len(perm)
        m = 2 * n_random if compat else n_random + len(kept)
        cands = [perm[(start + j) % len(perm)] for j in range(min(m, len(perm)))]
        fill = [c for c in cands if c not in kept][:n_random]
        return {it: [1, 1] for it in kept + fill}

    epoch, counter = 0, 1
    state = refresh({}, -1)                 # the consumer refreshes on start
    for _, _, item, is_click, is_imp in events:
        s = state.setdefault(item, [0, 0])
        if is_click:
            s[0] += 1
        if is_imp:
            s[1] += 1
            counter += 1
            if counter == tp.REFRESH_INTERVAL:
                state, counter, epoch = refresh(state, epoch), 1, epoch + 1
    return epoch, {k: tuple(v) for k, v in state.items()}


def _write(folder, chunks, first=0):
    os.makedirs(folder, exist_ok=True)
    t0 = time.time() - 1000 + first
    for i, rows in enumerate(chunks, start=first):
        pdf = pd.DataFrame(
            [(e, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), it, c, m)
             for e, s, it, c, m in rows],
            columns=["event_id", "ts", "item", "is_click", "is_imp"]).astype({"item": "string"})
        p = os.path.join(folder, f"part-{i:03d}.parquet")
        pdf.to_parquet(p, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(p, (t0 + i, t0 + i))


def test_stream_equals_sequential_model(spark, tmp_path):
    events = _events()
    catalog = spark.createDataFrame([(i,) for i in CATALOG], "id string")
    splits = ([events], [events[:37], events[37:90], events[90:]], [events])
    for n, chunks in enumerate(splits):
        compat = n == 2
        want = _model(events, compat)
        d = tmp_path / f"s{n}"
        _write(str(d / "in"), chunks)
        src = (spark.readStream.schema("event_id long, ts timestamp_ntz, item string, "
                                       "is_click boolean, is_imp boolean")
               .option("maxFilesPerTrigger", 1).parquet(str(d / "in")))
        h = stp.TopPickStream(str(d / "root"), catalog, SEED, compat=compat)
        stp.run(src, h, str(d / "ckpt"))
        st = stp.latest_state(spark, str(d / "root")).collect()
        got = ({r["epoch"] for r in st} or {None},
               {r["item"]: (r["clicks"], r["impressions"]) for r in st})
        assert got == ({want[0]}, want[1])


def _model_with_restart(events, cut, refresh_on_restart):
    """The consumer stopped after ``cut`` events and started again: the
    state survives (it lives outside the process) and a start refreshes."""
    perm = sorted(CATALOG, key=lambda i: (hashlib.md5(f"{SEED}|{i}".encode()).hexdigest(), i))

    def refresh(state, epoch):
        items = sorted(state)
        draws = sorted((-R.beta_py(SEED, f"{epoch}:{it}", state[it][0] + 1,
                                   max(state[it][1] - state[it][0], 0) + 1), it) for it in items)
        kept = [it for _, it in draws[:(1 if len(items) == 1 else len(items) // 2)]]
        start = R.hash48_py(SEED, "fill", epoch) % len(perm)
        cands = [perm[(start + j) % len(perm)] for j in range(tp.NUM_ITEMS)]
        fill = [c for c in cands if c not in kept][:max(tp.NUM_ITEMS - len(kept), 0)]
        return {it: [1, 1] for it in kept + fill}

    epoch, counter = 0, 1
    state = refresh({}, -1)
    for n, (_, _, item, is_click, is_imp) in enumerate(events):
        if n == cut and refresh_on_restart:
            state, counter, epoch = refresh(state, epoch), 1, epoch + 1
        s = state.setdefault(item, [0, 0])
        if is_click:
            s[0] += 1
        if is_imp:
            s[1] += 1
            counter += 1
            if counter == tp.REFRESH_INTERVAL:
                state, counter, epoch = refresh(state, epoch), 1, epoch + 1
    return epoch, {k: tuple(v) for k, v in state.items()}


def test_restart_resumes_state(spark, tmp_path):
    events = _events(90, seed=7)
    catalog = spark.createDataFrame([(i,) for i in CATALOG], "id string")
    schema = "event_id long, ts timestamp_ntz, item string, is_click boolean, is_imp boolean"
    for flag in (False, True):
        d = tmp_path / f"r{flag}"
        _write(str(d / "in"), [events[:40]])
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(d / "in"))
        stp.run(src, stp.TopPickStream(str(d / "root"), catalog, SEED), str(d / "ckpt"))
        # new events arrive while the process is down; a new process starts
        _write(str(d / "in"), [events[40:]], first=1)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(d / "in"))
        h = stp.TopPickStream(str(d / "root"), catalog, SEED, refresh_on_start=flag)
        stp.run(src, h, str(d / "ckpt"))
        st = stp.latest_state(spark, str(d / "root")).collect()
        got = ({r["epoch"] for r in st}, {r["item"]: (r["clicks"], r["impressions"]) for r in st})
        want = _model_with_restart(events, 40, flag)
        assert got == ({want[0]}, want[1])


def test_registered_stream_equals_model_on_event_table(spark):
    """``toppick_stream_state`` over the sf0.001 events equals the consumer
    model run over the same events in (ts, event_id) order."""
    import pyarrow.parquet as pq

    from shoplytics.plans import toppick as ptp
    from shoplytics.plans.registry import load_all
    from tests.conftest import SF001

    ev = pq.read_table(f"{SF001}/events.parquet").to_pandas().sort_values(["ts", "event_id"])
    ev = ev[ev["event_type"].isin(["click", "view"])]
    items = ev["props"].map(lambda s: None if s is None else str(json.loads(s).get("k")))
    events = [(e, 0, it, t == "click", t == "view")
              for e, t, it in zip(ev["event_id"], ev["event_type"], items) if it is not None]
    part = pq.read_table(f"{SF001}/part.parquet").to_pandas()
    global CATALOG, SEED
    saved = (CATALOG, SEED)
    CATALOG, SEED = [str(k) for k in part["p_partkey"]], ptp.SEED
    try:
        want = _model(events)
    finally:
        CATALOG, SEED = saved
    st = load_all()["toppick_stream_state"].run(spark, SF001).collect()
    got = ({r["epoch"] for r in st}, {r["item"]: (r["clicks"], r["impressions"]) for r in st})
    assert got == ({want[0]}, want[1])


def test_empty_stream_gives_no_rows(spark, tmp_path):
    from shoplytics.streaming import basket as sb
    from shoplytics.streaming import runner
    os.makedirs(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, item string, is_click boolean, is_imp boolean"
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    catalog = spark.createDataFrame([(i,) for i in CATALOG], "id string")
    stp.run(src, stp.TopPickStream(str(tmp_path / "root"), catalog, SEED), str(tmp_path / "c1"))
    assert stp.latest_state(spark, str(tmp_path / "root")).count() == 0
    src2 = spark.readStream.schema("shopper long, item string, ts timestamp_ntz, "
                                   "event_id long, action string").parquet(str(tmp_path / "in"))
    res = runner.run_to_table(src2, sb.basket_updates, ["shopper"], str(tmp_path / "out"),
                              str(tmp_path / "c2"))
    assert res.count() == 0 and "n_items" in res.columns


def _replay_events():
    """30 events: clicks before any impression, the 9th and 18th impressions
    (refresh boundaries) with a click just before and just after each, an
    item with more clicks than impressions, and an old id re-added after the
    first refresh."""
    seq = [("1", "c"), ("1", "c"), ("2", "i"), ("3", "i"), ("1", "i"), ("4", "i"),
           ("4", "c"), ("5", "i"), ("6", "i"), ("7", "i"), ("7", "c"), ("8", "i"),
           ("8", "c"),                      # click just before the 9th impression
           ("9", "i"),                      # 9th impression: refresh
           ("9", "c"), ("9", "c"), ("9", "c"),   # after it; item 9 has 3 clicks, 1 impression
           ("2", "i"),                      # an old id re-added after the refresh
           ("10", "i"), ("3", "i"), ("1", "i"), ("5", "i"), ("6", "c"), ("6", "i"),
           ("6", "c"), ("2", "i"), ("2", "i"),
           ("10", "c"),                     # click just before the 18th impression
           ("3", "i"),                      # 18th impression: refresh
           ("4", "c")]                      # click just after
    return [(n, n, it, k == "c", k == "i") for n, (it, k) in enumerate(seq)]


def test_literal_replay_equals_model(spark, tmp_path):
    events = _replay_events()
    assert len(events) == 30 and sum(e[4] for e in events) == 18
    catalog = spark.createDataFrame([(i,) for i in CATALOG], "id string")
    for n, chunks in enumerate(([events], [events[:12], events[12:26], events[26:]])):
        d = tmp_path / f"r{n}"
        _write(str(d / "in"), chunks)
        src = (spark.readStream.schema("event_id long, ts timestamp_ntz, item string, "
                                       "is_click boolean, is_imp boolean")
               .option("maxFilesPerTrigger", 1).parquet(str(d / "in")))
        stp.run(src, stp.TopPickStream(str(d / "root"), catalog, SEED), str(d / "ckpt"))
        st = stp.latest_state(spark, str(d / "root")).collect()
        got = ({r["epoch"] for r in st}, {r["item"]: (r["clicks"], r["impressions"]) for r in st})
        want = _model(events)
        assert want[0] == 2                      # two refreshes after the start
        assert got == ({want[0]}, want[1])
