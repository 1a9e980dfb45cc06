"""bench.py prints exactly one JSON line with the agreed keys."""

import json
import os
import subprocess
import sys

from tests.conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line(tmp_path):
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2", SPARK_DRIVER_MEMORY="2g",
               BENCH_QUERIES="events_per_minute,basket_contents")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], cwd=str(tmp_path),
                         env=env, capture_output=True, text=True, timeout=600)
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert set(d) == {"metric", "value", "unit", "queries", "sf"}
    assert d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"events_per_minute", "basket_contents"}
