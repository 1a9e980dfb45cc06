"""The stored catalog: merges equal one upsert of all rows and touch only their folders."""

import glob
import random

from shoplytics.operators import catalog as cat
from shoplytics.sources import store

SCHEMA = "id string, title string, ord int"


def _rows(df):
    return sorted((r.id or "", r.title or "", r.ord) for r in df.collect())


def _files(base):
    return set(glob.glob(f"{base}/data/**/*.parquet", recursive=True))


def test_merges_equal_one_upsert(spark, tmp_path):
    rng = random.Random(3)
    base = str(tmp_path / "s")
    batches = [[(str(rng.randrange(40)), f"t{rng.randrange(9)}", rng.randrange(6)) for _ in range(30)] for _ in range(3)]
    batches[1].append((None, "no id", 1))
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    store.create(frames[0], base, folders=8)
    for k, f in enumerate(frames[1:], 1):
        store.merge(f, base, k)
    store.merge(frames[2], base, 2)  # a replay of the last one
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert _rows(store.read(spark, base)) == _rows(cat.upsert(every.limit(0), every))


def test_untouched_files_keep_their_names(spark, tmp_path):
    base = str(tmp_path / "s")
    store.create(spark.createDataFrame([(str(i), "a", 0) for i in range(200)], SCHEMA), base, folders=16)
    before = _files(base)
    held = store._versions(spark, base)
    store.merge(spark.createDataFrame([("7", "b", 1)], SCHEMA), base, 1)
    after = store._versions(spark, base)
    assert before <= _files(base) and sum(held[f] != after[f] for f in held) == 1
    assert dict((r.id, r.title) for r in store.read(spark, base).collect()) == {str(i): "b" if i == 7 else "a" for i in range(200)}


def test_a_merge_that_failed_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "s")
    store.create(spark.createDataFrame([("1", "a", 0), ("2", "a", 0)], SCHEMA), base, folders=2)
    update = spark.createDataFrame([("1", "b", 1), ("3", "b", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: None)
        store.merge(update, base, 1)
    assert _rows(store.read(spark, base)) == [("1", "a", 0), ("2", "a", 0)]
    store.merge(update, base, 1)
    assert _rows(store.read(spark, base)) == [("1", "b", 1), ("2", "a", 0), ("3", "b", 1)]


def test_empty_store_and_empty_update(spark, tmp_path):
    base = str(tmp_path / "s")
    none = spark.createDataFrame([], SCHEMA)
    store.create(none, base, folders=4)
    assert store.read(spark, base, SCHEMA).count() == 0
    store.merge(none, base, 1)
    assert store.read(spark, base, SCHEMA).count() == 0
    store.merge(spark.createDataFrame([("1", "a", 0)], SCHEMA), base, 2)
    assert _rows(store.read(spark, base)) == [("1", "a", 0)]
