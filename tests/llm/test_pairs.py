"""Near-duplicates, nearest neighbours and packing against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplytics.llm import neardup, neighbours, packing
from shoplytics.llm.common import pick
from shoplytics.llm.components import components
from tests.llm.frames import docs, rows, wider

SF = "/root/testdata/sf0.01"


def brute_components(data, size):
    """{doc_id: component} from all pairs of shingle sets; data: (doc_id, text)."""
    import re
    sets = {}
    for i, t in data:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = frozenset(tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
        sets.setdefault(i, set()).add(s)
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i in ids:
        for s in sets[i]:
            for x in s:
                by.setdefault(x, set()).add(i)
    for i in ids:
        others = {o for s in sets[i] for x in s for o in by[x] if o > i}
        for o in others:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[o]):
                a, b = sorted((root(i), root(o)))
                up[b] = a
    return {i: root(i) for i in ids}, {(i, len(s)) for i in sets for s in sets[i]}


def check_neardup(df, size):
    """Against all pairs; rows without an id are documents of their own, which name no group."""
    nameless = 10 ** 15
    data = [(r.doc_id if r.doc_id is not None else nameless + i, r.text)
            for i, r in enumerate(pick(df, "doc_id", "text").collect())]
    want, sizes = brute_components(data, size)
    got = rows(neardup.near_duplicates(df, size))
    assert len(got) == df.count()
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == {(i if i < nameless else None, n) for i, n in sizes}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, c in want.items() if i < nameless}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    named = sorted(c if c < nameless else -1 for i, c in want.items() if i >= nameless)
    assert sorted(-1 if r["component_id"] is None else r["component_id"] for r in got if r["doc_id"] is None) == named
    # Of a group without any id, one row stays.
    assert sum(r["kept"] for r in got if r["doc_id"] is None) == len({c for c in want.values() if c >= nameless})
    return got


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_of_the_table(spark, size):
    check_neardup(spark.read.parquet(f"{SF}/documents.parquet"), size)


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_in_dense_regions(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    chain = [f"c{i}" for i in range(400)]
    made = [(i * 3, edited(base, rng.choice([0, 1, 3, 5, 9]), rng)) for i in range(150)]
    made += [(1000 + i, " ".join(chain[i * 8:i * 8 + 120])) for i in range(35)]  # each like the next only
    shared = " ".join(f"s{i}" for i in range(60))
    made += [(2000 + i, shared + " " + " ".join(f"u{i}x{j}" for j in range(rng.choice([5, 40, 60])))) for i in range(120)]
    check_neardup(docs(spark, made), 4)


def test_near_duplicates_in_a_region_of_many_blocks(spark, monkeypatch):
    """Texts that share the first four values only: a region of any size is compared whole."""
    monkeypatch.setattr(neardup, "REGION", 4, raising=False)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(20)]
    texts += [t.rsplit(" ", 3)[0] for t in texts]
    sigs = rng.integers(1, 2**32, (len(texts), neardup.VALUES), dtype=np.uint32)
    sigs[:, :neardup.BASE] = 0
    reps = spark.createDataFrame([(i, bytearray(s.tobytes()), 1) for i, s in enumerate(sigs)], "rep long, sig binary, n_shingles long")
    alone = spark.createDataFrame([], "node long, component long")
    df = docs(spark, list(enumerate(texts)))
    named = df.select("doc_id", *neardup._text_keys("text"))
    reps = reps.join(named, reps.rep == named.doc_id).withColumn("first", F.struct("doc_id", "t1", "t2"))
    got = neardup._across(reps, alone, df, 1)
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, i + 20) for i in range(20)]


def test_near_duplicates_cases(spark):
    made = [(5, "one two"), (4, "One  TWO\n"), (6, None), (7, ""), (8, " \t"), (None, "one two"), (9, "ÉTÉ a b c d"), (10, "été a b c d"),
            (3, "x " * 50_000), (2, "x " * 50_000), (11, "p q r s t u"), (11, "one two"), (11, None), (5, "one two")]
    got = check_neardup(docs(spark, made, rep=1, sig="s", component_id=3, DOC_ID=4), 4)
    assert {r["doc_id"]: r["component_id"] for r in got}[11] == 4
    assert rows(neardup.near_duplicates(docs(spark, []))) == []
    assert rows(neardup.near_duplicates(docs(spark, [(1, None)]))) == [{"doc_id": 1, "n_shingles": 0, "component_id": 1, "kept": True}]


def test_deduplicated_keeps_one_of_each_group(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    df = docs(spark, [(i, edited(base, 2, rng)) for i in range(20, 0, -1)] + [(99, "alone here it is"), (99, "alone here it is"), (None, "kept")], rep=1, TEXT="x")
    got = neardup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 99, None]


def test_deduplicated_decides_by_row(spark):
    words = [f"w{i}" for i in range(40)]
    x, y, z = " ".join(words), " ".join(words[::-1]), " ".join(f"v{i}" for i in range(40))
    near = " ".join(words[:-1] + ["other"])
    made = [(1, x), (1, y), (2, near), (None, x), (None, z), (None, z), (None, "alone"), (7, z + " z"), (3, None), (3, None), (None, ""),
            (2 ** 60 + 1, y), (9, "once"), (9, "once")]
    got = sorted(((r.doc_id, r.text) for r in neardup.deduplicated(docs(spark, made, TEXT=1, _T1=2)).collect()), key=str)
    assert got == sorted([(1, x), (1, y), (7, z + " z"), (None, "alone"), (3, None), (3, None), (None, ""), (9, "once")], key=str)
    # Rows that differ in another column alone: one of them, always the same.
    twice = docs(spark, [(4, x, "b"), (4, x, "a")])
    assert len({r.source for _ in range(3) for r in neardup.deduplicated(twice.repartition(2)).collect()}) == 1
    assert neardup.deduplicated(docs(spark, [])).count() == 0


def test_groups_without_ids_have_one_row_that_stays(spark):
    words = " ".join(f"w{i}" for i in range(30))
    made = [(None, words)] * 5 + [(None, words + " more")] * 2 + [(8, "only"), (None, "only"), (None, None), (None, None)]
    check_neardup(docs(spark, made).repartition(3), 5)


def test_components_of_long_chains(spark):
    ids = list(range(600))
    random.Random(1).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(5000, 5001), (7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in ids}, 5000: 5000, 5001: 5000}


# --- nearest neighbours

VEC = "vec_id long, embedding array<float>"


def brute_nearest(data, queries, k):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in data
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted(i for i in good if queries(i)):
        all_ = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q and len(good[i]) == len(good[q]))
        out[q] = all_[:k]
    return out


def test_neighbours_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in rows(neighbours.search(table, F.col("vec_id") % 100 == 0)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], lambda i: i % 100 == 0, 10)
    assert got.keys() == want.keys()
    hits = [len({v for _, v, _ in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert sum(hits) / len(hits) >= 0.9
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for *_, s in found] == sorted(s for *_, s in found)


def test_neighbours_in_clusters_look_at_few():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((200, 32)) * 10
    x = (centres[np.arange(4000) % 200] + rng.standard_normal((4000, 32)) * 0.05)
    forest, seen = neighbours.Forest(x), 0
    for i, (at, far) in enumerate(forest.search(x[:50], neighbours.hashes(x[:50]), np.arange(50), 10)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert len(set(np.argsort(d)[:10]) & set(at)) >= 8


def test_neighbours_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (200, [0.0, 0.0]), (9, [1.0, 0.1, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.1]), (10, [5.0, 5.0])]
    df = wider(spark.createDataFrame(data, VEC), rank=1, x="q", VEC_ID=3)
    got = rows(neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank"))
    want = brute_nearest(data, lambda i: i % 100 == 0, 10)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(q, j + 1, i) for q in want for j, (_, i) in enumerate(want[q])]
    assert [r["score"] for r in got] == pytest.approx([d for q in want for d, _ in want[q]])
    assert rows(neighbours.search(spark.createDataFrame([], VEC), F.col("vec_id") % 100 == 0)) == []


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.standard_normal(8) * (i % 5 + 1)]) for i in range(400)]
    got = {}
    for r in rows(neighbours.search(spark.createDataFrame(data, VEC), F.col("vec_id") % 20 == 0)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(data, lambda i: i % 20 == 0, 10)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


# --- packing

def check_pack(df, capacity, **how):
    import re
    got = rows(packing.pack(df, capacity, **how))
    want = {}
    for r in pick(df, "doc_id", "text").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for p in range(max(1, -(-n // capacity))):
            key = (r.doc_id, p, p * capacity, min(capacity, n - p * capacity))
            want[key] = want.get(key, 0) + 1
    have = {}
    bins = {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["word_start"], r["words"])
        have[key] = have.get(key, 0) + 1
        bins.setdefault(r["bin"], []).append(r)
    assert have == want
    for b in bins.values():
        assert sum(r["words"] for r in b) <= capacity
        assert len({r["source"] for r in b}) == len(b)
        assert sorted(r["position"] for r in b) == list(range(len(b)))
    return bins


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fit = [(left, len(out), b) for b, (left, ss, cc) in enumerate(bins) if left >= n and s not in ss and c not in cc]
        if fit:
            best = min(f[0] for f in fit)
            out.append(best - n)
            b = next(f[2] for f in fit if f[0] == best)
        else:
            out.append(capacity - n)
            bins.append([capacity, set(), set()])
            b = len(bins) - 1
        bins[b][0] -= n
        bins[b][1].add(s)
        bins[b][2].add(c)
    return out, len(bins)


def test_best_fit_takes_the_tightest_compatible_bin():
    import pandas as pd
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randint(1, 300)
        sizes = sorted((rng.randint(0, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot"] * 5 + [f"s{i}" for i in range(90)] + [None]) for _ in range(n)]
        clusters = [rng.randrange(max(1, n // 2)) for _ in range(n)]
        got = packing.best_fit(np.array(sizes), pd.Series(sources, dtype=object), pd.Series(clusters), 100)
        left, residuals = {}, []
        seen = set()
        for b, s, src, c in zip(got, sizes, sources, clusters):
            left[b] = left.get(b, 100) - s
            residuals.append(left[b])
            assert (b, "s", src) not in seen and (b, "c", c) not in seen and left[b] >= 0
            seen |= {(b, "s", src), (b, "c", c)}
        # Ties between equal residuals may go either way and change later choices: without ties, equal to plain.
        if len(set(sizes)) == n:
            assert residuals == plain_best_fit(sizes, sources, clusters, 100)[0]


def test_best_fit_against_plain_without_ties():
    import pandas as pd
    rng = random.Random(18)
    for _ in range(20):
        sizes = sorted(rng.sample(range(1, 10**6), 200), reverse=True)
        sources, clusters = [rng.choice("hhhabcde") for _ in sizes], [rng.randrange(80) for _ in sizes]
        got = packing.best_fit(np.array(sizes), pd.Series(sources), pd.Series(clusters), 10**6)
        left, residuals = {}, []
        for b, s in zip(got, sizes):
            left[b] = left.get(b, 10**6) - s
            residuals.append(left[b])
        assert (residuals, len(left)) == plain_best_fit(sizes, sources, clusters, 10**6)


def test_pack_clusters_are_equal_but_for_case_and_white_space(spark):
    made = [(i, t, f"s{i}") for i, t in enumerate(["one two", " one two", "one two\n", "\tOne  TWO\r\n", "\n one\ttwo \n"])]
    assert len({r.cluster for r in packing.items(docs(spark, made)).collect()}) == 1
    assert len(check_pack(docs(spark, made), 100)) == len(made)


def test_pack_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    bins = check_pack(table, 512)
    assert len(check_pack(table, 512, part_rows=100)) >= len(bins)


def test_pack_cases(spark):
    made = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "A  b\nc", "t"), (3, None, "u"), (4, "", None), (None, "x y", None), (5, "w " * 10_000, "s"), (6, "w " * 64, "v")]
    bins = check_pack(docs(spark, made, bin="x", words=1, Cluster=2), 64)
    for b in bins.values():  # equal texts never meet
        assert len({r["doc_id"] for r in b} & {1, 2}) < 2
    assert rows(packing.pack(docs(spark, []))) == []
    assert sum(r.words for r in packing.sequences(docs(spark, made), 64).collect()) == 3 * 3 + 2 + 10_000 + 64


def test_pack_keeps_large_ids_beside_null_ones(spark):
    made = [(2 ** 60 + 1, "a b c", "s"), (None, "d e", "t"), (2 ** 53 + 1, "f g h i", "u"), (-(2 ** 62) - 1, "", None)]
    assert sorted((r["doc_id"] for r in rows(packing.pack(docs(spark, made)))), key=str) == sorted([i for i, *_ in made], key=str)


def test_packing_does_not_depend_on_the_file_split(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    table = table.unionByName(table.limit(30))

    def bins(df):
        held = {}
        for r in rows(packing.pack(df, 512, part_rows=100)):
            held.setdefault(r["bin"], []).append((r["doc_id"], r["piece"], r["word_start"], r["words"]))
        return sorted(sorted(b) for b in held.values())

    assert bins(table.coalesce(1)) == bins(table.repartition(7))
