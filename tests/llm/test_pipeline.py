"""The corpus pipeline: what each stage does to documents, and the entry's guard."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from shoplytics.llm import mixing, neardup, packing, pii, queries, toxicity
from tests.llm.frames import docs, rows

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    from tests.llm.test_pairs import brute_components
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]

    grammar = toxicity.fit(table, labels)
    one = by_name["toxicity"](spark, table, SF)
    assert one.columns == table.columns
    texts = {r.doc_id: r.text for r in table.collect()}
    left = {r.doc_id for r in one.collect()}
    assert left == {i for i, t in texts.items() if grammar.score(t) < toxicity.THRESHOLD}

    two = by_name["near_duplicates"](spark, one, SF)
    group, _ = brute_components([(i, texts[i]) for i in left], neardup.SHINGLE)
    stay = {r.doc_id for r in two.collect()}
    assert two.columns == table.columns and stay == set(group.values())

    three = by_name["pii"](spark, two, SF)
    assert three.columns == table.columns
    for r in three.collect():
        assert not pii.spans(r.text) and len(r.text) == r.n_chars
        if not pii.spans(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]

    four = by_name["mixing"](spark, three, SF)
    assert four.columns == table.columns and {r.doc_id for r in four.collect()} <= stay

    five = by_name["packing"](spark, four, SF)
    assert sum(r.words for r in five.collect()) == sum(len(r.text.encode().split()) for r in four.collect())


def _counts(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows(df))


def test_stages_by_row(spark):
    """Null, repeated and large ids, equal rows, empty texts and columns whose names clash."""
    made = [(None, f"null id number {i} " + "filler words here " * 6, f"s{i % 2}") for i in range(40)]
    made += [(7, "one thing said by seven", "s0"), (7, "quite another thing of the same id", "s2"), (2 ** 60 + 1, "large id text", "s2"),
             (5, None, None), (6, "", "s1"), (None, None, None), (8, "same row twice", "s2"), (8, "same row twice", "s2")]
    df = docs(spark, made, TEXT="x", Source=1, _k1=2, _copies=3, row=4)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0)
    clean = toxicity.clean(df, labels)
    assert _counts(clean) == Counter(made) and clean.columns == df.columns
    one = neardup.deduplicated(df)
    assert one.columns == df.columns and _counts(one) == Counter(dict.fromkeys(made, 1))
    private = pii.redacted(one)
    assert private.columns == df.columns and _counts(private) == _counts(one)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and set(_counts(mixed)) <= set(made)
    words = {s: [len((t or "").split()) for _, t, s2 in made if s2 == s] for s in {m[2] for m in made}}
    for r in rows(mixing.targets(mixing.sizes(df))):
        taken = sum(len((t or "").split()) * n for (_, t, s), n in _counts(mixed).items() if s == r["source"])
        assert abs(taken - r["target"]) <= max(words[r["source"]]), (r, taken)
    assert max(n for (_, t, _), n in _counts(mixed).items() if t and t != "same row twice") <= mixing.MAX_REPEAT
    packed = rows(packing.pack(df, 50))
    assert sum(r["words"] for r in packed) == sum(map(sum, words.values()))
    assert {r["doc_id"] for r in packed} == {m[0] for m in made}


def test_stages_of_an_empty_table(spark):
    df, labels = docs(spark, [], TEXT="x"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for out in (toxicity.clean(df, labels), neardup.deduplicated(df), pii.redacted(df), mixing.mixed_documents(df)):
        assert out.columns == df.columns and out.count() == 0
    assert packing.pack(df).count() == 0


def test_run_is_the_stages_in_order(spark):
    got = queries.QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"bin", "doc_id", "words"} <= set(got.columns)


def test_one_query_per_operator():
    named = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in named) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES


def test_entry_without_this_folder(tmp_path):
    """The entry and the other queries load when the folder and the pipeline are gone."""
    for name in ("__spark_entry__.py", "shoplytics"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = ("import sys; sys.modules['shoplytics.llm'] = None; import __spark_entry__ as e; "
            "q = e.queries(); assert 'events_per_minute' in q and 'pipeline' not in q; e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
