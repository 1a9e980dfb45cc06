"""The stemmer against known pairs and a letter-by-letter version."""

import random
import re

from pyspark.sql import functions as F

from shoplytics.operators import search as se
from shoplytics.operators import stemming
from shoplytics.sources.tables import table
from tests import porter
from tests.conftest import SF001

# Pairs given with the published rules.
PAIRS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "running": "run", "generalizations": "gener", "oscillators": "oscil"}


def _stemmed(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    as_array = {r[0]: r[1] for r in df.select("w", F.get(stemming.stems(F.array("w")), F.lit(0))).collect()}
    assert as_array == {r[0]: r[1] for r in df.select("w", stemming.stem(F.col("w"))).collect()}
    return as_array


def test_published_pairs(spark):
    assert _stemmed(spark, PAIRS) == PAIRS
    assert {w: porter.stem(w) for w in PAIRS} == PAIRS


def test_equals_the_letter_by_letter_version(spark):
    r = random.Random(11)
    ends = [e for p in stemming.PASSES for e in p.endings] + ["", "yy", "y", "at", "bl", "iz", "ion", "sion"]
    words = {"", "a", "as", "ies", "ing", "yyy", "yying", "ayyyed", "sayyying", None}
    for _ in range(6000):
        head = "".join(r.choice("aeiouybcdlstwxz ñ1") for _ in range(r.randint(0, 6)))
        words.add(head + r.choice(ends) + r.choice(ends))
    assert _stemmed(spark, words) == {w: porter.stem(w) for w in words}


def test_bigrams_are_stemmed_at_their_end(spark):
    got = spark.range(1).select(se.analyze(F.lit("Running shoes, running SHOE ab"))).first()[0]
    assert sorted(got) == sorted({porter.stem(t) for t in ["running", "shoes", "shoe", "running shoes", "shoes running",
                                                           "running shoe", "shoe ab"]})
    assert "run" in got and "running sho" in got


def test_terms_of_the_given_texts(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["terms"] for r in docs.select("doc_id", se.analyze("text").alias("terms")).collect()}
    plain = {r["doc_id"]: r["t"] for r in docs.select("doc_id", se.tokens("text").alias("t")).collect()}
    for i, t in plain.items():
        if t is None:
            assert got[i] is None
            continue
        terms = [x for x in [*t, *[f"{a} {b}" for a, b in zip(t, t[1:])]] if len(x) >= 3]
        assert sorted(got[i]) == sorted({porter.stem(x) for x in terms}), i
        assert not any(re.search(r"ational$", x) and porter.measure(x[:-7]) > 0 for x in got[i])


def test_pairs_are_stemmed_behind_five_beginnings(monkeypatch):
    import pyarrow as pa
    r, asked = random.Random(3), []
    monkeypatch.setattr(stemming, "SLICE", 500)
    for table_, made in (("_WORDS", stemming.word_stem), ("_ENDINGS", stemming._ending)):
        monkeypatch.setattr(stemming, table_, stemming._Remembered(lambda x, made=made: asked.append(x) or made(x)))
    ends = [e for p in stemming.PASSES for e in p.endings]
    words = ["".join(r.choice("aeiouybcst1") for _ in range(r.randint(1, 4))) + r.choice(["", *ends]) for _ in range(60)]
    lists = [None, [], ["a"], *[[r.choice(words) for _ in range(r.randint(0, 300))] for _ in range(40)]]
    for pairs in (True, False):
        got = stemming._terms(3, pairs)(pa.array(lists, pa.list_(pa.string()))).to_pylist()
        for t, g in zip(lists, got):
            if t is None:
                assert g is None
                continue
            plain = [*t, *[f"{a} {b}" for a, b in zip(t, t[1:]) if pairs]]
            assert sorted(g) == sorted({porter.stem(x) for x in plain if len(x) >= 3})
    assert len(asked) <= 6 * len(set(words))  # about 3600 pairs of words
