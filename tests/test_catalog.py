"""Catalog build on literal records."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplytics.operators import catalog as cat

SIZE_T = "array<struct<label:string,width:string,height:string,source:string,url:string>>"


def test_tags_normalisation(spark):
    df = spark.createDataFrame([(["a", None, "b"],), ([None, "x"],), (None,)], "tags array<string>")
    got = [r[0] for r in df.select(cat.normalize_tags(F.col("tags"))).collect()]
    assert got == [["a", "b"], ["x"], None]
    compat = [r[0] for r in df.select(cat.normalize_tags(F.col("tags"), compat=True)).collect()]
    # a missing tag list becomes [None] upstream, then []
    assert compat == [["a", None, "b"], [], []]


def test_sizes_last_label_wins(spark):
    df = spark.createDataFrame(
        [([("Small", "10", "5", "s1", "u1"), ("Medium", "20", "10", "s2", "u2"),
           ("Small", "12", "6", "s3", "u3")],)], f"sizes {SIZE_T}")
    m = df.select(cat.sizes_to_map(F.col("sizes")).alias("m")).first()["m"]
    assert set(m) == {"Small", "Medium"} and m["Small"]["width"] == "12"


def _items(spark):
    return spark.createDataFrame(
        [("123456", "t", ["a"], 30, ("u1", "user", ""),
          {"Small": (10, 20, "f", "i"), "Medium": (40, 5, "f2", "i2")}),
         ("12", "t2", [], 40, ("u2", "user2", "Real"), {})],
        "id string, title string, categories array<string>, favs int, "
        "owner struct<user_id:string,user_name:string,real_name:string>, "
        "variants map<string,struct<width:int,height:int,flickr_url:string,img_source:string>>")


def test_display_projections(spark):
    r = _items(spark).select(
        "id", cat.display_owner().alias("who"), cat.largest_variant().alias("big"),
        cat.variant("Medium").alias("med"), cat.variant("Original").alias("orig")).collect()
    by = {x["id"]: x for x in r}
    assert by["123456"]["who"] == "user" and by["12"]["who"] == "Real"
    assert tuple(by["123456"]["big"]) == (40, 5)
    assert by["123456"]["med"]["width"] == 40 and by["123456"]["orig"] is None


def test_variants_roundtrip_and_duplicates(spark):
    items = _items(spark)
    back = items.select("id", cat.variants_to_array().alias("arr"))
    arr = back.withColumnRenamed("arr", "variants").select("id", cat.array_to_variants().alias("v"))
    got = {r["id"]: r["v"] for r in arr.collect()}
    assert got["123456"]["Small"]["width"] == 10 and got["12"] == {}
    dup = spark.createDataFrame([([("A", 1, 1, "f", "i"), ("A", 2, 2, "f", "i")],)],
                                "variants array<struct<name:string,width:int,height:int,"
                                "flickr_url:string,img_source:string>>")
    with pytest.raises(Exception):
        dup.select(cat.array_to_variants()).collect()


def test_validation(spark):
    v = {r["id"]: (r["status"], r["reasons"]) for r in cat.validate(_items(spark)).collect()}
    assert v["123456"] == (200, [])
    assert v["12"] == (422, ["id_pattern", "categories_empty"])
    strict = {r["id"]: r["reasons"] for r in
              cat.validate(_items(spark), strict_nested=True).collect()}
    assert "variants_empty" in strict["12"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=500), min_size=1, max_size=30))
def test_price_is_one_or_two(spark, favs):
    df = spark.createDataFrame([(str(i), f) for i, f in enumerate(favs)], "id string, favs int")
    prices = {r["price"] for r in cat.with_price(df).collect()}
    assert prices <= {1, 2}
    if len(set(favs)) == 1:
        assert prices == {1}


def test_merge_newest_wins_and_idempotent(spark):
    df = spark.createDataFrame(
        [("1", "old", ["b"], 0), ("1", "new", ["a"], 1), ("2", "only", ["c"], 0)],
        "id string, title string, categories array<string>, ord int")
    m = cat.merge_items(df)
    got = {r["id"]: (r["title"], r["categories"]) for r in m.collect()}
    assert got == {"1": ("new", ["a", "b"]), "2": ("only", ["c"])}
    again = cat.merge_items(m.withColumn("ord", F.lit(0)))
    assert sorted(again.collect()) == sorted(m.collect())


def test_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([("1", "a", 0), ("2", "b", 0)], "id string, title string, ord int")
    upd = spark.createDataFrame([("1", "A", 1), ("3", "c", 1)], "id string, title string, ord int")
    got = {r["id"]: r["title"] for r in cat.upsert(cur, upd).collect()}
    assert got == {"1": "A", "2": "b", "3": "c"}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "3"]), st.sampled_from(["a", "b", "c"]),
                          st.sampled_from(["x", "y"]), st.integers(min_value=0, max_value=5)),
                min_size=1, max_size=12, unique_by=lambda t: (t[0], t[3])))
def test_merge_is_idempotent_and_keeps_newest(spark, rows):
    df = spark.createDataFrame([(i, t, [c], o) for i, t, c, o in rows],
                               "id string, title string, categories array<string>, ord int")
    once = cat.merge_items(df)
    twice = cat.merge_items(once.withColumn("ord", F.lit(0)))
    assert sorted(once.collect()) == sorted(twice.collect())
    got = {r["id"]: (r["title"], r["categories"]) for r in once.collect()}
    for i in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == i]
        newest = max(mine, key=lambda r: r[3])
        assert got[i] == (newest[1], sorted({r[2] for r in mine}))


def test_with_info_left_join(spark):
    photos = spark.createDataFrame([("1", 40), ("2", 35)], "id string, favs int")
    info = spark.createDataFrame([("1", "desc", ["t"])], "id string, description string, "
                                                          "tags array<string>")
    got = {r["id"]: (r["d"], r["t"]) for r in cat.with_info(photos, info).select(
        "id", F.col("info.description").alias("d"), F.col("info.tags").alias("t")).collect()}
    assert got == {"1": ("desc", ["t"]), "2": (None, None)}


def test_harvest_threshold_first_page_and_repeats(spark):
    favs = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [("c",)] * 29, "photo string")
    counts = {r["id"]: r["favs"] for r in cat.favourite_counts(favs, "photo").collect()}
    assert counts == {"a": 60, "b": 30, "c": 29}
    paged = {r["id"]: r["favs"] for r in cat.favourite_counts(favs, "photo", page=50).collect()}
    assert paged == {"a": 50, "b": 30, "c": 29}              # as one page of 50 shows them
    photos = spark.createDataFrame([("a", "cars", 1), ("b", "cars", 2), ("c", "cars", 3),
                                    ("a", "cars", 4), ("d", "cars", 5)],
                                   "id string, category string, arrival int")
    kept = cat.harvest(photos, cat.favourite_counts(favs, "photo"), threshold=30, max_images=2)
    assert sorted((r["id"], r["arrival"]) for r in kept.collect()) == [("a", 1), ("b", 2)]
    every = cat.harvest(photos, cat.favourite_counts(favs, "photo"), threshold=30)
    assert sorted(r["arrival"] for r in every.collect()) == [1, 2, 4]   # a twice, c below, d none


def test_invalid_items(spark):
    df = spark.createDataFrame(
        [("12a456", ["x"], ("u", "n", ""), {"S": (0, 5, "f", "i")}),
         ("1234567", ["x"], ("u", "n", ""), {"S": (10, 5, "f", "i")})],
        "id string, categories array<string>, "
        "owner struct<user_id:string,user_name:string,real_name:string>, "
        "variants map<string,struct<width:int,height:int,flickr_url:string,img_source:string>>")
    v = {r["id"]: (r["status"], r["reasons"]) for r in cat.validate(df, strict_nested=True).collect()}
    assert v["12a456"] == (422, ["id_pattern", "variant_size"])
    assert v["1234567"] == (200, [])
    lax = {r["id"]: r["status"] for r in cat.validate(df).collect()}
    assert lax["12a456"] == 422 and lax["1234567"] == 200


def test_merge_and_upsert_ties_do_not_depend_on_row_order(spark):
    schema = "id string, title string, categories array<string>, ord int"
    data = [("1", "a", ["x"], 0), ("1", "b", ["y"], 0), ("2", "c", ["x"], 0), ("2", "c", ["z"], 1)]
    seen = set()
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, schema)
        merged = sorted((r.id, r.title, tuple(r.categories)) for r in cat.merge_items(df).collect())
        latest = sorted((r.id, r.title) for r in cat.upsert(df.limit(0), df).collect())
        seen.add((tuple(merged), tuple(latest)))
    assert len(seen) == 1


def test_keyword_results_are_chained_by_keyword(spark):
    from shoplytics.sources.harvest import category_config
    config = category_config(spark, """
categories:
  - a:
      keywords: [Red Ring, ring, "!"]
  - b:
      keywords: [big red ring]
  - c:
""")
    photos = spark.createDataFrame(
        [("1", "a RED, ring", None), ("2", "earring", "the ring; ring"), ("3", "big red", "ring"), ("4", None, None)],
        "id string, title string, description string")
    got = sorted((r.category, r.keyword_pos, r.id) for r in cat.keyword_results(photos, config).collect())
    # A photo comes once a keyword; words of two fields don't make a phrase.
    assert got == [("a", 0, "1"), ("a", 1, "1"), ("a", 1, "2"), ("a", 1, "3")]
    none = cat.keyword_results(photos, category_config(spark, "categories: []"))
    assert none.count() == 0 and set(none.columns) >= {"category", "keyword", "id"}
