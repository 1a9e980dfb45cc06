"""Registered catalog queries (J3-J5, J7, A3-A7, A10, F4, F8, F9, W3,
M16-M19, M21, M22, S10, S11, S13, S14, U1-U3, C6, C8, C10, C12, C13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.operators import catalog as cat
from shoplytics.plans.registry import register
from shoplytics.sources import bindings

HARVEST_SQL = f"""
photos AS (
  SELECT {bindings.photo_id_sql('p_partkey')} AS id, p_name AS title, lower(p_type) AS category,
         NULL::VARCHAR AS description, [p_brand] AS tags, 0 AS ord, p_partkey AS arrival
  FROM part
  UNION ALL
  SELECT {bindings.photo_id_sql('d.doc_id')}, p.p_name, d.lang, d.text, [d.source], 1, d.doc_id
  FROM documents d JOIN part p ON p.p_partkey = d.doc_id
),
favs AS (SELECT {bindings.photo_id_sql('l_partkey')} AS id, count(*) AS favs
         FROM lineitem GROUP BY 1),
harvested AS (SELECT ph.*, coalesce(f.favs, 0)::INTEGER AS favs
        FROM photos ph LEFT JOIN favs f USING (id)
        WHERE coalesce(f.favs, 0) >= {cat.FAV_THRESHOLD}),
rng AS (SELECT min(favs) AS mn, max(favs) AS mx FROM harvested),
priced AS (SELECT h.*, CAST(trunc((favs - mn) / ((mx - mn + 1) / 2.0)) AS INTEGER) + 1 AS price
           FROM harvested h, rng),
merged AS (
  SELECT id, arg_max({{'title': title, 'description': description, 'tags': tags,
                       'favs': favs, 'price': price}}, ord) AS doc,
         list_sort(list_distinct(flatten(list([category])))) AS categories
  FROM priced GROUP BY id)
"""


def harvested(spark, sf_dir):
    photos = bindings.harvest_candidates(spark, sf_dir)
    counts = cat.favourite_counts(bindings.favourites(spark, sf_dir), "photo")
    return cat.harvest(photos, counts)


def priced_items(spark, sf_dir):
    return cat.with_price(cat.make_items(cat.as_harvest_records(harvested(spark, sf_dir)),
                                         keep=("ord",)))


def catalog_snapshot(spark, sf_dir):
    """The merged catalog: one document per id."""
    return cat.merge_items(priced_items(spark, sf_dir))


@register("harvest_accepted", ["J5", "A4", "F4", "U1"], sql=f"""
WITH {HARVEST_SQL}
SELECT id, category, title, favs, md5(description) AS description_md5,
       array_to_string(tags, '|') AS tags
FROM harvested
""")
def harvest_accepted(spark, sf_dir):
    """All photos that the harvest keeps: favourites counted, threshold 30."""
    h = harvested(spark, sf_dir)
    return h.select("id", "category", "title", "favs",
                    F.md5("description").alias("description_md5"),
                    F.array_join("tags", "|").alias("tags"))


# A top-k report: what the harvester's two limits would take.
FIRST_PAGE, FIRST_PHOTOS = 33, 20


@register("harvest_first_photos", ["A4", "W3"], sql=f"""
WITH {HARVEST_SQL}
SELECT id, category, least(favs, {FIRST_PAGE}) AS favs FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY arrival, id) AS rn FROM harvested)
WHERE rn <= {FIRST_PHOTOS}
""")
def harvest_first_photos(spark, sf_dir):
    """The first photos of every category in arrival order, with the
    favourites that one result page shows."""
    counts = cat.favourite_counts(bindings.favourites(spark, sf_dir), "photo", page=FIRST_PAGE)
    photos = bindings.harvest_candidates(spark, sf_dir)
    return cat.harvest(photos, counts, max_images=FIRST_PHOTOS).select("id", "category", "favs")


@register("catalog_prices", ["A3", "J7", "C8", "M16"], sql=f"""
WITH {HARVEST_SQL}
SELECT id, category, favs, price FROM priced
""")
def catalog_prices(spark, sf_dir):
    """Item documents with their price band from the global favourite range."""
    return priced_items(spark, sf_dir).select(
        "id", F.col("categories")[0].alias("category"), "favs", "price")


@register("catalog_merged", ["A5", "A6", "S13", "U2", "U3", "M16", "M17", "M18", "C10"],
          bench=True, sql=f"""
WITH {HARVEST_SQL}
SELECT id, doc.title AS title, doc.title AS complete_title, doc.favs AS favs,
       doc.price AS price, md5(doc.description) AS description_md5,
       array_to_string(doc.tags, '|') AS tags, array_to_string(categories, '|') AS categories
FROM merged
""")
def catalog_merged(spark, sf_dir):
    """Duplicates merged by id: newest copy wins, categories united and sorted."""
    m = catalog_snapshot(spark, sf_dir)
    return m.select("id", "title", "complete_title", "favs", "price",
                    F.md5("description").alias("description_md5"),
                    F.array_join("tags", "|").alias("tags"),
                    F.array_join("categories", "|").alias("categories"))


@register("catalog_validation", ["F8", "F10"], sql=f"""
WITH {HARVEST_SQL}
SELECT id,
       array_to_string(list_filter([
         CASE WHEN id IS NULL OR id = '' THEN 'id_empty' END,
         CASE WHEN id <> '' AND NOT regexp_matches(id, '^[0-9]{{6,15}}$') THEN 'id_pattern' END,
         CASE WHEN coalesce(len(categories), 0) <= 0 THEN 'categories_empty' END],
         lambda x: x IS NOT NULL), '|') AS reasons,
       CASE WHEN regexp_matches(id, '^[0-9]{{6,15}}$') AND len(categories) > 0
            THEN 200 ELSE 422 END AS status
FROM merged
""")
def catalog_validation(spark, sf_dir):
    """Each merged item with its rejection reasons and load status."""
    v = cat.validate(catalog_snapshot(spark, sf_dir))
    return v.select("id", F.array_join("reasons", "|").alias("reasons"), "status")


@register("catalog_load_summary", ["A10", "F8"], sql=f"""
WITH {HARVEST_SQL}
SELECT CASE WHEN regexp_matches(id, '^[0-9]{{6,15}}$') AND len(categories) > 0
            THEN 200 ELSE 422 END AS status, count(*) AS n
FROM merged GROUP BY 1
""")
def catalog_load_summary(spark, sf_dir):
    """Count of merged items by load outcome."""
    return cat.load_summary(cat.validate(catalog_snapshot(spark, sf_dir)))


@register("catalog_size", ["A7"], sql=f"""
WITH {HARVEST_SQL}
SELECT count(*) AS n_items, count(*) = 0 AS empty FROM merged
""")
def catalog_size(spark, sf_dir):
    """Number of catalog documents; zero flags an empty catalog."""
    return (catalog_snapshot(spark, sf_dir)
            .agg(F.count(F.lit(1)).alias("n_items"))
            .withColumn("empty", F.col("n_items") == 0))


@register("catalog_from_files", ["S10", "S11", "U2", "C6", "C13", "A5"], sql=f"""
WITH {HARVEST_SQL}
SELECT id, doc.title AS title, doc.title AS complete_title, doc.favs AS favs,
       doc.price AS price, md5(doc.description) AS description_md5,
       array_to_string(doc.tags, '|') AS tags, array_to_string(categories, '|') AS categories
FROM merged
""")
def catalog_from_files(spark, sf_dir):
    """The catalog build through files: harvest records written as JSON
    lines per (search order, category), read back with the declared schema;
    the position of a record's folder decides which copy is newest."""
    from shoplytics.sources import harvest as hv
    from shoplytics.streaming.runner import scratch
    dest = scratch(spark, "harvest-files")
    hv.write_harvest(cat.as_harvest_records(harvested(spark, sf_dir)), dest, by=("ord", "category"))
    files = hv.read_harvest(spark, [f"{dest}/ord={i}" for i in (0, 1)])
    m = cat.merge_items(cat.with_price(cat.make_items(files, keep=("file_pos",))), "file_pos")
    return m.select("id", "title", "complete_title", "favs", "price",
                    F.md5("description").alias("description_md5"),
                    F.array_join("tags", "|").alias("tags"),
                    F.array_join("categories", "|").alias("categories"))


@register("catalog_variants", ["J4", "M19", "M21", "M22", "S14", "C12"], sql=f"""
WITH s AS (
  SELECT CAST(l_partkey AS VARCHAR) AS id,
         {list(cat.VARIANT_NAMES)}[((l_linenumber - 1) % {len(cat.VARIANT_NAMES)}) + 1] AS label,
         CAST(floor(l_quantity) * 20 AS INTEGER) AS w,
         CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS INTEGER) AS h,
         l_orderkey, l_linenumber, l_quantity, l_extendedprice
  FROM lineitem),
last AS (SELECT id, label, arg_max(w, (l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS w,
                arg_max(h, (l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS h
         FROM s GROUP BY id, label),
agg AS (SELECT id, CAST(count(*) AS INTEGER) AS n_variants, max(w) AS largest_width,
               CAST(max(CASE WHEN label = 'Medium' THEN w END) AS VARCHAR) AS medium_width,
               array_to_string(list_sort(list(label)), '|') AS names
        FROM last GROUP BY id)
SELECT a.id, a.n_variants, a.largest_width,
       (SELECT max(h) FROM last l WHERE l.id = a.id AND l.w = a.largest_width) AS largest_height,
       a.medium_width, a.names, true AS roundtrip_ok
FROM agg a
""")
def catalog_variants(spark, sf_dir):
    """Photo sizes nested per photo (last size per label wins), typed as
    item variants: count, largest (width, height), the Medium variant, and
    the array form of the map read back equal."""
    # (order, line) repeats in the line table: the size values break ties,
    # so "last" is a total order (equal keys then give equal entries).
    sizes = cat.sizes_per_photo(bindings.photo_sizes(spark, sf_dir), "photo",
                                ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    photos = bindings.catalog_items(spark, sf_dir).select(
        "id", "title", F.lit(None).cast("string").alias("description"),
        F.array("tag").alias("tags"), "favs", "category")
    items = cat.make_items(cat.as_harvest_records(cat.with_sizes(photos, sizes).filter(
        F.col("sizes").isNotNull()), keep=("category",)))
    arr = items.withColumn("arr", cat.variants_to_array())
    back = arr.withColumn("back", cat.array_to_variants("arr"))
    big = cat.largest_variant()
    return back.select(
        "id", F.size(F.map_keys("variants")).alias("n_variants"),
        big["width"].alias("largest_width"), big["height"].alias("largest_height"),
        cat.variant("Medium")["width"].cast("string").alias("medium_width"),
        F.array_join(F.array_sort(F.transform("arr", lambda x: x["name"])), "|").alias("names"),
        (F.array_sort(F.map_entries("variants")) == F.array_sort(F.map_entries("back")))
        .alias("roundtrip_ok"))


@register("catalog_upsert", ["S13"], sql="""
WITH cur AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS tag, 0 AS ord
             FROM part),
upd AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, p.p_name || ' (' || d.lang || ')' AS title,
               d.source AS tag, 1 AS ord
        FROM documents d JOIN part p ON p.p_partkey = d.doc_id),
b AS (SELECT * FROM cur UNION ALL SELECT * FROM upd)
SELECT id, arg_max(title, ord) AS title, arg_max(tag, ord) AS tag, max(ord) AS ord
FROM b GROUP BY id
""")
def catalog_upsert(spark, sf_dir):
    """Whole-document writes by id, last write wins: the part catalog,
    then newer documents for the parts that have a description."""
    part = bindings.catalog_items(spark, sf_dir).select("id", "title", "tag",
                                                        F.lit(0).alias("ord"))
    docs = bindings.described_items(spark, sf_dir)
    names = bindings.catalog_items(spark, sf_dir).select("id", F.col("title").alias("name"))
    upd = (docs.join(names, "id").select(
        "id", F.concat(F.col("name"), F.lit(" ("), F.col("categories")[0], F.lit(")"))
        .alias("title"), F.col("tags")[0].alias("tag"), F.lit(1).alias("ord")))
    return cat.upsert(part, upd).select("id", "title", "tag", "ord")


@register("catalog_store", ["S13"], sql="""
WITH names AS (SELECT d.doc_id, p.p_name || ' (' || d.lang || ')' AS title, d.source AS tag
               FROM documents d JOIN part p ON p.p_partkey = d.doc_id),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS tag, 1 AS ord FROM part
      UNION ALL SELECT CAST(doc_id AS VARCHAR), title, tag, 2 FROM names
      UNION ALL SELECT CAST(doc_id AS VARCHAR), title || ', corrected', tag, 3 FROM names WHERE doc_id % 5 = 0
      UNION ALL SELECT CAST(doc_id AS VARCHAR), title || ', outdated', tag, 0 FROM names WHERE doc_id % 7 = 0)
SELECT id, arg_max(title, ord) AS title, arg_max(tag, ord) AS tag, max(ord) AS ord FROM b GROUP BY id
""")
def catalog_store(spark, sf_dir):
    """The part catalog stored by id, and a stream of document writes, corrections and outdated
    writes merged into the folders that they touch, in several micro-batches."""
    from shoplytics.sources import store
    from shoplytics.streaming import runner
    base = runner.scratch(spark, "store")
    items = bindings.catalog_items(spark, sf_dir)
    store.create(items.select("id", "title", "tag", F.lit(1).alias("ord")), base + "/catalog")
    docs = bindings.described_items(spark, sf_dir).join(items.select("id", F.col("title").alias("name")), "id")
    title = F.concat("name", F.lit(" ("), F.col("categories")[0], F.lit(")"))
    kinds = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(m).alias("mod"), F.lit(t).alias("add"))
                      for o, m, t in ((2, 1, ""), (3, 5, ", corrected"), (0, 7, ", outdated"))])
    writes = (docs.select("id", "id_num", title.alias("name"), F.col("tags")[0].alias("tag"), F.explode(kinds).alias("k"))
              .filter(F.pmod("id_num", "k.mod") == 0)
              .select("id", F.concat("name", "k.add").alias("title"), "tag", F.col("k.ord").alias("ord")))
    writes.repartition(3).write.parquet(base + "/writes")
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(base + "/writes")
    store.merge_stream(stream, base + "/catalog", base + "/checkpoint")
    return store.read(spark, base + "/catalog").select("id", "title", "tag", "ord")


_WORD_GAP = r"[^\p{L}\p{N}]"


def _searches_sql() -> str:
    """The configuration as (category, keyword_pos, keyword, pattern)."""
    import yaml
    rows = [(c, i, k) for entry in yaml.safe_load(bindings.SEARCHES)["categories"]
            for c, conf in entry.items() for i, k in enumerate(conf["keywords"])]
    return ", ".join(f"('{c}', {i}, '{k}', '(^|{_WORD_GAP})' || replace('{k.lower()}', ' ', '{_WORD_GAP}+') || '({_WORD_GAP}|$)')"
                     for c, i, k in rows)


@register("harvest_by_keyword", ["U1", "S12", "J3", "J5", "A4", "F4", "W3", "M20"], sql=f"""
WITH k(category, keyword_pos, keyword, pattern) AS (VALUES {_searches_sql()}),
ph AS (SELECT p_partkey, {bindings.photo_id_sql('p_partkey')} AS id, p_name AS title, d.* FROM part LEFT JOIN documents d ON doc_id = p_partkey),
f AS (SELECT l_partkey, count(*) AS favs FROM lineitem GROUP BY 1),
hit AS (
  SELECT k.*, ph.*, favs FROM k, ph JOIN f ON l_partkey = p_partkey
  WHERE favs >= 30 AND (regexp_matches(lower(title), pattern) OR regexp_matches(lower(coalesce(text, '')), pattern)))
SELECT category, keyword, id, CAST(favs AS INTEGER) AS favs,
       row_number() OVER (PARTITION BY category ORDER BY keyword_pos, p_partkey) AS place,
       CASE WHEN doc_id % 3 = 0 THEN source ELSE upper(source) END AS owner, n_chars AS length, lang AS tag
FROM hit
""")
def harvest_by_keyword(spark, sf_dir):
    """The harvest from its configuration: the photos found for each keyword, chained in the order of
    the keywords, favourites counted, threshold 30, each with its place in its category's results and
    with its info record joined (owner as displayed, length, first tag), where it has one."""
    from shoplytics.operators import ordering
    from shoplytics.sources import harvest as hv
    config = hv.category_config(spark, bindings.SEARCHES)
    found = cat.keyword_results(bindings.searchable_photos(spark, sf_dir), config)
    counts = cat.favourite_counts(bindings.favourites(spark, sf_dir), "photo")
    kept = cat.accept(cat.with_favourites(found, counts)).select("category", "keyword_pos", "keyword", "id", "arrival", "favs")
    placed = ordering.group_row_number(kept, ["category"], ["keyword_pos", "arrival"], "place")
    return cat.with_info(placed, bindings.photo_info(spark, sf_dir)).select(
        "category", "keyword", "id", "favs", "place", cat.display_owner("info.owner").alias("owner"),
        F.col("info.length").alias("length"), F.get("info.tags", F.lit(0)).alias("tag"))
