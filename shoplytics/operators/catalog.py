"""Catalog build: harvest, item documents, prices, merge, validation
(J3-J5, A3-A7, A10, F4, F8, F9, W3, M16-M22, S13, S14, U1-U3).

Harvest (per category): candidate photos -> favourite count -> keep favs >=
threshold -> info -> sizes.  The harvester's limits (favourites of the first
page only, first N photos per category) are arguments, off by default.  Build: harvest record -> item document -> price band from the
global favourite range -> merge duplicates by id (newest wins, categories
united) -> validate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.functions import ids

# The harvest threshold and display variant names.
FAV_THRESHOLD = 30
VARIANT_NAMES = ("Large Square", "Medium", "Small", "Square", "Original")


# --- harvest ---------------------------------------------------------------

def favourite_counts(favourites: DataFrame, photo_col: str,
                     page: int | None = None) -> DataFrame:
    """A4: favourites per photo; with ``page``, as one result page of that
    size shows them (a count of at most ``page``)."""
    n = F.count(F.lit(1))
    return (favourites.groupBy(F.col(photo_col).alias("id"))
                      .agg((n if page is None else F.least(n, F.lit(page))).cast("int").alias("favs")))


def with_favourites(photos: DataFrame, counts: DataFrame) -> DataFrame:
    """Photo -> favourite count, a photo with none counts 0."""
    return (photos.join(counts, "id", "left")
                  .withColumn("favs", F.coalesce(F.col("favs"), F.lit(0))))


def accept(photos: DataFrame, threshold: int = FAV_THRESHOLD) -> DataFrame:
    """keep photos with at least ``threshold`` favourites."""
    return photos.filter(F.col("favs") >= threshold)


def first_per_category(photos: DataFrame, n: int,
                       order_cols: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """The first ``n`` accepted photos per category in arrival order.
    ``row_number() <= n`` plans as a WindowGroupLimit, which trims each
    category to ``n`` rows per task before the shuffle, so a hot category
    ships at most ``n`` rows per input partition."""
    w = Window.partitionBy("category").orderBy(*order_cols)
    return (photos.withColumn("__rn", F.row_number().over(w))
                  .filter(F.col("__rn") <= n).drop("__rn"))


def normalize_tags(tags: Column, compat: bool = False) -> Column:
    """NULL entries removed.  ``compat`` mimics the reference, which
    empties the list only when its first tag is NULL."""
    if compat:
        return F.when(F.element_at(tags, 1).isNull(), F.array().cast("array<string>")).otherwise(tags)
    return F.filter(tags, lambda x: x.isNotNull())


def last_per_label(entries: Column, label: str = "label") -> Column:
    """Of several size entries with the same label keep the last."""
    idx = F.sequence(F.lit(1), F.size(entries))
    return F.filter(
        F.zip_with(entries, idx, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda x: ~F.exists(F.slice(entries, x["i"] + 1, F.size(entries)),
                            lambda y: y[label] == x["e"][label]),
    )


def sizes_to_map(entries: Column) -> Column:
    """A list of ``{label, width, height, source, url}`` as a map by label."""
    kept = F.transform(last_per_label(entries), lambda x: x["e"])
    return F.map_from_arrays(
        F.transform(kept, lambda x: x["label"]),
        F.transform(kept, lambda x: F.struct(x["width"].alias("width"), x["height"].alias("height"),
                                             x["source"].alias("source"), x["url"].alias("url"))))


def with_info(photos: DataFrame, info: DataFrame) -> DataFrame:
    """Photo -> its info record (owner, title, description, tags) as a
    nested ``info`` struct; a photo without info keeps a NULL struct, and
    dotted access on it stays NULL (M17)."""
    fields = [c for c in info.columns if c != "id"]
    nested = info.select("id", F.struct(*fields).alias("info"))
    return photos.drop("info").join(nested, "id", "left")


def sizes_per_photo(sizes: DataFrame, photo_col: str = "photo",
                    order_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One-to-many photo sizes nested as a map by label, the last
    entry per label (in ``order_cols`` order) winning.  ``max_by`` per
    (photo, label) is a partial-aggregating hash aggregate; the map per
    photo holds at most one entry per label."""
    last = sizes.groupBy(F.col(photo_col).alias("id"), "label").agg(
        F.max_by(F.struct("width", "height", "source", "url"),
                 F.struct(*order_cols)).alias("v"))
    return last.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("sizes"))


def with_sizes(photos: DataFrame, sizes_map: DataFrame) -> DataFrame:
    """Photo -> its sizes (left join; a photo without sizes keeps NULL)."""
    return photos.join(sizes_map, "id", "left")


def _words(text: Column) -> Column:
    """The words of a text, in order: runs of letters or digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _phrases(words: Column, n: int) -> Column:
    """All runs of ``n`` words, each joined by one space."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def keyword_results(photos: DataFrame, config: DataFrame, fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """The results of every keyword of ``config`` (category, keyword_pos, keyword, as
    ``sources.harvest.category_config`` reads them), chained: a photo comes once for each
    keyword whose words stand one after another in one of ``fields``, whatever their case and what stands between.

    The photos' distinct word runs, of the lengths that keywords have, are joined to the keywords:
    the texts don't grow with the number of keywords, and a configuration of broadcast size costs no
    shuffle.  A keyword without words finds nothing; a null field holds none."""
    words = _words(F.col("keyword"))
    asked = (config.select("category", "keyword_pos", "keyword", F.array_join(words, " ").alias("__phrase"),
                           F.size(words).alias("__n")).filter(F.col("__n") > 0))
    lengths = [n for (n,) in asked.select("__n").distinct().orderBy("__n").collect()]  # of the configuration alone
    if not lengths:
        return photos.join(asked.drop("__phrase", "__n"), F.lit(False))
    split = photos.select("*", *[_words(F.col(f)).alias(f"__{f}") for f in fields])
    runs = F.array_distinct(F.concat(*[_phrases(F.col(f"__{f}"), n) for f in fields for n in lengths]))
    found = split.withColumn("__phrase", F.explode(runs)).drop(*[f"__{f}" for f in fields])
    return found.join(asked.drop("__n"), "__phrase").drop("__phrase")


# --- item documents --------------------------------------------------------

def harvest(photos: DataFrame, favourite_counts_df: DataFrame,
            threshold: int = FAV_THRESHOLD, max_images: int | None = None) -> DataFrame:
    """The harvest chain over candidate photos (one row per category hit):
    favourites -> threshold, and with ``max_images`` the first so many per category."""
    kept = accept(with_favourites(photos, favourite_counts_df), threshold)
    return kept if max_images is None else first_per_category(kept, max_images, ("arrival", "id"))


def as_harvest_records(photos: DataFrame, keep: tuple[str, ...] = ("category", "ord")) -> DataFrame:
    """Shape flat photo rows as harvest records (nested info / owner / sizes)."""
    owner_t = "struct<id:string,username:string,realname:string>"
    sizes_t = "map<string,struct<width:string,height:string,source:string,url:string>>"
    return photos.select(
        "id", "title", "favs",
        F.struct(F.col("owner").cast(owner_t).alias("owner") if "owner" in photos.columns
                 else F.lit(None).cast(owner_t).alias("owner"),
                 F.col("title").alias("title"), F.col("description").alias("description"),
                 F.col("tags").alias("tags")).alias("info"),
        (F.col("sizes") if "sizes" in photos.columns else F.lit(None)).cast(sizes_t).alias("sizes"),
        *keep)


def make_items(harvest: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Harvest record -> item document.  Dotted access is
    null-safe (a missing ``info`` gives NULL fields); sizes become typed
    variants with explicit ``try_cast`` of the string widths."""
    variants = F.transform_values(
        F.col("sizes"),
        lambda k, v: F.struct(v["width"].try_cast("int").alias("width"),
                              v["height"].try_cast("int").alias("height"),
                              v["url"].alias("flickr_url"), v["source"].alias("img_source")))
    return harvest.select(
        F.col("id"), F.col("title"), F.col("title").alias("complete_title"),
        F.col("info.description").alias("description"),
        F.coalesce(normalize_tags(F.col("info.tags")), F.array().cast("array<string>")).alias("tags"),
        F.col("favs"),
        F.struct(F.col("info.owner.id").alias("user_id"),
                 F.col("info.owner.username").alias("user_name"),
                 F.col("info.owner.realname").alias("real_name")).alias("owner"),
        F.array(F.col("category")).alias("categories"),
        variants.alias("variants"),
        *[F.col(k) for k in keep],
    )


def with_price(items: DataFrame) -> DataFrame:
    """Price band 1 or 2 from the global favourite range,
    ``int((favs - min) / ((max - min + 1) / 2)) + 1``.  The range is a
    scalar subquery (a partial/final aggregate evaluated once, its value
    shipped to every task): no unpartitioned window, no join."""
    mn = items.agg(F.min("favs")).scalar()
    mx = items.agg(F.max("favs")).scalar()
    band = (F.col("favs") - mn) / ((mx - mn + 1) / F.lit(2.0))
    return items.withColumn("price", (band.cast("int") + 1).cast("int"))


def _newest(order_col: str, fields: list[str]) -> Column:
    """What the newest row has the most of: its order, then its content's hash."""
    return F.struct(order_col, F.md5(F.to_json(F.struct(*fields))))


def merge_items(items: DataFrame, order_col: str = "ord") -> DataFrame:
    """One document per id.  Fields come from the newest
    row (highest ``order_col``; of equally new ones, the one with the largest
    content hash, so row order never decides), categories are the sorted union
    of all rows.  ``max_by`` and ``collect_set`` combine partially on the map
    side (a sort aggregate, as the state holds strings), and the set
    de-duplicates copies, so an id repeated millions of times still carries one
    category list per distinct list."""
    fields = [c for c in items.columns if c not in ("id", "categories", order_col)]
    merged = items.groupBy("id").agg(
        F.max_by(F.struct(*fields), _newest(order_col, fields)).alias("__doc"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"))
    return merged.select("id", *[F.col(f"__doc.{c}").alias(c) for c in fields], "categories")


def upsert(current: DataFrame, updates: DataFrame, order_col: str = "ord") -> DataFrame:
    """Whole-document overwrite by id, last write wins (``max_by`` on the
    write order, ties by content hash; it combines on the map side)."""
    both = current.unionByName(updates, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in ("id",)]
    latest = both.groupBy("id").agg(F.max_by(F.struct(*fields), _newest(order_col, fields)).alias("__doc"))
    return latest.select("id", *[F.col(f"__doc.{c}").alias(c) for c in fields])


def validation_reasons(strict_nested: bool = False) -> Column:
    """Why an item would be rejected (empty array = valid)."""
    checks = [
        F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("id_empty")),
        F.when(F.col("id").isNotNull() & (F.col("id") != "") & ~ids.is_product_id("id"),
               F.lit("id_pattern")),
        F.when(F.coalesce(F.size("categories"), F.lit(0)) <= 0, F.lit("categories_empty")),
    ]
    if strict_nested:
        checks += [
            F.when(F.col("owner.user_id").isNull() | (F.col("owner.user_id") == ""),
                   F.lit("owner_empty")),
            F.when(F.coalesce(F.size(F.map_keys("variants")), F.lit(0)) <= 0, F.lit("variants_empty")),
            F.when(F.exists(F.map_values("variants"),
                            lambda v: (v["width"] < 1) | (v["height"] < 1)), F.lit("variant_size")),
        ]
    return F.array_compact(F.array(*checks))


def validate(items: DataFrame, strict_nested: bool = False) -> DataFrame:
    """F8: split into loaded (status 200) and rejected (422) with reasons."""
    r = items.withColumn("reasons", validation_reasons(strict_nested))
    return r.withColumn("status", F.when(F.size("reasons") == 0, F.lit(200)).otherwise(F.lit(422)))


def load_summary(validated: DataFrame) -> DataFrame:
    """A10: count by outcome code."""
    return validated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- display projections ---------------------------------------------------

def display_owner(owner: str = "owner") -> Column:
    """Real name, else user name (an empty string counts as missing)."""
    return F.coalesce(F.nullif(F.col(f"{owner}.real_name"), F.lit("")), F.col(f"{owner}.user_name"))


def largest_variant(variants: str = "variants") -> Column:
    """The largest (width, height) over all variants."""
    return F.array_max(F.transform(F.map_values(F.col(variants)),
                                   lambda v: F.struct(v["width"].alias("width"),
                                                      v["height"].alias("height"))))


def variant(name: str, variants: str = "variants") -> Column:
    """One named variant, NULL when absent."""
    return F.try_element_at(F.col(variants), F.lit(name))


def variants_to_array(variants: str = "variants") -> Column:
    """Map name -> variant stored as an array of ``{name, ...}``."""
    return F.transform(F.map_entries(F.col(variants)),
                       lambda e: F.struct(e["key"].alias("name"), e["value"]["width"].alias("width"),
                                          e["value"]["height"].alias("height"),
                                          e["value"]["flickr_url"].alias("flickr_url"),
                                          e["value"]["img_source"].alias("img_source")))


def array_to_variants(arr: str = "variants") -> Column:
    """S14 back: duplicate names fail the task (as a map builder with an
    exception-on-duplicate policy does)."""
    return F.map_from_entries(F.transform(
        F.col(arr), lambda v: F.struct(v["name"], F.struct(v["width"].alias("width"),
                                                           v["height"].alias("height"),
                                                           v["flickr_url"].alias("flickr_url"),
                                                           v["img_source"].alias("img_source")))))
