"""How the driver tables stand in for the shop's own records.

The shop's records (click events, catalog items, item descriptions, page
locations) are not in the test data; these views bind them onto the given
tables.  Every job reads through these views, so the work grows with the
tables.

Fixed values (the binding of test columns to shop notions):

* click event:  ``events``: event_id -> eventId, ts -> event time,
  user_id -> partyId / shopper, event_type -> eventType,
  ``props.k`` -> productId
* top-pick click / impression: event_type ``click`` / ``view``
* home-page view: event_type ``signup``
* items of an experiment: four a stretch of ``EXPERIMENT_EVENTS`` event ids (``experiment_item``)
* basket add / remove / checkout email / completed:
  ``click`` / ``error`` / ``signup`` / ``purchase``
* checkout e-mail: the shopper's number at one host; token responses: what a shopper typed,
  nothing on most completions, ``props.k`` as a word on those with event_id mod 5 = 0
* page location: ``pages.url``, rewritten by page_id mod 7 so that every kind of
  route occurs (``page_locations``)
* photo id: the part key, of even keys with leading zeros (``photo_id``)
* catalog item: ``part``: p_partkey -> id, p_name -> title, p_type -> category,
  p_brand -> tag, 30 + p_size -> favs
* arrival of an event: stretches of ``ARRIVAL_DAYS`` days of event time, one job run each; event_ids
  divisible by 11 come one run late; of those divisible by 13 a copy is sent a second later, by 26 in the
  next run, and by 91 one more after 12 days; by 97 the checksum of the properties is wrong
* harvest search: a photo is a part with its description document; ``SEARCHES`` is the configuration
* item description: ``documents.text``; lang -> category, source -> tag
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.functions.times import epoch_micros, epoch_millis

from shoplytics.sources.tables import table

TOP_PICK_CLICK = "click"
TOP_PICK_IMPRESSION = "view"
HOME_VIEW = "signup"
BASKET_ADD = "click"
BASKET_REMOVE = "error"
CHECKOUT_EMAIL = "signup"
CHECKOUT_DONE = "purchase"
FAVS_OFFSET = 30
PHOTO_DIGITS = 15


def use_utc(spark: SparkSession) -> None:
    """Event times are wall-clock UTC; conversions to and from epoch
    milliseconds need the session zone pinned to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def product_id(props_col="props"):
    """productId carried in the event's JSON properties (``$.k``)."""
    return F.get_json_object(F.col(props_col), "$.k")


# Events that share four items, and items that are shown at all.
EXPERIMENT_EVENTS, EXPERIMENT_ITEMS = 64, 200


def experiment_item():
    """The item of a top-pick event, one of the four of its stretch of events."""
    k = F.expr("conv(substring(md5(cast(event_id as string)), 1, 4), 16, 10)").cast("long") % 4
    return ((F.expr(f"event_id div {EXPERIMENT_EVENTS}") * 4 + k) % EXPERIMENT_ITEMS + 1).cast("string")


def experiment_item_sql() -> str:
    k = "CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 4)) AS BIGINT) % 4"
    return f"CAST((event_id // {EXPERIMENT_EVENTS} * 4 + {k}) % {EXPERIMENT_ITEMS} + 1 AS VARCHAR)"


def checkout_email():
    return F.concat(F.lit("shopper"), F.col("user_id").cast("string"), F.lit("@shop.example"))


def token_responses():
    """Words typed at a completion."""
    typed = F.when(F.pmod("event_id", F.lit(5)) == 0, F.array(F.coalesce(product_id(), F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("event_type") == CHECKOUT_DONE, typed)


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (event_id, ts, shopper, event_type, item)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts",
        F.col("user_id").alias("shopper"),
        "event_type",
        product_id().alias("item"),
    )


# Fixed value: event time that one run of a job takes in, in days.
ARRIVAL_DAYS = 5


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``arrival``, the number of the run that they come in time for, and ``checksum``."""
    ev = table(spark, sf_dir, "events")
    late = (F.pmod("event_id", F.lit(11)) == 0).cast("long")
    wrong = (F.pmod("event_id", F.lit(97)) == 0).cast("long")
    return (ev.withColumn("arrival", F.floor(epoch_micros("ts") / (ARRIVAL_DAYS * 86400 * 10**6)) + late)
              .withColumn("checksum", F.crc32(F.col("props").cast("binary")) + wrong))


def events_sent_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the copies that are sent again."""
    ev = arriving_events(spark, sf_dir)

    def copies(of: int, delay: str, runs):
        return (ev.filter(F.pmod("event_id", F.lit(of)) == 0).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {delay}"))
                  .withColumn("arrival", F.col("arrival") + runs))

    soon = (F.pmod("event_id", F.lit(26)) == 0).cast("long")
    return ev.unionByName(copies(13, "1 SECOND", soon)).unionByName(copies(91, "12 DAYS", F.lit(3)))


def arriving_sql() -> str:
    return (f"SELECT *, CAST(floor(epoch_us(ts) / ({ARRIVAL_DAYS} * 86400000000)) AS BIGINT) "
            "+ CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS arrival FROM events")


def sent_again_sql() -> str:
    return f"""SELECT event_id, ts, arrival FROM ({arriving_sql()})
  UNION ALL SELECT event_id, ts + INTERVAL 1 SECOND, arrival + CASE WHEN event_id % 26 = 0 THEN 1 ELSE 0 END
  FROM ({arriving_sql()}) WHERE event_id % 13 = 0
  UNION ALL SELECT event_id, ts + INTERVAL 12 DAY, arrival + 3 FROM ({arriving_sql()}) WHERE event_id % 91 = 0"""


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as catalog items: (id string, title, category, tag, favs, retail price)."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("tag"),
        (F.col("p_size") + F.lit(FAVS_OFFSET)).alias("favs"),
        F.round(F.col("p_retailprice"), 2).alias("retail_price"),
    )


def described_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as searchable items: (id, description, category, tags)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("id_num"),
        F.col("text").alias("description"),
        F.array(F.col("lang")).alias("categories"),
        F.array(F.col("source")).alias("tags"),
    )


# How page locations are derived from the test table's urls, by
# page_id mod 7: (pattern, replacement); other remainders keep the url.
LOCATION_EDITS = {
    1: (r"^([a-z]+://[^/?#]+)/[^?#]*", r"$1/"),                    # the home page
    2: (r"^([a-z]+://[^/?#]+/[a-z]+/[^/?#]+)", r"$1/3"),           # a page number
    3: (r"^([^#]*)(#.*)?$", r"$1#/?source=top_pick&n=1"),          # a source in the fragment
    4: (r"^([a-z]+://[^/?#]+)/[a-z]+/", r"$1/about-"),             # no route
    5: (r"^([a-z]+://[^/?#]+/[a-z]+)/([0-9]+)", r"$1/1000$2"),     # an id of a product's length
    6: (r"^([a-z]+://[^/?#]+/[a-z]+/[^/?#]+)", r"$1/x"),           # a page that is no number
}


def page_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind, location = F.pmod("page_id", F.lit(7)), F.col("url")
    for k, (pattern, new) in LOCATION_EDITS.items():
        location = F.when(kind == k, F.regexp_replace("url", pattern, new)).otherwise(location)
    return pages.select("page_id", location.alias("location"))


def locations_sql() -> str:
    """The same for the oracles: page_id, url."""
    edits = " ".join(
        f"WHEN {k} THEN regexp_replace(url, '{pattern}', '{new.replace('$', chr(92))}')"
        for k, (pattern, new) in LOCATION_EDITS.items())
    return f"SELECT page_id, CASE ((page_id % 7) + 7) % 7 {edits} ELSE url END AS url FROM pages"


# Event types of the test table renamed to the shop's collector
# event types for the mapping job.
SHOP_EVENT_TYPES = {
    "view": "impression",
    "click": "addToBasket",
    "error": "removeFromBasket",
    "purchase": "preview",
    "signup": "pageView",
}


def raw_shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw collector input: ids as strings, epoch-ms timestamps,
    renamed event types and the item as ``item_id`` / ``productId`` parameter
    (with ``source=top_pick`` on impressions)."""
    use_utc(spark)
    ev = table(spark, sf_dir, "events")
    etype = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in SHOP_EVENT_TYPES.items() for x in kv]),
                     F.col("event_type")),
        F.col("event_type"))
    k = product_id()
    params = F.when(
        F.col("event_type") == TOP_PICK_IMPRESSION,
        F.create_map(F.lit("item_id"), k, F.lit("productId"), k,
                     F.lit("source"), F.lit("top_pick")),
    ).otherwise(F.create_map(F.lit("item_id"), k, F.lit("productId"), k))
    return ev.select(
        F.col("event_id").cast("string").alias("eventId"),
        epoch_millis("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("partyId"),
        etype.alias("eventType"),
        params.alias("eventParameters"),
    )


def photo_id(key: str):
    """A photo's id: the part key, of even keys with zeros before it, so that ids of
    both a valid and an invalid shape occur."""
    return F.when(F.pmod(key, F.lit(2)) == 0, F.lpad(F.col(key).cast("string"), PHOTO_DIGITS, "0")) \
            .otherwise(F.col(key).cast("string"))


def photo_id_sql(key: str) -> str:
    return (f"CASE WHEN {key} % 2 = 0 THEN lpad(CAST({key} AS VARCHAR), {PHOTO_DIGITS}, '0') "
            f"ELSE CAST({key} AS VARCHAR) END")


def harvest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate photos from two keyword searches (U1: results chained, no
    dedup): parts listed under their type, and parts that have a description
    document listed under the document's language (file order 1, so they are
    the newer copy when both survive the harvest)."""
    part = table(spark, sf_dir, "part")
    docs = table(spark, sf_dir, "documents")
    by_type = part.select(
        photo_id("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.lower("p_type").alias("category"), F.lit(None).cast("string").alias("description"),
        F.array("p_brand").alias("tags"), F.lit(0).alias("ord"), F.col("p_partkey").alias("arrival"))
    by_lang = docs.join(part, docs.doc_id == part.p_partkey).select(
        photo_id("doc_id").alias("id"), F.col("p_name").alias("title"),
        F.col("lang").alias("category"), F.col("text").alias("description"),
        F.array("source").alias("tags"), F.lit(1).alias("ord"), F.col("doc_id").alias("arrival"))
    return by_type.unionByName(by_lang)


# Fixed value: the harvest's configuration, categories with the phrases searched for each.
SEARCHES = """
categories:
  - jewellery:
      keywords: [ring, small ring, gold]
  - hardware:
      keywords: [bolt, Red Widget, blue]
  - english:
      keywords: [of the, that with, the]
  - german:
      keywords: [und der, der die]
  - nothing:
      keywords: []
"""


def searchable_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as photos, with the text of their description document where there is one."""
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    return part.join(docs, docs.doc_id == part.p_partkey, "left").select(
        photo_id("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.col("text").alias("description"), F.col("p_partkey").alias("arrival"))


def photo_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The info record of the photos that have one: owner, title, tags.  Every third owner gives no real name."""
    docs = table(spark, sf_dir, "documents")
    real = F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.upper("source"))
    return docs.select(photo_id("doc_id").alias("id"),
                       F.struct(F.col("source").alias("user_name"), real.alias("real_name")).alias("owner"),
                       F.col("n_chars").alias("length"), F.array("lang", "source").alias("tags"))


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourite marks: one per order line of the part."""
    return table(spark, sf_dir, "lineitem").select(photo_id("l_partkey").alias("photo"))


def photo_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes of a photo: one per order line of the part, the label
    cycling through the variant names by line number; widths and heights as
    strings (as harvested), ordered by (order, line)."""
    from shoplytics.operators.catalog import VARIANT_NAMES
    li = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(n) for n in VARIANT_NAMES])
    return li.select(
        F.col("l_partkey").cast("string").alias("photo"),
        F.element_at(names, F.pmod(F.col("l_linenumber") - 1, F.lit(len(VARIANT_NAMES))) + 1)
        .alias("label"),
        (F.floor("l_quantity") * 20).cast("string").alias("width"),
        F.pmod(F.floor("l_extendedprice"), F.lit(1000)).cast("string").alias("height"),
        F.concat(F.lit("img/"), F.col("l_orderkey").cast("string")).alias("source"),
        F.concat(F.lit("photo/"), F.col("l_partkey").cast("string")).alias("url"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
