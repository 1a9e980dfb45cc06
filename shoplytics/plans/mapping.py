"""Registered event-mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.functions import ids, urls
from shoplytics.operators import mapping
from shoplytics.plans.registry import register
from shoplytics.sources import bindings

# Test-data route names standing in for the shop's routes.
PAGE_ROUTES = {"category": "en", "product": "fr", "download": "de"}

_URI = r"^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)"
_ROUTE = urls.ROUTE_PATTERN


def _g(n):
    return f"nullif(regexp_extract(path, '{_ROUTE}', {n}), '')"


@register("map_page_locations", ["M3", "M4", "M5", "M6", "M7", "M8", "M9", "M12", "M13", "C4", "C5"],
          sql=f"""
WITH u AS (
  SELECT page_id, url,
         regexp_extract(url, '{_URI}', 3) AS path,
         CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#') + 1) END AS fragment,
         CASE WHEN regexp_matches(url, '^[^#]*[?]')
              THEN regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) END AS query
  FROM ({bindings.locations_sql()})
), r AS (
  SELECT *, path <> '/' AND regexp_matches(path, '{_ROUTE}') AS routed,
         {_g(1)} AS g1, {_g(2)} AS g2, {_g(3)} AS g3,
         CASE WHEN fragment LIKE '%?%' THEN regexp_extract(fragment, '[?]([^#]*)', 1) END AS fquery
  FROM u
)
SELECT page_id, path, fragment,
       CASE WHEN path = '/' THEN 'home' WHEN routed THEN g1 ELSE 'unknown' END AS "pageType",
       CASE WHEN routed AND g1 = 'en' THEN g2 END AS category,
       CASE WHEN routed AND g1 = 'en' THEN
            CAST(CASE WHEN g3 IS NULL THEN 0 ELSE TRY_CAST(g3 AS INTEGER) END AS VARCHAR) END AS page,
       CASE WHEN routed AND g1 = 'fr' THEN g2 END AS "productId",
       CASE WHEN routed AND g1 = 'de' THEN g2 END AS "downloadId",
       CASE WHEN regexp_matches(fquery, '(&|^)source=')
            THEN regexp_extract(fquery, '(&|^)source=([^&]*)', 2) END AS source,
       CASE WHEN regexp_matches(query, '(&|^)ref=')
            THEN regexp_extract(query, '(&|^)ref=([^&]*)', 2) END AS ref
FROM r
""")
def map_page_locations(spark, sf_dir):
    """Page URLs mapped as page views: path, fragment, page type, route fields,
    fragment-query source and the ``ref`` query value."""
    locs = bindings.page_locations(spark, sf_dir)
    raw = locs.select("page_id", "location", F.lit(mapping.PAGE_VIEW).alias("eventType"))
    mapped = mapping.map_events(raw, routes=PAGE_ROUTES, keep=("page_id",))
    return mapped.select(
        "page_id",
        urls.uri_path("location").alias("path"),
        urls.uri_fragment("location").alias("fragment"),
        "pageType", "category", F.col("page").cast("string").alias("page"),
        "productId", "downloadId", "source",
        urls.query_value("location", "ref").alias("ref"),
    )


@register("map_click_events", ["M1", "M10", "M11", "M12", "M13", "C14"], sql="""
SELECT CAST(event_id AS VARCHAR) AS "eventId",
       CAST(user_id AS VARCHAR) AS "partyId",
       CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'addToBasket'
            WHEN 'error' THEN 'removeFromBasket' WHEN 'purchase' THEN 'preview'
            WHEN 'signup' THEN 'pageView' ELSE event_type END AS "eventType",
       'unknown' AS "pageType",
       CASE WHEN event_type IN ('view', 'click', 'error', 'purchase')
            THEN json_extract_string(props, '$.k') END AS "productId",
       CASE WHEN event_type = 'view' THEN 'top_pick' END AS source
FROM events
""")
def map_click_events(spark, sf_dir):
    """The events table as collector input (event types renamed by the
    binding, ``props.k`` as item parameter), mapped to shop events."""
    raw = bindings.raw_shop_events(spark, sf_dir)
    return mapping.map_events(raw).select(
        "eventId", "partyId", "eventType", "pageType", "productId", "source")


@register("key_shape_checks", ["F10", "C4"], sql=f"""
SELECT page_id,
       regexp_matches(md5(CAST(page_id AS VARCHAR)), '^[a-f0-9]{{32}}$') AS shopper_ok,
       regexp_matches(md5(CAST(page_id AS VARCHAR)) || CAST(page_id AS VARCHAR),
                      '^[a-f0-9]{{32,60}}$') AS checkout_ok,
       regexp_matches(regexp_extract(url, '/([^/?#]+)/?([?#].*)?$', 1), '^[0-9]{{6,15}}$') AS product_route_ok,
       regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1), '^[a-z]+$') AS category_route_ok
FROM ({bindings.locations_sql()})
""")
def key_shape_checks(spark, sf_dir):
    """Shopper / checkout id shapes and product / category route shapes."""
    pages = bindings.page_locations(spark, sf_dir).withColumnRenamed("location", "url")
    shopper = F.md5(F.col("page_id").cast("string"))
    return pages.select(
        "page_id",
        ids.is_shopper_id(shopper).alias("shopper_ok"),
        ids.is_checkout_id(F.concat(shopper, F.col("page_id").cast("string"))).alias("checkout_ok"),
        ids.is_product_id(F.regexp_extract("url", r"/([^/?#]+)/?([?#].*)?$", 1)).alias("product_route_ok"),
        ids.is_category_name(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1)).alias("category_route_ok"),
    )
