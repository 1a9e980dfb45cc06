"""Raw collector event -> typed shop event (M1-M13), as one DataFrame transform.

The collector's mapping rules are evaluated as column expressions.  Rule
precedence follows the mapping's sections: a rule that yields no value leaves
the earlier value in place, and leaving a section does not stop the rules
after it, so every derived column is a ``coalesce`` of its rules, latest
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytics.functions import urls
from shoplytics.sources.schemas import DERIVED_FIELDS, RAW_EVENT, SHOP_EVENT

# Route names, event types and parameter keys of the shop.
ROUTES = {"category": "category", "product": "product", "download": "download"}
HOME_PATH = "/"
UNKNOWN = "unknown"
PAGE_VIEW = "pageView"
IMPRESSION = "impression"
ITEM_EVENTS = ("removeFromBasket", "addToBasket", "preview")
SOURCE_KEY = "source"


def _param(key: str) -> Column:
    return F.try_element_at(F.col("eventParameters"), F.lit(key))


def conform_raw(df: DataFrame) -> DataFrame:
    """Give any input the raw-event columns (missing ones as typed NULLs)."""
    cols = []
    for f in RAW_EVENT.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in RAW_EVENT.fieldNames()
             and c not in DERIVED_FIELDS]
    return df.select(*cols, *extra)


def location_columns(location: Column, routes: dict[str, str] = ROUTES) -> dict[str, Column]:
    """Location-derived values (M3-M8): path, fragment and route fields."""
    path = urls.uri_path(location)
    g1, g2, g3 = (urls.route_group(path, i) for i in (1, 2, 3))
    is_home = path == F.lit(HOME_PATH)
    routed = ~is_home & g1.isNotNull()
    is_cat = routed & (g1 == F.lit(routes["category"]))
    return {
        "path": path,
        "fragment": urls.uri_fragment(location),
        "pageType": F.when(is_home, F.lit("home")).when(routed, g1),
        "category": F.when(is_cat, g2),
        # page: 0 when the page group is absent, else its int32 value (a value
        # that does not parse leaves the field unset).
        "page": F.when(is_cat, F.when(g3.isNull(), F.lit(0)).otherwise(g3.try_cast("int"))),
        "productId": F.when(routed & (g1 == F.lit(routes["product"])), g2),
        "downloadId": F.when(routed & (g1 == F.lit(routes["download"])), g2),
    }


def map_events(raw: DataFrame, routes: dict[str, str] = ROUTES,
               source_key: str = SOURCE_KEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply the collector mapping; returns the 33 shop-event columns (plus
    the ``keep`` columns of the input)."""
    df = conform_raw(raw)
    loc = location_columns(F.col("location"), routes)
    df = df.withColumn("__frag", loc["fragment"])
    etype = F.col("eventType")

    page_source = F.when(etype == F.lit(PAGE_VIEW),
                         urls.fragment_query_value(F.col("__frag"), source_key))
    imp = etype == F.lit(IMPRESSION)
    item_evt = etype.isin(*ITEM_EVENTS)

    product = F.coalesce(
        F.when(item_evt, _param("item_id")),
        F.when(imp, _param("productId")),
        loc["productId"],
    )
    source = F.coalesce(F.when(imp, _param("source")), page_source)

    derived = {
        "pageType": F.coalesce(loc["pageType"], F.lit(UNKNOWN)),
        "page": loc["page"],
        "productId": product,
        "downloadId": loc["downloadId"],
        "category": loc["category"],
        "source": source,
    }
    out = []
    for f in SHOP_EVENT.fields:
        if f.name in derived:
            out.append(derived[f.name].cast(f.dataType).alias(f.name))
        elif f.name == "eventType":
            out.append(F.coalesce(etype, F.lit(UNKNOWN)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out, *[F.col(k) for k in keep])


def drop_flagged(events: DataFrame, enabled: bool = False) -> DataFrame:
    """duplicate / corrupt flags are carried as data; filtering on them
    is opt-in (the reference stores and never filters)."""
    if not enabled:
        return events
    return events.filter(~F.coalesce(F.col("detectedDuplicate"), F.lit(False))
                         & ~F.coalesce(F.col("detectedCorruption"), F.lit(False)))
