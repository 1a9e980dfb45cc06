"""Declared schemas.

The click-event record is a flat 33-field record.  It is declared once as a
literal StructType (all fields nullable on read; defaults are applied by the
mapping), instead of converting an Avro schema file at start-up.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

# Field names and order of the click-event record.
SHOP_EVENT_FIELDS = [
    ("detectedDuplicate", _B), ("detectedCorruption", _B), ("firstInSession", _B),
    ("timestamp", _L), ("clientTimestamp", _L), ("remoteHost", _S),
    ("referer", _S), ("location", _S),
    ("viewportPixelWidth", _I), ("viewportPixelHeight", _I),
    ("screenPixelWidth", _I), ("screenPixelHeight", _I),
    ("partyId", _S), ("sessionId", _S), ("pageViewId", _S), ("eventId", _S),
    ("eventType", _S),
    ("userAgentString", _S), ("userAgentName", _S), ("userAgentFamily", _S),
    ("userAgentVendor", _S), ("userAgentType", _S), ("userAgentVersion", _S),
    ("userAgentDeviceCategory", _S), ("userAgentOsFamily", _S),
    ("userAgentOsVersion", _S), ("userAgentOsVendor", _S),
    ("pageType", _S), ("page", _I), ("productId", _S), ("downloadId", _S),
    ("category", _S), ("source", _S),
]

SHOP_EVENT = T.StructType([T.StructField(n, t, True) for n, t in SHOP_EVENT_FIELDS])

# The six fields the mapping derives; the raw collector input has the others
# plus a map of event parameters.
DERIVED_FIELDS = ("pageType", "page", "productId", "downloadId", "category", "source")

RAW_EVENT = T.StructType(
    [T.StructField(n, t, True) for n, t in SHOP_EVENT_FIELDS if n not in DERIVED_FIELDS]
    + [T.StructField("eventParameters", T.MapType(_S, _S), True)]
)

# Two-column record used by the reference streaming tests.
TIMED_EVENT = T.StructType([T.StructField("eventType", _S), T.StructField("timestamp", _L)])

# Harvested photo record, one JSON line per photo (numeric sizes arrive as strings).
HARVEST_RECORD = T.StructType([
    T.StructField("id", _S), T.StructField("title", _S), T.StructField("favs", _I),
    T.StructField("info", T.StructType([
        T.StructField("owner", T.StructType([
            T.StructField("id", _S), T.StructField("username", _S),
            T.StructField("realname", _S)])),
        T.StructField("title", _S), T.StructField("description", _S),
        T.StructField("tags", T.ArrayType(_S)),
    ])),
    T.StructField("sizes", T.MapType(_S, T.StructType([
        T.StructField("width", _S), T.StructField("height", _S),
        T.StructField("source", _S), T.StructField("url", _S)]))),
])

VARIANT = T.StructType([
    T.StructField("width", _I), T.StructField("height", _I),
    T.StructField("flickr_url", _S), T.StructField("img_source", _S),
])

OWNER = T.StructType([
    T.StructField("user_id", _S), T.StructField("user_name", _S),
    T.StructField("real_name", _S),
])

CATALOG_ITEM = T.StructType([
    T.StructField("id", _S), T.StructField("title", _S),
    T.StructField("complete_title", _S), T.StructField("description", _S),
    T.StructField("tags", T.ArrayType(_S)), T.StructField("categories", T.ArrayType(_S)),
    T.StructField("favs", _I), T.StructField("price", _I),
    T.StructField("owner", OWNER),
    T.StructField("variants", T.MapType(_S, VARIANT)),
])


def ddl(schema: T.StructType) -> str:
    return schema.simpleString()[len("struct<"):-1]
