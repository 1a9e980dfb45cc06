"""Collector mapping on literal events."""

from pyspark.sql import functions as F

from shoplytics.operators import mapping
from shoplytics.sources.schemas import SHOP_EVENT


def _raw(spark, rows):
    return spark.createDataFrame(
        rows, "eventId string, eventType string, location string, "
              "eventParameters map<string,string>")


def _map(spark, rows):
    out = mapping.map_events(_raw(spark, rows))
    return {r["eventId"]: r for r in out.collect()}, out


def test_schema_and_defaults(spark):
    got, out = _map(spark, [("1", None, None, None)])
    assert out.schema.fieldNames() == SHOP_EVENT.fieldNames()
    assert got["1"]["eventType"] == "unknown" and got["1"]["pageType"] == "unknown"


def test_location_rules(spark):
    rows = [
        ("home", "pageView", "http://shop/", None),
        ("cat", "pageView", "http://shop/category/animals/", None),
        ("cat2", "pageView", "http://shop/category/animals/2/", None),
        ("catx", "pageView", "http://shop/category/animals/x", None),
        ("prod", "pageView", "http://shop/product/12345678/#/?source=top_pick", None),
        ("dl", "pageView", "http://shop/download/abc/", None),
        ("search", "pageView", "http://shop/search?q=cats", None),
        ("bad", "pageView", "http://shop/a b?c", None),
    ]
    got, _ = _map(spark, rows)
    assert got["home"]["pageType"] == "home"
    assert (got["cat"]["pageType"], got["cat"]["category"], got["cat"]["page"]) == \
        ("category", "animals", 0)
    assert got["cat2"]["page"] == 2
    assert got["catx"]["page"] is None          # unparseable page leaves it unset
    assert got["prod"]["productId"] == "12345678"
    assert got["prod"]["source"] == "top_pick"   # the product-page exit does not stop M9
    assert got["dl"]["downloadId"] == "abc"
    assert got["search"]["pageType"] == "unknown"  # /search has no trailing slash
    assert got["bad"]["pageType"] == "unknown"   # not a URI -> NULL path, no failure


def test_parameter_rules(spark):
    rows = [
        ("imp", "impression", "http://shop/product/1/", {"productId": "42", "source": "top_pick"}),
        ("imp2", "impression", "http://shop/product/1/", {}),
        ("add", "addToBasket", "http://shop/basket/", {"item_id": "7"}),
        ("rm", "removeFromBasket", None, {"item_id": "8"}),
        ("pv", "preview", None, {"item_id": "9"}),
        ("other", "custom", None, {"item_id": "10"}),
    ]
    got, _ = _map(spark, rows)
    assert (got["imp"]["productId"], got["imp"]["source"]) == ("42", "top_pick")
    assert got["imp2"]["productId"] == "1"       # absent parameter keeps the path value
    assert got["add"]["productId"] == "7"
    assert got["rm"]["productId"] == "8" and got["pv"]["productId"] == "9"
    assert got["other"]["productId"] is None


def test_drop_flagged_is_opt_in(spark):
    df = spark.createDataFrame([(True, False), (False, False)],
                               "detectedDuplicate boolean, detectedCorruption boolean")
    assert mapping.drop_flagged(df).count() == 2
    assert mapping.drop_flagged(df, enabled=True).count() == 1


def test_user_agent_fields_pass_through(spark):
    raw = spark.createDataFrame([("1", "pageView", "Firefox", "Browser", "Linux")],
                                "eventId string, eventType string, userAgentName string, "
                                "userAgentType string, userAgentOsFamily string")
    r = mapping.map_events(raw).first()
    assert (r["userAgentName"], r["userAgentType"], r["userAgentOsFamily"]) == \
        ("Firefox", "Browser", "Linux")
    assert r["userAgentVersion"] is None


def test_top_pick_predicates(spark):
    from shoplytics.operators import toppick as tp
    df = spark.createDataFrame(
        [("pageView", "top_pick", "product"), ("impression", "top_pick", "home"),
         ("pageView", None, "home"), ("pageView", "other", "category")],
        "eventType string, source string, pageType string")
    got = [tuple(r) for r in df.select(F.coalesce(tp.is_click(), F.lit(False)),
                                       F.coalesce(tp.is_impression(), F.lit(False)),
                                       tp.is_home_view()).collect()]
    # a home view counts only when the event is neither a click nor an impression
    assert got == [(True, False, False), (False, True, False), (False, False, True),
                   (False, False, False)]


def test_url_fixture_across_event_types(spark):
    """Every fixture URL with every event type: the location rules apply to
    all event types, the fragment source only to page views, the item
    parameter only to basket / preview events."""
    urls = ["http://shop/", "http://shop/search", "http://shop/basket/",
            "http://shop/category/cars/", "http://shop/category/cars/2/",
            "http://shop/category/cars/x/", "http://shop/product/123456/#/?source=top_pick",
            "http://shop/download/" + "ab" * 16 + "/", None, "not a url at all"]
    types = ["pageView", "impression", "addToBasket", "removeFromBasket", "preview"]
    rows = [(f"{i}-{t}", t, u, {"item_id": "77"}) for i, u in enumerate(urls) for t in types]
    got, _ = _map(spark, rows)
    for t in types:
        assert got[f"0-{t}"]["pageType"] == "home"
        assert got[f"1-{t}"]["pageType"] == "unknown"
        assert got[f"2-{t}"]["pageType"] == "basket"
        assert (got[f"4-{t}"]["category"], got[f"4-{t}"]["page"]) == ("cars", 2)
        assert got[f"5-{t}"]["page"] is None
        assert got[f"7-{t}"]["downloadId"] == "ab" * 16
        assert got[f"8-{t}"]["pageType"] == "unknown" and got[f"9-{t}"]["pageType"] == "unknown"
        src = got[f"6-{t}"]["source"]
        assert src == ("top_pick" if t == "pageView" else None)
        pid = got[f"6-{t}"]["productId"]
        assert pid == ("77" if t in ("addToBasket", "removeFromBasket", "preview") else "123456")
