"""Key-shape predicates and id construction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplytics.functions.times import epoch_millis

# Accepted key shapes.
SHOPPER_ID = r"^[a-f0-9]{32}$"
CHECKOUT_ID = r"^[a-f0-9]{32,60}$"
PRODUCT_ID = r"^[0-9]{6,15}$"
CATEGORY_NAME = r"^[a-z]+$"
PAGE_NUMBER = r"^[0-9]{1,3}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_shopper_id(c) -> Column:
    return _c(c).rlike(SHOPPER_ID)


def is_checkout_id(c) -> Column:
    return _c(c).rlike(CHECKOUT_ID)


def is_product_id(c) -> Column:
    return _c(c).rlike(PRODUCT_ID)


def is_category_name(c) -> Column:
    return _c(c).rlike(CATEGORY_NAME)


def is_page_number(c) -> Column:
    return _c(c).rlike(PAGE_NUMBER)


def checkout_id(shopper, event_ts) -> Column:
    """Checkout id = shopper id followed by the epoch milliseconds of the
    (event) time the checkout started."""
    return F.concat(_c(shopper).cast("string"),
                    epoch_millis(_c(event_ts)).cast("string"))


def new_shopper_id() -> Column:
    """A random 32-hex shopper id (non-deterministic by design)."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
