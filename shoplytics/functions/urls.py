"""URL and path expressions.

All built-in, ANSI-safe (``try_parse_url`` yields NULL for text that is not a
URI instead of failing the task).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shop's route pattern; group 1 = page type, group 2 = the
# category / product / download id, group 3 = the page number.
ROUTE_PATTERN = r"^/([a-z]+)/([^/]+)?[/]?([^/]+)?.*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uri_path(url) -> Column:
    return F.try_parse_url(_c(url), F.lit("PATH"))


def uri_fragment(url) -> Column:
    """Raw fragment (text after ``#``), NULL when absent or not a URI."""
    return F.try_parse_url(_c(url), F.lit("REF"))


def query_value(url, key: str) -> Column:
    return F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(key))


def fragment_query_value(fragment, key: str) -> Column:
    """Parse a fragment as a relative URI and read one query value
    (``/#/?source=top_pick`` -> ``top_pick``)."""
    return F.try_parse_url(F.concat(F.lit("http://h"), _c(fragment)), F.lit("QUERY"), F.lit(key))


def route_group(path, n: int) -> Column:
    """Group ``n`` of the route pattern, NULL when the group did not take part
    or the path does not match."""
    p = _c(path)
    g = F.regexp_extract(p, ROUTE_PATTERN, n)
    return F.when(p.rlike(ROUTE_PATTERN), F.nullif(g, F.lit("")))


def basename_without_extension(path) -> Column:
    """``/a/b/cars.json`` -> ``cars``."""
    return F.regexp_extract(_c(path), r"([^/]*?)(\.[^./]*)?$", 1)
