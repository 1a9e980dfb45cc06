"""Event-time conversions that do not depend on the session time zone.

Event times are wall-clock UTC stored as TIMESTAMP_NTZ.  Casting them to
TIMESTAMP (needed for watermarks and epoch numbers) would read the wall clock
in the session zone; :func:`to_instant` reads it in UTC explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_instant(ts) -> Column:
    """TIMESTAMP_NTZ wall clock (UTC) -> TIMESTAMP, zone-independent."""
    c = _c(ts)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def epoch_millis(ts) -> Column:
    """Epoch milliseconds (truncated) of a UTC wall-clock TIMESTAMP_NTZ."""
    return F.unix_millis(to_instant(ts))


def epoch_micros(ts) -> Column:
    return F.unix_micros(to_instant(ts))
