"""Times as numbers, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch; times without a zone and dates are taken as UTC."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts)
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, T.DateType):
        return day * 86_400_000_000
    seconds = F.extract(F.lit("SECONDS"), ts) * 1_000_000
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + seconds.cast("long")


def position(value: Column, kind: T.DataType) -> Column:
    """A place on a line: microseconds of a time, any other number as it is."""
    return micros(value, kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else value
