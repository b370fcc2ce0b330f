"""Time stamps as numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(name: str) -> Column:
    """Microseconds since 1970 of a time stamp without zone (or of one with a zone, in the session's)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({name} AS TIMESTAMP_NTZ))")


def epoch(value: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A number as it is, other text by the pattern, as seconds since 1970; null if neither."""
    parsed = F.try_to_timestamp(value, F.lit(pattern))
    return F.coalesce(value.try_cast("long"), F.unix_timestamp(parsed))
