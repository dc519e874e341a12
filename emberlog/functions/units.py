"""Unit conversions and axis labels of the chart series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kilobytes(column: str) -> str:
    """SQL for bytes -> KB, truncated toward zero."""
    return f"{column} div 1024"


def millis_of_nanos(column: str) -> str:
    """SQL for nanoseconds -> milliseconds, truncated toward zero."""
    return f"{column} div 1000000"


def axis_label(millis: Column, time_zone: str = "UTC") -> Column:
    """Epoch millis -> ``MM/dd HH:mm`` in ``time_zone``, whatever the session's zone is."""
    utc = F.timestamp_add("MILLISECOND", millis, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    text = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc).cast("string")
    return F.concat(
        F.substring(text, 6, 2), F.lit("/"), F.substring(text, 9, 2), F.lit(" "),
        F.substring(text, 12, 5),
    )
