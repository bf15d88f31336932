"""Times as numbers and back, without a time zone in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, time: str) -> Column:
    """Microseconds of a date, a timestamp or a timestamp without zone; the latter by its wall clock, so no zone can fold it."""
    column, kind = F.col(time), df.schema[time].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    days = F.date_diff(column.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    if isinstance(kind, T.DateType):
        return days
    seconds = (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    return days + (F.hour(column) * 60 + F.minute(column)).cast("long") * 60_000_000 + seconds


def event_time(df: DataFrame, time: str) -> Column:
    """``time`` as the TIMESTAMP a watermark needs; a wall clock is taken as if it were UTC, so its order and its days stay."""
    return F.col(time) if isinstance(df.schema[time].dataType, T.TimestampType) else F.timestamp_micros(micros(df, time))


def like(df: DataFrame, time: str, instant: Column) -> Column:
    """Back from ``event_time`` to the kind of the column ``time``."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.TimestampType):
        return instant
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros(instant).cast("decimal(24,6)") / 1_000_000)
    return clock.cast(kind.simpleString())
