"""Log timestamps and durations, in UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def log_text(ts: Column) -> Column:
    """Second precision, no zone suffix."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), ts), LOG_FORMAT)


def epoch_log_text(seconds: Column) -> Column:
    """The same from epoch seconds, fractions cut off."""
    return log_text(F.timestamp_seconds(F.floor(seconds)))


def from_log_text(text: Column) -> Column:
    """Back to a timestamp; NULL if the text has another form."""
    return F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(LOG_FORMAT + "X"))


def utc_instant(wall: Column) -> Column:
    """The instant a zone-less UTC timestamp stands for."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", origin, wall))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, two decimals."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000.0, 2)
