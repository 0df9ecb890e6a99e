"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The words of a text, split at white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch, UTC, rounded half up."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000).cast("bigint")


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def tumbling(ts: Column, minutes: int) -> Column:
    """The start of the window that holds a time."""
    return F.window(ts, f"{minutes} minutes")["start"]


def sliding(ts: Column, minutes: int, step: int) -> Column:
    """The starts of all windows of `minutes`, one every `step`, that hold a time: a key for each."""
    last = F.window(ts, f"{step} minutes")["start"]
    return F.transform(F.sequence(F.lit(0), F.lit(-(-minutes // step) - 1)), lambda k: last - F.make_dt_interval(F.lit(0), F.lit(0), k * step))
