"""Durations, ages and time windows around an explicit ``as_of``."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_datetime(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def moment(value: str | datetime, like: T.DataType | None = None) -> Column:
    """Literal of the same timestamp type as the column it is compared with.

    Equal types keep the comparison free of casts, so that it reaches the scan.
    """
    text = as_datetime(value).isoformat(sep=" ")
    kind = "timestamp" if isinstance(like, T.TimestampType) else "timestamp_ntz"
    return F.lit(text).cast(kind)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole-second difference, counted in crossed second boundaries."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def hours_since(ts: Column, as_of: Column) -> Column:
    """Age of ``ts`` in hours at ``as_of``, two digits."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.round(micros / F.lit(3.6e9), 2)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def look_back(df: DataFrame, ts: str, as_of: str | datetime, days: int) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on."""
    start = as_datetime(as_of) - timedelta(days=days)
    return df.filter(F.col(ts) >= moment(start, df.schema[ts].dataType))


def look_ahead(df: DataFrame, day: str, as_of: str | datetime, days: int) -> DataFrame:
    """Rows whose date lies between ``as_of`` and ``days`` later, both included."""
    start: date = as_datetime(as_of).date()
    return df.filter(F.col(day).between(F.lit(start), F.lit(start + timedelta(days=days))))
