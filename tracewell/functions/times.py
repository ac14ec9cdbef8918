"""Instants: parsing, parts, arithmetic in seconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_slashed(text: Column) -> Column:
    """``2016/1/31 00:12:57`` to a timestamp; null when it is no date."""
    return F.try_to_timestamp(text, F.lit("yyyy/M/d H:m:s"))


def iso(ts: Column) -> Column:
    """Microsecond ISO text in UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parts(ts: Column) -> dict[str, Column]:
    """Calendar fields; weekday 0 is Monday."""
    ts = ts.cast("timestamp")
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts),
        "second": F.second(ts), "microsecond": F.pmod(F.unix_micros(ts), F.lit(1000000)), "julday": F.dayofyear(ts),
        "weekday": F.weekday(ts),
    }


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + F.round(seconds * 1e6).cast("bigint"))
