"""Time expressions: ISO weeks and local days in a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zone of week labels and day buckets where none is given.
DEFAULT_ZONE = "Asia/Bangkok"


def local(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    """A naive UTC timestamp as the naive local time of a zone, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def iso_week(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    """The label `YYYY-Www` of the ISO year and week of a time in a zone."""
    here = local(ts, zone)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), here).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), here).cast("string"), 2, "0"))


def local_day(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.to_date(local(ts, zone))


def stamp(text: Column) -> Column:
    """A naive UTC time from a stamp `2026-09-09 15:00:00.100Z`, with or without its fraction, its Z, or a T for the blank; else null."""
    plain = F.replace(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), F.lit("T"), F.lit(" "))
    whole = plain.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?Z?$")
    return F.when(whole, F.regexp_replace(plain, "Z$", "").try_cast("timestamp_ntz"))


def stamped(ts: Column) -> Column:
    """A naive UTC time as a stamp, to the millisecond; stamps sort as their times do."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS'Z'")


def ago(ms: Column) -> Column:
    """How long ago, in whole seconds, minutes or hours."""
    seconds = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5))
    nearest = lambda unit: F.floor(seconds / unit + 0.5).cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s ago"))).when(seconds < 3600, F.concat(nearest(60), F.lit(" m ago"))).otherwise(F.concat(nearest(3600), F.lit(" h ago")))
