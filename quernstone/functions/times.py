"""RFC3339 times as whole seconds since 1970 and back, independent of the session's time zone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full date and time with an offset; lower-case t and z, and any number of fraction digits, are allowed.
PATTERN = r"^(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_RE = re.compile(PATTERN, re.ASCII)
_EPOCH = dt.datetime(1970, 1, 1)


def to_seconds(text: str) -> int:
    """Seconds of an RFC3339 time, its fraction dropped; ValueError if it isn't one. Second 60 counts as second 59, its leap second."""
    m = _RE.match(text)
    if not m:
        raise ValueError(f"not an RFC3339 date-time: {text!r}")
    year, month, day, hour, minute, second = map(int, m.groups()[:6])
    if second > 60:
        raise ValueError(f"not an RFC3339 date-time: {text!r}")
    at = dt.datetime(year, month, day, hour, minute, min(second, 59))
    zone = m[7]
    if zone in "Zz":
        offset = 0
    else:
        h, mi = int(zone[1:3]), int(zone[4:6])
        if h > 23 or mi > 59:
            raise ValueError(f"not an RFC3339 date-time: {text!r}")
        offset = (h * 3600 + mi * 60) * (-1 if zone[0] == "-" else 1)
    return round((at - _EPOCH).total_seconds()) - offset


def seconds_column(text: Column) -> Column:
    """The same in the JVM; null where the text isn't an RFC3339 time."""
    ok = text.rlike(PATTERN)
    field = lambda i: F.regexp_extract(text, PATTERN, i)
    number = lambda i: F.when(ok, field(i)).try_cast("int")
    # a time stamp without zone, built from fields: no session zone takes part
    second = F.least(number(6), F.lit(59))
    stamp = F.concat_ws("-", field(1), field(2), field(3))
    day = F.datediff(F.when(ok, stamp).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    zone = field(7)
    z_hour, z_minute = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    offset = F.when(F.lower(zone) == "z", F.lit(0)).otherwise((z_hour * 3600 + z_minute * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    sane = (number(4) < 24) & (number(5) < 60) & (number(6) < 61) & ((F.lower(zone) == "z") | ((z_hour < 24) & (z_minute < 60)))
    return F.when(ok & sane, day * 86400 + number(4) * 3600 + number(5) * 60 + second - offset)


def stamp(at: dt.datetime) -> Column:
    """A timestamp_ntz literal; one made from a Python datetime would be shifted by the session's zone."""
    return F.expr(f"timestamp_ntz'{at:%Y-%m-%d %H:%M:%S}'") if at.year >= 1000 else F.expr(f"timestamp_ntz'{at.year:04d}-{at:%m-%d %H:%M:%S}'")


def of_stamp(column: str | Column, zoned: bool = False) -> Column:
    """Whole seconds, floored, of a timestamp_ntz column, or of a timestamp, which is an instant."""
    c = F.col(column) if isinstance(column, str) else column
    if zoned:
        return F.floor(F.unix_micros(c) / F.lit(1_000_000.0)).cast("long")
    return F.floor(F.timestamp_diff("MICROSECOND", stamp(_EPOCH), c) / F.lit(1_000_000.0)).cast("long")


def formatted(seconds: Column) -> Column:
    """Seconds as an RFC3339 time in UTC, with +00:00."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.when(seconds.isNotNull(), F.concat(date, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("+00:00")))


def text_of(seconds: int) -> str:
    return (_EPOCH + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S") + "+00:00"
