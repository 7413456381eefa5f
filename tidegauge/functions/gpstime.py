"""GPS seconds to and from UTC, as column expressions and as driver-side helpers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

GPS_EPOCH = 315964800
#: UTC days before which a leap second was inserted since the GPS epoch.
LEAP_DAYS = [
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01",
    "1994-07-01", "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
]
_UNIX = [int(dt.datetime.fromisoformat(d).replace(tzinfo=dt.UTC).timestamp()) for d in LEAP_DAYS]
#: GPS second at which each leap second begins.
_GPS = [u - GPS_EPOCH + i for i, u in enumerate(_UNIX)]

#: Detector prefixes and their time zones.
ZONES = {"G1": "Europe/Berlin", "H1": "America/Los_Angeles", "L1": "America/Chicago", "V1": "Europe/Rome", "K1": "Asia/Tokyo", "I1": "Asia/Kolkata", "C1": "America/Los_Angeles"}

FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd", "MMM d yyyy HH:mm:ss[.SSS]", "MMM d yyyy HH:mm", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "dd/MM/yyyy"]


def _steps(x: Column, thresholds: list[int]) -> Column:
    out = F.lit(0)
    for t in thresholds:
        out = out + F.when(x >= t, 1).otherwise(0)
    return out


def to_gps(ts: Column) -> Column:
    """GPS seconds (double, to the microsecond) of a timestamp in UTC."""
    us = F.unix_micros(ts.cast("timestamp"))
    return us / F.lit(1e6) - GPS_EPOCH + _steps(us, [u * 1_000_000 for u in _UNIX])


def to_gps_exact(ts: Column) -> Column:
    """GPS seconds as decimal(19,9)."""
    us = F.unix_micros(ts.cast("timestamp"))
    return ((us + (_steps(us, [u * 1_000_000 for u in _UNIX]) - GPS_EPOCH).cast("long") * F.lit(1_000_000).cast("long")).cast("decimal(25,6)") / F.lit(1_000_000)).cast("decimal(19,9)")


def from_gps(gps: Column, *, on_leap: str = "error") -> Column:
    """The UTC timestamp (to the microsecond) of GPS seconds; within a leap second an error, or null if ``on_leap`` is "null"."""
    g = gps.cast("double")
    inside = F.lit(False)
    for t in _GPS:
        inside = inside | ((g >= t) & (g < t + 1))
    ts = F.timestamp_micros(F.round((g + GPS_EPOCH - _steps(g, [t + 1 for t in _GPS])) * 1e6).cast("long"))
    bad = F.lit(None).cast("timestamp") if on_leap == "null" else F.raise_error(F.lit("this time is within a leap second")).cast("timestamp")
    return F.when(inside, bad).otherwise(ts)


def parse_time(text: Column) -> Column:
    """The timestamp of a keyword (now, today, tomorrow, yesterday) or of free text in one of FORMATS, else null."""
    low = F.lower(F.trim(text))
    day = F.current_date()
    out = F.when(low == "now", F.current_timestamp()).when(low == "today", day.cast("timestamp")).when(low == "tomorrow", F.date_add(day, 1).cast("timestamp")).when(low == "yesterday", F.date_sub(day, 1).cast("timestamp"))
    return F.coalesce(out, *[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS])


def timezone_of(prefix: Column) -> Column:
    """The IANA zone of a detector prefix, null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])[F.upper(prefix)]


def timezone_offset(prefix: Column, ts: Column) -> Column:
    """Seconds by which the detector's local time is ahead of UTC."""
    return F.unix_timestamp(F.from_utc_timestamp(ts.cast("timestamp"), timezone_of(prefix))) - F.unix_timestamp(ts.cast("timestamp"))


def gps(value: object) -> Decimal:
    """Driver-side GPS seconds of a number, date, datetime, tuple, or text."""
    if isinstance(value, int | float | Decimal):
        return Decimal(str(value))
    if isinstance(value, tuple | list):
        value = dt.datetime(*value)
    if isinstance(value, str):
        value = _text(value)
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    value = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)
    unix = Decimal((value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)) / 1_000_000
    return unix - GPS_EPOCH + sum(unix >= u for u in _UNIX)


#: Zone abbreviations in dates and their hours from UTC.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "JST": 9}


def _text(text: str) -> dt.datetime:
    now = dt.datetime.now(dt.UTC)
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    words = {"now": now, "today": day, "tomorrow": day + dt.timedelta(1), "yesterday": day - dt.timedelta(1)}
    if text.strip().lower() in words:
        return words[text.strip().lower()]
    head, _, tail = text.strip().rpartition(" ")
    zone = dt.UTC
    if tail.upper() in ABBREVIATIONS:
        zone, text = dt.timezone(dt.timedelta(hours=ABBREVIATIONS[tail.upper()])), head
    for f in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%b %d %Y %H:%M:%S.%f", "%b %d %Y %H:%M:%S", "%b %d %Y %H:%M", "%b %d %Y", "%B %d %Y", "%d %b %Y"):
        try:
            return dt.datetime.strptime(text.strip(), f).replace(tzinfo=zone)
        except ValueError:
            continue
    raise ValueError(f"cannot read {text!r} as a time")
