"""Date and time functions. Times are ISO-8601 text in UTC at the edges and milliseconds inside.

Times without a zone are UTC, whatever the session's zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each scale (fixed values; a month is a twelfth of 365 days).
SCALES = {"MILLIS": 1, "SECONDS": 1000, "MINUTES": 60_000, "HOURS": 3_600_000, "DAYS": 86_400_000, "WEEKS": 604_800_000, "MONTHS": 2_628_000_000, "YEARS": 31_536_000_000}


def _instant(c: Column) -> Column:
    """A timestamp, or the one that ISO text names, in UTC if it names no zone; null for bad text."""
    text = c.cast("string")
    date = text.rlike(r"^\s*[+-]?\d{4,6}(-\d{1,2}){0,2}\s*$")
    zoned = text.rlike(r"(?i)(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2}){0,2}|[A-Za-z]+/[A-Za-z_]+)\s*$") & ~date
    whole = F.when(zoned, text).otherwise(F.concat(F.when(date, F.concat(text.try_cast("date").cast("string"), F.lit("T00:00:00"))).otherwise(text), F.lit("Z")))
    return F.when(F.typeof(c) == "timestamp", c.try_cast("timestamp")).otherwise(F.try_to_timestamp(whole))


def _wall(ms: Column) -> Column:
    """The UTC wall clock, without a zone, at so many milliseconds since 1970."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms.cast("decimal(18,0)") / 1000).cast("decimal(18,6)"))


def to_millis(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp or ISO text; null for bad text."""
    return F.unix_millis(_instant(c))


def from_millis(ms: Column) -> Column:
    text = _wall(ms).cast("string")
    millis = F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\.\d+$", ""), " ", "T"), F.lit("."), millis, F.lit("Z"))


def parse_date_time(c: Column, *formats: str) -> Column:
    """ISO text by the first format that parses, else null. Parts of a format in ``[]`` may be missing."""

    def millis(pattern: str) -> Column:
        at = F.try_to_timestamp(c, F.lit(pattern))
        if re.search("[VvzOXxZ]", re.sub("'[^']*'", "", pattern)):
            return F.unix_millis(at)
        return F.unix_millis(F.from_utc_timestamp(at, F.current_timezone()))

    return from_millis(F.coalesce(*[millis(f) for f in formats]))


def format_date_time(c: Column, pattern: str, zone: str = "UTC") -> Column:
    """ISO text in another pattern, as the clocks of ``zone`` show it; bad text gives null."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), _wall(to_millis(c))), pattern)


def current_time(pattern: str | None = None, zone: str = "UTC", at: Column | None = None) -> Column:
    """Now (or ``at``, so that runs can be repeated) as ISO text or in a pattern."""
    now = F.current_timestamp() if at is None else at
    return from_millis(to_millis(now)) if pattern is None else format_date_time(now, pattern, zone)


def _scale(name: str) -> int:
    if name not in SCALES:
        raise ValueError(f"no time scale {name!r}; there are {', '.join(SCALES)}")
    return SCALES[name]


def elapsed(a: Column, b: Column, scale: str) -> Column:
    """Whole units between two times, whichever is first."""
    return F.floor(F.abs(to_millis(a) - to_millis(b)) / _scale(scale)).cast("bigint")


def new_date_time(c: Column, n: Column, scale: str) -> Column:
    return from_millis((to_millis(c) + n * _scale(scale)).cast("bigint"))


def is_between(start: Column, end: Column, c: Column) -> Column:
    """Whether a time lies between two; null where one is null, an error where one is bad text."""

    def checked(x: Column) -> Column:
        bad = x.isNotNull() & (x.cast("string") != "") & to_millis(x).isNull()
        return F.when(bad, F.raise_error(F.lit("not a time"))).otherwise(to_millis(x))

    return checked(c).between(checked(start), checked(end))


def parse_unix_time(n: Column, unit: str) -> Column:
    """ISO text of a count of s, ms, us or ns since 1970."""
    per = {"s": (1000, 1), "ms": (1, 1), "us": (1, 1000), "ns": (1, 1_000_000)}
    times, parts = per[unit]
    return from_millis(F.floor(n.cast("decimal(30,3)") * times / parts).cast("bigint"))


def split_time(c: Column) -> Column:
    """[year, month, day, hour, minute, second, nanosecond] in UTC."""
    at = _instant(c)
    t = _wall(F.unix_millis(at))
    nanos = F.pmod(F.unix_micros(at), F.lit(1_000_000)) * 1000
    return F.array(*[f(t).cast("bigint") for f in (F.year, F.month, F.dayofmonth)], *[F.extract(F.lit(p), t).cast("bigint") for p in ("hour", "minute", "second")], nanos.cast("bigint"))
