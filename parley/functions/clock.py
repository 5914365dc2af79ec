"""Time expressions. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from ``a`` to ``b``, toward zero."""
    d = (micros(b) - micros(a)) / 1_000_000
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("long")


def pad2(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour on; negative or NaN shows zero."""
    safe = F.when(seconds.isNull() | F.isnan(seconds.cast("double")), 0.0).otherwise(seconds)
    s = F.floor(F.greatest(safe, F.lit(0.0))).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    short = F.concat_ws(":", pad2(m), pad2(r))
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), short)).otherwise(short)


def clock_range(start: Column, end: Column) -> Column:
    a, b = clock(start), clock(end)
    return F.when(a == b, a).otherwise(F.concat_ws("–", a, b))


def elapsed(seconds: Column) -> Column:
    """``HH:MM:SS`` with hours growing past two digits; NULL shows a dash."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    h = F.floor(s / 3600).cast("long")
    hh = F.when(h < 100, pad2(h)).otherwise(h.cast("string"))
    text = F.concat_ws(":", hh, pad2(F.floor((s % 3600) / 60).cast("long")), pad2(s % 60))
    return F.when(seconds.isNull(), "—").otherwise(text)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def duration_text(seconds: Column) -> Column:
    """Coarse duration such as ``30 s``, ``55 min`` or ``1 h 05 min``."""
    s = seconds.cast("double")
    mins = half_up(s / 60)
    h, m = F.floor(mins / 60).cast("long"), mins % 60
    hours = F.concat(h.cast("string"), F.lit(" h"))
    return (
        F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | (s < 0), "")
        .when(s < 60, F.concat(half_up(s).cast("string"), F.lit(" s")))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min")))
        .when(m > 0, F.concat(hours, F.lit(" "), pad2(m), F.lit(" min")))
        .otherwise(hours)
    )


def relative_age(status: Column, started: Column, ended: Column, now: Column) -> Column:
    """Calendar-day-aware age such as ``5 min ago`` or ``yesterday``."""
    at = F.coalesce(ended, started)
    secs = F.greatest(seconds_between(at, now), F.lit(0))
    mins = F.floor(secs / 60).cast("long")
    days = F.datediff(now.cast("date"), at.cast("date"))
    return (
        F.when(status == "recording", "recording now")
        .when(secs < 60, "just concluded")
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min ago")))
        .when(days == 0, F.concat(F.floor(mins / 60).cast("string"), F.lit(" hours ago")))
        .when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def utc_text(ts: Column) -> Column:
    """Fixed-width UTC milliseconds, so that text order is time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_offset(text: Column) -> Column:
    """Any-offset RFC 3339 text as an instant; NULL when malformed or without an offset."""
    form = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
    return F.when(text.rlike(form), F.try_to_timestamp(F.upper(text)))
