"""Times as seconds since the epoch (double): formatting and parsing, whatever the session's zone.

``offset`` is the time zone's difference to UTC in seconds, as the formats print it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyweave.functions.strings import strip, to_double, to_int_hex

# Month and zone abbreviations of the mail date format, with the zones' hours.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {
    "jst": 9, "cct": 8, "kst": 9, "edt": -4, "est": -5, "cdt": -5, "cst": -6, "mdt": -6, "mst": -7, "pdt": -7, "pst": -8, "hdt": -9, "hst": -10,
}
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def wall_time() -> Column:
    return F.unix_micros(F.current_timestamp()) / 1e6


def local_difference(t: Column, zone: str | None = None) -> Column:
    """Seconds a zone (the session's unless named) is ahead of UTC at a time."""
    at = F.timestamp_seconds(F.floor(t))
    there = F.from_utc_timestamp(at, F.lit(zone) if zone else F.current_timezone())
    return F.unix_seconds(there) - F.unix_seconds(at)


def _local(t: Column, offset: int) -> Column:
    seconds = (F.floor(t) + F.lit(offset)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def calendar(t: Column, offset: int = 0) -> Column:
    """Struct of year, month, day, hour, minute, second, weekday (0 is Sunday), yearday (from 0)."""
    x = _local(t, offset)
    return F.struct(
        F.year(x).alias("year"), F.month(x).alias("month"), F.day(x).alias("day"), F.hour(x).alias("hour"), F.minute(x).alias("minute"),
        F.second(x).alias("second"), (F.dayofweek(x) - 1).alias("weekday"), (F.dayofyear(x) - 1).alias("yearday"),
    )


def make_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since the epoch of a UTC calendar time; NaN if there is no such time."""
    t = F.call_function("try_make_timestamp_ntz", year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return F.coalesce(F.expr("1D") * F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), t), F.lit(float("nan")))


def day_of_week(year: Column, month: Column, day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(F.make_date(year, month, day)) - 1


def _fraction(t: Column, digits: int) -> Column:
    if digits < 1:
        return F.lit("")
    part = F.least(F.floor((t - F.floor(t)) * F.lit(10.0**digits)), F.lit(10**digits - 1))
    return F.concat(F.lit("."), F.lpad(part.cast("string"), digits, "0"))


def _zone(offset: int, utc: str, colon: str) -> str:
    if offset == 0:
        return utc
    return f"{'-' if offset < 0 else '+'}{abs(offset) // 3600:02d}{colon}{abs(offset) % 3600 // 60:02d}"


def format_simple(t: Column, offset: int = 0, digits: int = 0) -> Column:
    return F.concat(F.date_format(_local(t, offset), "yyyy/MM/dd HH:mm:ss"), _fraction(t, digits))


def format_w3c(t: Column, offset: int = 0, digits: int = 0) -> Column:
    return F.concat(F.date_format(_local(t, offset), "yyyy-MM-dd'T'HH:mm:ss"), _fraction(t, digits), F.lit(_zone(offset, "Z", ":")))


def format_rfc1123(t: Column, offset: int = 0) -> Column:
    return F.concat(F.date_format(_local(t, offset), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" " + _zone(offset, "GMT", "")))


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(s, pattern, group), F.lit("")), F.lit("0")).try_cast("int")


def parse_date(s: Column) -> Column:
    """Seconds since the epoch: hexadecimal, a number with a unit (s, m, h, d), the W3C format with
    ``-``, ``/`` or ``:`` and an optional time, fraction and zone, or the mail date format. Anything
    else, and a date that does not exist, is NaN."""
    x = strip(s)
    nan = F.lit(float("nan"))
    number = r"^[-+]?[0-9]*\.?[0-9]+[\x00-\x20]*([smhdSMHD]?)[\x00-\x20]*$"
    unit = F.lower(F.regexp_extract(x, number, 1))
    scale = F.lit(1.0)
    for u, n in UNIT_SECONDS.items():
        scale = F.when(unit == u, float(n)).otherwise(scale)
    w3c = r"^([0-9]{4})[-/:]([0-9]{2})[-/:]([0-9]{2})(?:[T ]([0-9]{2})[-/:]([0-9]{2})[-/:]([0-9]{2})(\.[0-9]+)?[\x00-\x20]*(?:([-+])([0-9]{2}):?([0-9]{2})?|[zZ])?)?"
    zone = (_part(x, w3c, 9) * 3600 + _part(x, w3c, 10) * 60) * F.when(F.regexp_extract(x, w3c, 8) == "-", -1).otherwise(1)
    w3c_time = make_time(*[_part(x, w3c, i) for i in range(1, 7)]) + to_double(F.regexp_extract(x, w3c, 7)) - zone
    mail = r"^.{3}, *([0-9]{1,2}) +([A-Za-z]{3}) +([0-9]{4})(?: +([0-9]{2}):([0-9]{2}):([0-9]{2})[\x00-\x20]*(?:([-+])([0-9]{2})([0-9]{2})|([A-Za-z]{3}))?)?"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(x, mail, 2))).cast("int")
    hours = F.lit(0)
    for z, h in ZONES.items():
        hours = F.when(F.lower(F.regexp_extract(x, mail, 10)) == z, h).otherwise(hours)
    shift = (_part(x, mail, 8) * 3600 + _part(x, mail, 9) * 60) * F.when(F.regexp_extract(x, mail, 7) == "-", -1).otherwise(1) + hours * 3600
    mail_time = make_time(_part(x, mail, 3), month, *[_part(x, mail, i) for i in (1, 4, 5, 6)]) - shift
    value = (
        F.when(x.rlike("^0[xX]"), to_int_hex(x).cast("double"))
        .when(x.rlike(number), to_double(x) * scale)
        .when(x.rlike(w3c), w3c_time)
        .when(x.rlike(mail), mail_time)
        .otherwise(nan)
    )
    return F.when(s.isNotNull(), value)


def parse_digits(s: Column, offset: int = 0) -> Column:
    """``YYYY[MM[DD[hh[mm[ss]]]]]`` among any other characters; fewer than four digits is NaN."""
    d = F.substring(F.regexp_replace(s, "[^0-9]", ""), 1, 16)

    def part(at: int, size: int, default: int) -> Column:
        return F.when(F.length(d) >= at + size, F.substring(d, at + 1, size).try_cast("int")).otherwise(default)

    t = make_time(part(0, 4, 0), part(4, 2, 1), part(6, 2, 1), part(8, 2, 0), part(10, 2, 0), part(12, 2, 0)) - offset
    return F.when(s.isNotNull(), F.when(F.length(d) >= 4, t).otherwise(float("nan")))


def relative_expr(seconds: Column) -> Column:
    size = F.abs(seconds)
    return (
        F.when(size >= 86400, F.format_string("%.1f days", seconds / 86400))
        .when(size >= 3600, F.format_string("%.1f hours", seconds / 3600))
        .when(size >= 60, F.format_string("%.1f minutes", seconds / 60))
        .otherwise(F.format_string("%.1f seconds", seconds * F.lit(1.0)))
    )


def parse_relative(expr: Column, base_ms: Column) -> Column:
    """Milliseconds: ``-2D``, ``+3H``, ``10m``, ``5s``; a sign makes it relative to ``base_ms``."""
    x = F.lower(strip(expr))
    unit = F.regexp_extract(x, r"[.0-9]+ *([dhms])", 1)
    scale = F.lit(1.0)
    for u, n in UNIT_SECONDS.items():
        scale = F.when(unit == u, 1000.0 * n).otherwise(scale)
    value = to_double(x) * scale
    return (value + F.when(x.rlike("^[-+]"), base_ms).otherwise(0)).cast("long")
