"""Column expressions over instants, days, freshness and ages. The clock is always an argument."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def acq_instant(day: Column, hhmm: Column) -> Column:
    """UTC instant of a date and a time such as '421.0'."""
    clock = F.lpad(hhmm.try_cast("double").cast("int").cast("string"), 4, "0")
    return F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HHmm"))


# Words and letters for the three levels.
LOW, NOMINAL, HIGH = ("l", "low"), ("n", "nominal"), ("h", "high")


def conf_norm(c: Column) -> Column:
    """Low, nominal or high; numbers below 30 are low and below 80 nominal; empty and junk nominal."""
    word, number = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.trim(c).try_cast("double")
    return F.when(word.isin(*LOW), "low").when(word.isin(*NOMINAL), "nominal").when(word.isin(*HIGH), "high").when(number < 30, "low").when(number >= 80, "high").otherwise("nominal")


def to_epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def http_date(text: Column) -> Column:
    """B16: 'Mon, 17 Aug 2026 06:56:00 GMT' to an instant; junk to null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", ""), " GMT$", "")
    return F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss"))


def run_instant(stamp: Column) -> Column:
    """B17: 'YYYYMMDD_HHMMSS' to an instant."""
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))


def member_instant(name: Column) -> Column:
    """Instant in a raster member's name."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


def cycle_name(ts: Column) -> Column:
    """Workspace name of a weather cycle."""
    return F.concat(F.lit("hrrr_"), F.date_format(ts, "yyyyMMdd_HH"))


def hours_between(ts: Column, now: Column) -> Column:
    return (F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / 3_600_000


def freshness(ts: Column, now: Column) -> Column:
    """Fresh under 12 h, recent under 48 h, else stale; none without an instant."""
    age = hours_between(ts, now)
    return F.when(ts.isNull(), "none").when(age < 12, "fresh").when(age < 48, "recent").otherwise("stale")


def feed_grade(ts: Column, now: Column, ok_hours: float, warn_hours: float) -> Column:
    age = hours_between(ts, now)
    return F.when(ts.isNull(), "unknown").when(age < ok_hours, "ok").when(age < warn_hours, "warn").otherwise("late")


def is_stale(ts: Column, now: Column, hours: float) -> Column:
    return hours_between(ts, now) >= hours


def age_badge(ts: Column, now: Column) -> Column:
    """B24: '5h' or '3d'."""
    hours = F.floor(hours_between(ts, now))
    return F.when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))


def visible_at(acq: Column, t: Column, days: int = 3) -> Column:
    """Shown from its instant until `days` later, both ends included."""
    age = hours_between(acq, t)
    return (age >= 0) & (age <= 24 * days)


def age_position(acq: Column, t: Column) -> Column:
    """Place on the two-day colour ramp, 0 new to 1 old."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), hours_between(acq, t) / 48))


def low_weight(confidence: Column) -> Column:
    return F.when(confidence == "low", 0.45).otherwise(0.8)


@cache
def zone_names() -> tuple[str, ...]:
    """All zones that the time functions accept, as the runtime's zone database lists them."""
    spark = SparkSession.getActiveSession()
    return tuple(sorted(spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")))


def known_zone(zone: Column, zones: Sequence[str] | None = None) -> Column:
    """The zone if it is one of `zones` (all there are if none are given), else UTC."""
    return F.when(zone.isin(*(zones or zone_names())), zone).otherwise("UTC")


def local_day(ts_utc: Column, zone: Column) -> Column:
    """Calendar day in a zone (a column) of an instant kept as UTC wall time."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, ts_utc))


def op_date_heading(day: Column, zone: Column, now_utc: Column) -> Column:
    """Today, Yesterday or the date, in the fire's zone."""
    today = local_day(now_utc, zone)
    return F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").otherwise(day.cast("string"))


# Labels of the WMO codes, and the codes from the most severe down.
WMO_LABELS = {
    "Clear": [0], "Mostly clear": [1], "Partly cloudy": [2], "Overcast": [3], "Fog": [45, 48], "Drizzle": [51, 53, 55, 56, 57],
    "Rain": [61, 63, 66, 80, 81], "Heavy rain": [65, 67, 82], "Snow": [71, 73, 75, 77, 85, 86], "Thunderstorm": [95, 96, 99],
}
WMO_SEVERITY = [95, 96, 99, 65, 67, 82, 71, 73, 75, 77, 85, 86, 61, 63, 66, 80, 81, 51, 53, 55, 56, 57, 45, 48, 3, 2, 1, 0]


def wmo_label(code: Column, labels: dict[str, list[int]] = WMO_LABELS, other: str = "Cloudy") -> Column:
    return F.coalesce(*(F.when(code.isin(codes), label) for label, codes in labels.items()), F.lit(other))


def wmo_severity(code: Column, worst_first: Sequence[int] = WMO_SEVERITY) -> Column:
    """0 for the worst; unknown codes come last."""
    place = F.array_position(F.array(*map(F.lit, worst_first)), code.cast("int"))
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(worst_first)).otherwise(place - 1).cast("int")
