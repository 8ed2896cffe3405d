"""Column expressions that the plans share: rounding, boundary differences, clamps, orbit geometry, classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gravitational parameter in km^3/s^2 and equatorial radius in km, fixed values.
MU = 398600.4418
EARTH_RADIUS_KM = 6378.137
STALE_HOURS = 24


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: Column | str, digits: int) -> Column:
    """Half away from zero on the double itself; Spark's round goes through decimal text and differs at ties."""
    scale = float(10**digits)
    x = col(x)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / F.lit(scale)


def naive(x: Column | str) -> Column:
    """An instant as the UTC wall clock time, without a zone."""
    return col(x).cast("timestamp_ntz")


def trunc(unit: str, x: Column | str) -> Column:
    """Start of the minute, hour, day or week, without a zone."""
    return F.date_trunc(unit, col(x)).cast("timestamp_ntz")


def epoch_seconds(x: Column | str) -> Column:
    """Seconds since 1970 of a UTC time, as charts and scrapers take them; with fractions."""
    return F.unix_micros(col(x).cast("timestamp")) / F.lit(1e6)


def boundaries(unit: str, start: Column | str, end: Column | str) -> Column:
    """How many unit boundaries lie between two times: 00:59 to 01:00 is one hour."""
    return F.timestamp_diff(unit.upper(), trunc(unit, start), trunc(unit, end))


def hours_by_minutes(start: Column | str, end: Column | str) -> Column:
    return boundaries("minute", start, end).cast("double") / F.lit(60.0)


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null stays null, which least and greatest alone would turn into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def semi_major_axis(mean_motion: Column | str) -> Column:
    """km, from revolutions a day; null unless these are positive."""
    n = col(mean_motion)
    return F.when(n > 0, F.pow(F.lit(MU) / F.pow(n * F.lit(2.0) * F.lit(math.pi) / F.lit(86400.0), F.lit(2.0)), F.lit(1.0 / 3.0)))


def altitude(mean_motion: Column | str) -> Column:
    return semi_major_axis(mean_motion) - F.lit(EARTH_RADIUS_KM)


def altitude_band(km: Column | str) -> Column:
    km = col(km)
    return F.when(km < 300, "very_low_leo").when(km < 600, "lower_leo").when(km < 2000, "upper_leo").otherwise("above_leo")


def freshness_score(age_hours: Column | str) -> Column:
    return F.lit(100.0) * clamp01(F.lit(1.0) - col(age_hours) / F.lit(48.0))


def drag_safety_score(altitude_km: Column | str) -> Column:
    return F.lit(100.0) * clamp01((col(altitude_km) - F.lit(300.0)) / F.lit(500.0))


def base_score(freshness: Column | str, drag: Column | str) -> Column:
    return F.lit(0.55) * col(freshness) + F.lit(0.45) * col(drag)


def reliability_class(index: Column | str) -> Column:
    index = col(index)
    return F.when(index >= 80, "high").when(index >= 60, "moderate").when(index >= 40, "reduced").otherwise("low")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, null for an empty whole."""
    return round_half_up(F.try_divide(F.lit(100.0) * part, whole.cast("double")), digits)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def text_or_null(x: Column | str) -> Column:
    """Trimmed text; blank, None and null become null."""
    t = F.trim(col(x).cast("string"))
    return F.when(~F.lower(t).isin("", "none", "null"), t)


def number(x: Column | str, kind: str = "double") -> Column:
    t = text_or_null(x)
    return t.try_cast("double").cast("long") if kind == "long" else t.try_cast(kind)


def flag(x: Column | str) -> Column:
    """Text or number to boolean; `false`, `no` and 0 are false."""
    t = F.lower(text_or_null(x))
    return F.when(t.isNotNull(), ~t.isin("false", "f", "no", "n", "0", "0.0"))


def content_hash(*columns: str) -> Column:
    """One hash of typed values; a null differs from an empty string and keeps its place."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in columns])), 256)


def snapshot_of(path: Column | str) -> Column:
    """The UTC stamp in a file's name, such as stations_20260830T120000Z.csv."""
    stamp = F.regexp_extract(col(path), r"(\d{8}T\d{6}Z)\.[a-z]+$", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss'Z'"))
