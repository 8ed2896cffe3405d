"""Minutes of solar wind from two streams, joined as they become final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

#: Column of a feed to column of the joined minutes.
MAGNETIC = {"observed_at_utc": "magnetic_observed_at_utc", "spacecraft": "magnetic_spacecraft", "is_active_source": "magnetic_source_is_active", "bt": "total_field_nanotesla", "bx_gsm": "bx_gsm_nanotesla", "by_gsm": "by_gsm_nanotesla", "bz_gsm": "bz_gsm_nanotesla", "quality_code": "magnetic_quality_code"}
PLASMA = {"observed_at_utc": "plasma_observed_at_utc", "spacecraft": "plasma_spacecraft", "is_active_source": "plasma_source_is_active", "proton_speed": "proton_speed_km_per_second", "proton_temperature": "proton_temperature_kelvin", "proton_density": "proton_density_per_cubic_cm", "quality_code": "plasma_quality_code"}


def _last(x: Column) -> Column:
    """A key that ascends where `x` descends, nulls last: for the least of structs."""
    return F.struct(x.isNull(), -x)


def minutes(feed: DataFrame, columns: dict[str, str], late: str) -> DataFrame:
    """(window, columns) of a feed: the most trustworthy row of each minute, once the watermark has passed it.

    The active source counts first, then the best quality, the newest snapshot and the latest time, then the name.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    trust = F.struct(
        _last(F.col("is_active_source").cast("int")).alias("a"), F.struct(F.col("quality_code").isNull(), "quality_code").alias("b"), _last(micros("snapshot_at_utc")).alias("c"), _last(micros("observed_at_utc")).alias("d"),
        F.struct(F.col("spacecraft").isNull(), "spacecraft").alias("e"), F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias("row"),
    )
    timed = feed.where("observed_at_utc IS NOT NULL").withColumn("at", F.col("observed_at_utc").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 minute")).agg(F.min(trust).alias("best")).select("window", "best.row.*")


def joined_minutes(magnetic: DataFrame, plasma: DataFrame, late: str = "30 minutes") -> DataFrame:
    """What `gold.space_weather_minute` gives, as a stream: a minute appears when both feeds' watermarks have passed it, without a
    plasma row if none has come. State is bounded by the time that rows may be late; a row that is later is dropped.
    """
    m, p = minutes(magnetic, MAGNETIC, late), minutes(plasma, PLASMA, late)
    joined = m.join(p, "window", "leftOuter")
    return joined.select(X.naive("window.start").alias("observation_minute_utc"), *MAGNETIC.values(), *PLASMA.values())
