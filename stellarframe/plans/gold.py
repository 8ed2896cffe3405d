"""The derived tables, each a builder from history tables (or other derived ones) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import stats
from ..operators import timeline

COHORT = "iridium-33-debris"
COMPLETED = ("good", "bad", "failed")


def newest(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark prunes to one candidate per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _per_minute(history: DataFrame) -> DataFrame:
    rows = history.where(F.col("observed_at_utc").isNotNull()).withColumn("observation_minute_utc", X.trunc("minute", "observed_at_utc"))
    best = (F.desc_nulls_last("is_active_source"), F.asc_nulls_last("quality_code"), F.desc_nulls_last("snapshot_at_utc"), F.desc_nulls_last("observed_at_utc"), F.asc_nulls_last("spacecraft"))
    return newest(rows, ["observation_minute_utc"], *best)


def space_weather_minute(magnetic: DataFrame, plasma: DataFrame) -> DataFrame:
    """The most trustworthy magnetic row of each minute, with the plasma row of that minute if there is one."""
    m = _per_minute(magnetic).select(
        "observation_minute_utc", F.col("observed_at_utc").alias("magnetic_observed_at_utc"), F.col("spacecraft").alias("magnetic_spacecraft"), F.col("is_active_source").alias("magnetic_source_is_active"),
        F.col("bt").alias("total_field_nanotesla"), F.col("bx_gsm").alias("bx_gsm_nanotesla"), F.col("by_gsm").alias("by_gsm_nanotesla"), F.col("bz_gsm").alias("bz_gsm_nanotesla"), F.col("quality_code").alias("magnetic_quality_code"),
    )
    p = _per_minute(plasma).select(
        "observation_minute_utc", F.col("observed_at_utc").alias("plasma_observed_at_utc"), F.col("spacecraft").alias("plasma_spacecraft"), F.col("is_active_source").alias("plasma_source_is_active"),
        F.col("proton_speed").alias("proton_speed_km_per_second"), F.col("proton_temperature").alias("proton_temperature_kelvin"), F.col("proton_density").alias("proton_density_per_cubic_cm"), F.col("quality_code").alias("plasma_quality_code"),
    )
    return m.join(p, "observation_minute_utc", "left")


def orbit_features(silver: DataFrame) -> DataFrame:
    """Period, axis, altitudes, age and band of each current element; `silver` has the files' text columns."""
    number = lambda c: X.number(c).alias(c)
    typed = silver.select(
        "source_group", "object_name", X.number("norad_catalog_id", "long").alias("norad_catalog_id"), F.col("element_epoch_utc").try_cast("timestamp_ntz").alias("element_epoch_utc"),
        *map(number, ("inclination_degrees", "eccentricity", "mean_motion_revolutions_per_day", "bstar_drag_term")), X.naive(F.col("retrieved_at_utc").try_cast("timestamp")).alias("retrieved_at_utc"), "source_url",
    )
    good = typed.where("mean_motion_revolutions_per_day > 0 AND eccentricity >= 0 AND eccentricity < 1")
    axis = X.semi_major_axis("mean_motion_revolutions_per_day")
    made = good.withColumn("semi_major_axis_km", axis).withColumns({
        "orbital_period_minutes": F.lit(1440.0) / F.col("mean_motion_revolutions_per_day"),
        "mean_altitude_km": F.col("semi_major_axis_km") - X.EARTH_RADIUS_KM,
        "perigee_km": F.col("semi_major_axis_km") * (1 - F.col("eccentricity")) - X.EARTH_RADIUS_KM,
        "apogee_km": F.col("semi_major_axis_km") * (1 + F.col("eccentricity")) - X.EARTH_RADIUS_KM,
        "element_age_hours": X.boundaries("hour", "element_epoch_utc", "retrieved_at_utc"),
    })
    return made.select(
        "object_name", "norad_catalog_id", "source_group", "element_epoch_utc", "retrieved_at_utc", "element_age_hours", (F.col("element_age_hours") > X.STALE_HOURS).alias("is_stale_over_24_hours"),
        "inclination_degrees", "eccentricity", "mean_motion_revolutions_per_day", "bstar_drag_term", "orbital_period_minutes", "semi_major_axis_km", "mean_altitude_km", "perigee_km", "apogee_km",
        X.altitude_band("mean_altitude_km").alias("altitude_band"), "source_url",
    )


def orbit_band_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("altitude_band").agg(
        F.count(F.lit(1)).alias("object_count"), X.round_half_up(F.avg("mean_altitude_km"), 2).alias("average_altitude_km"), X.round_half_up(F.min("perigee_km"), 2).alias("minimum_perigee_km"),
        X.round_half_up(F.max("apogee_km"), 2).alias("maximum_apogee_km"), X.count_if(F.col("is_stale_over_24_hours")).alias("stale_object_count"),
    )


def orbit_snapshot_summary(orbital: DataFrame) -> DataFrame:
    return orbital.groupBy(X.naive("snapshot_at_utc").alias("snapshot_at_utc")).agg(
        F.count(F.lit(1)).alias("object_count"), F.countDistinct("norad_catalog_id").alias("unique_object_count"),
        X.round_half_up(F.avg("mean_motion_revolutions_per_day"), 5).alias("average_mean_motion"), X.round_half_up(F.avg("bstar_drag_term"), 8).alias("average_bstar"),
    )


def space_weather_snapshot_summary(magnetic: DataFrame, plasma: DataFrame) -> DataFrame:
    """Both histories are summed up by snapshot before they meet."""
    m = magnetic.groupBy("snapshot_at_utc").agg(F.count(F.lit(1)).alias("magnetic_row_count"), X.round_half_up(F.avg("bz_gsm"), 3).alias("average_bz_gsm"), X.round_half_up(F.min("bz_gsm"), 3).alias("minimum_bz_gsm"))
    p = plasma.groupBy("snapshot_at_utc").agg(F.count(F.lit(1)).alias("plasma_row_count"), X.round_half_up(F.avg("proton_speed"), 2).alias("average_proton_speed"))
    return m.join(p, "snapshot_at_utc", "left").select(X.naive("snapshot_at_utc").alias("snapshot_at_utc"), "magnetic_row_count", "plasma_row_count", "average_bz_gsm", "minimum_bz_gsm", "average_proton_speed")


def orbit_change(orbital: DataFrame) -> DataFrame:
    """Each element against the object's previous snapshot; a decay rate needs a positive interval."""
    motion = "mean_motion_revolutions_per_day"
    rows = orbital.where(F.col("norad_catalog_id").isNotNull()).select("object_name", "norad_catalog_id", "snapshot_at_utc", "element_epoch_utc", motion, "eccentricity", "inclination_degrees")
    before = {"previous_snapshot_at_utc": "snapshot_at_utc", "previous_element_epoch_utc": "element_epoch_utc", "previous_mean_motion": motion, "previous_eccentricity": "eccentricity"}
    lagged = timeline.previous(rows, "norad_catalog_id", ["snapshot_at_utc", "element_epoch_utc"], list(before.values())).withColumns({n: F.col(f"previous.{c}") for n, c in before.items()})
    kept = lagged.where(f"previous_mean_motion > 0 AND {motion} > 0")
    made = kept.select(
        "object_name", "norad_catalog_id", X.naive("previous_snapshot_at_utc").alias("previous_snapshot_at_utc"), X.naive("snapshot_at_utc").alias("snapshot_at_utc"),
        X.boundaries("minute", "previous_snapshot_at_utc", "snapshot_at_utc").alias("interval_minutes"), "previous_element_epoch_utc", "element_epoch_utc", (F.col("previous_element_epoch_utc") == F.col("element_epoch_utc")).alias("same_element_set"),
        "previous_mean_motion", motion, (F.col(motion) - F.col("previous_mean_motion")).alias("mean_motion_delta"), "previous_eccentricity", "eccentricity", (F.col("eccentricity") - F.col("previous_eccentricity")).alias("eccentricity_delta"), "inclination_degrees",
        X.semi_major_axis("previous_mean_motion").alias("previous_semi_major_axis_km"), X.semi_major_axis(motion).alias("current_semi_major_axis_km"),
    )
    change = F.col("current_semi_major_axis_km") - F.col("previous_semi_major_axis_km")
    return made.withColumn("semi_major_axis_change_km", change).withColumn("decay_rate_km_per_day", F.when(F.col("interval_minutes") > 0, F.lit(-1.0) * F.col("semi_major_axis_change_km") * F.lit(1440.0) / F.col("interval_minutes")))


def disturbance(bz: Column, speed: Column) -> Column:
    return F.when(bz < -5.0, "southward_bz").when(speed > 500.0, "fast_wind").otherwise("quiet")


def space_weather_hourly(minute: DataFrame) -> DataFrame:
    hourly = minute.groupBy(X.trunc("hour", "observation_minute_utc").alias("hour_utc")).agg(
        F.avg("bz_gsm_nanotesla").alias("average_bz_gsm"), F.min("bz_gsm_nanotesla").alias("minimum_bz_gsm"), F.avg("proton_speed_km_per_second").alias("average_proton_speed"),
        F.avg("proton_density_per_cubic_cm").alias("average_proton_density"), F.count(F.lit(1)).alias("minute_count"), F.count("bz_gsm_nanotesla").alias("minutes_with_bz"),
    )
    return hourly.withColumn("disturbance_level", disturbance(F.col("average_bz_gsm"), F.col("average_proton_speed")))


def weather_at_snapshots(orbital: DataFrame, minute: DataFrame, within_hours: int = 6) -> DataFrame:
    """Each snapshot of an object with the latest minute of weather that is not later, unless that is older than `within_hours`."""
    weather = minute.select("observation_minute_utc", "bz_gsm_nanotesla", "proton_speed_km_per_second")
    rows = orbital.select("object_name", "norad_catalog_id", "source_group", X.naive("snapshot_at_utc").alias("snapshot_at_utc"))
    met = timeline.as_of(rows, weather, "snapshot_at_utc", "observation_minute_utc", weather.columns[1:], within_s=within_hours * 3600)
    level = F.when(F.col("observation_minute_utc").isNotNull(), disturbance(F.col("bz_gsm_nanotesla"), F.col("proton_speed_km_per_second")))
    return met.withColumns({"weather_age_minutes": X.boundaries("minute", "observation_minute_utc", "snapshot_at_utc"), "disturbance_level": level})


def weather_last_day(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Each hour with the extremes of the `hours` up to and with it, and how many of them are known and how many disturbed."""
    calm = F.col("disturbance_level") == "quiet"
    wanted = {
        "lowest_bz_gsm": F.min("minimum_bz_gsm"), "highest_proton_speed": F.max("average_proton_speed"), "mean_bz_gsm": F.avg("average_bz_gsm"),
        "known_hours": F.count("hour_utc"), "disturbed_hours": X.count_if(~calm),
    }
    rows = hourly.select("hour_utc", "minimum_bz_gsm", "average_bz_gsm", "average_proton_speed", "disturbance_level")
    return timeline.rolling(rows, "hour_utc", hours * 3600, wanted).select("hour_utc", "disturbance_level", *wanted)


#: Totals of the population cube: all three, groups by band, each alone, and all.
CUBE = (("source_group", "altitude_band", "reliability_class"), ("source_group", "altitude_band"), ("source_group",), ("altitude_band",), ("reliability_class",), ())


def population_cube(index: DataFrame) -> DataFrame:
    """Objects by group, band and class, and their totals, in one read; `level` has a bit for each column that a total leaves out."""
    i, keys = F.col("orbit_reliability_index"), CUBE[0]
    rows = index.select("source_group", X.altitude_band("mean_altitude_km").alias("altitude_band"), "reliability_class", "orbit_reliability_index", "element_age_hours")
    cube = rows.groupingSets([[F.col(c) for c in part] for part in CUBE], *keys)
    return cube.agg(
        F.grouping_id(*keys).cast("int").alias("level"), F.count(F.lit(1)).alias("object_count"), X.count_if(F.col("element_age_hours") > X.STALE_HOURS).alias("stale_count"),
        X.round_half_up(F.min(i), 1).alias("minimum_index"), X.round_half_up(F.max(i), 1).alias("maximum_index"), F.sum(F.round(i * 10).cast("long")).alias("index_tenths"),
    )


def cube_level(cube: DataFrame, *keys: str) -> DataFrame:
    """The rows of one level of the cube; `keys` are the columns that it tells apart."""
    level = sum(1 << (2 - k) for k, c in enumerate(CUBE[0]) if c not in keys)
    return cube.where(F.col("level") == level).select(*keys, "object_count", "stale_count", "minimum_index", "maximum_index", X.round_half_up(F.col("index_tenths") / F.lit(10.0) / F.col("object_count"), 1).alias("average_index"))


def current_objects(orbital: DataFrame) -> DataFrame:
    """Rows of each group's latest snapshot that have an epoch and a motion; one row per group is broadcast as sized by Spark."""
    latest = orbital.groupBy("source_group").agg(F.max("snapshot_at_utc").alias("snapshot_at_utc"))
    rows = orbital.join(latest, ["source_group", "snapshot_at_utc"]).where("element_epoch_utc IS NOT NULL AND mean_motion_revolutions_per_day > 0")
    return rows.withColumn("element_age_hours", X.hours_by_minutes("element_epoch_utc", X.naive("snapshot_at_utc"))).withColumn("mean_altitude_km", X.altitude("mean_motion_revolutions_per_day"))


def element_freshness(orbital: DataFrame) -> DataFrame:
    return current_objects(orbital).select("object_name", "norad_catalog_id", "source_group", "element_epoch_utc", "element_age_hours", (F.col("element_age_hours") > X.STALE_HOURS).alias("is_stale_over_24_hours"), "mean_altitude_km", X.altitude_band("mean_altitude_km").alias("altitude_band"))


def freshness_by(freshness: DataFrame, key: str, with_maximum: bool) -> DataFrame:
    stale = X.count_if(F.col("is_stale_over_24_hours"))
    largest = [X.round_half_up(F.max("element_age_hours"), 2).alias("maximum_age_hours")] * with_maximum
    plain = [F.count(F.lit(1)).alias("object_count"), *largest, stale.alias("stale_count"), X.percent(stale, F.count(F.lit(1))).alias("stale_percent")]
    ages = {"median_age_hours": ("element_age_hours", 0.5), "p90_age_hours": ("element_age_hours", 0.9)}
    return stats.summary(freshness, [key], plain, ages).withColumns({n: X.round_half_up(n, 2) for n in ages})


def freshness_by_group(freshness: DataFrame) -> DataFrame:
    return freshness_by(freshness, "source_group", True)


def freshness_by_band(freshness: DataFrame) -> DataFrame:
    return freshness_by(freshness, "altitude_band", False)


def weather_context(hourly: DataFrame) -> DataFrame:
    """One row: the factor of the hours from three before the last one on."""
    last = hourly.agg(F.max("hour_utc").alias("last"))  # one row
    recent = hourly.join(F.broadcast(last), F.col("hour_utc") >= F.col("last") - F.expr("INTERVAL 3 HOURS"))
    level = F.col("disturbance_level")
    factor = F.when(X.count_if(level == "southward_bz") > 0, F.lit(0.8)).when(X.count_if(level == "fast_wind") > 0, F.lit(0.9)).otherwise(F.lit(1.0))
    return recent.agg(factor.alias("environment_factor"), F.max("hour_utc").alias("context_through_hour"), F.count(F.lit(1)).alias("hours_considered"))


def orbit_reliability_index(orbital: DataFrame, hourly: DataFrame) -> DataFrame:
    """Freshness and drag scores times the weather factor; classes are decided before rounding."""
    scored = current_objects(orbital).withColumn("fresh", X.freshness_score("element_age_hours")).withColumn("drag", X.drag_safety_score("mean_altitude_km")).withColumn("base", X.base_score("fresh", "drag"))
    rated = scored.crossJoin(F.broadcast(weather_context(hourly))).withColumn("index", F.col("base") * F.col("environment_factor"))  # one row beside all
    r = X.round_half_up
    return rated.select(
        "object_name", "norad_catalog_id", "source_group", r("element_age_hours", 2).alias("element_age_hours"), r("mean_altitude_km", 2).alias("mean_altitude_km"), r("fresh", 1).alias("freshness_score"), r("drag", 1).alias("drag_safety_score"),
        "environment_factor", "context_through_hour", r("base", 1).alias("base_score"), r("index", 1).alias("orbit_reliability_index"), X.reliability_class("index").alias("reliability_class"),
    )


def reliability_class_summary(index: DataFrame) -> DataFrame:
    i = "orbit_reliability_index"
    plain = [F.count(F.lit(1)).alias("object_count"), X.round_half_up(F.min(i), 1).alias("minimum_index"), X.round_half_up(F.max(i), 1).alias("maximum_index")]
    return stats.summary(index, ["reliability_class"], plain, {"median_index": (i, 0.5)}).withColumn("median_index", X.round_half_up("median_index", 1))


def reliability_group_summary(index: DataFrame) -> DataFrame:
    i, c = "orbit_reliability_index", F.col("reliability_class")
    plain = [F.count(F.lit(1)).alias("object_count"), X.round_half_up(F.avg(i), 1).alias("average_index"), X.count_if(c == "low").alias("low_count"), X.count_if(c == "reduced").alias("reduced_count")]
    return stats.summary(index, ["source_group"], plain, {"median_index": (i, 0.5)}).withColumn("median_index", X.round_half_up("median_index", 1))


def sw_index_daily(indices: DataFrame) -> DataFrame:
    """The newest version of each day; Kp comes in tenths, Ap does not."""
    top = newest(indices, ["observation_date"], F.desc_nulls_last("snapshot_at_utc"), F.asc_nulls_last("kp_sum"))
    tenths = lambda c: X.round_half_up(F.col(c) / F.lit(10.0), 2).alias(c)
    return top.select("observation_date", *[tenths(f"kp{i}") for i in range(1, 9)], tenths("kp_sum"), "ap_avg", "sunspot_number", "f10_7_observed", "f10_7_data_type", X.naive("snapshot_at_utc").alias("last_retrieved_at_utc"))


def satnogs_activity(observations: DataFrame) -> DataFrame:
    """Days of the newest version of each observation; no rate where nothing is completed."""
    rows = observations.where("observation_id IS NOT NULL").select("observation_id", "start_utc", "status", "norad_catalog_id", "station_id", "snapshot_at_utc")
    top = newest(rows, ["observation_id"], F.desc_nulls_last("snapshot_at_utc"), F.asc_nulls_last("status"))
    status = F.col("status")
    good, done = X.count_if(status == "good"), X.count_if(status.isin(*COMPLETED))
    return top.groupBy(F.col("start_utc").cast("date").alias("observation_date")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.countDistinct("norad_catalog_id").alias("distinct_satellites"), F.countDistinct("station_id").alias("distinct_stations"), good.alias("good_count"), done.alias("completed_count"),
        X.count_if(status == "future").alias("scheduled_count"), X.percent(good, done).alias("good_percent_of_completed"),
    )


def debris_population(features: DataFrame, cohort: str = COHORT) -> DataFrame:
    rows = features.where(F.col("source_group") == cohort)
    return rows.select("object_name", "norad_catalog_id", X.round_half_up("mean_altitude_km", 1).alias("mean_altitude_km"), X.round_half_up("eccentricity", 6).alias("eccentricity"), "bstar_drag_term", "element_age_hours", "element_epoch_utc", X.naive("retrieved_at_utc").alias("snapshot_at_utc"))
