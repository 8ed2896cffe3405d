"""Derived tables on small fixtures."""

import pytest
from pyspark.sql import functions as F

from stellarframe.functions import expr as X
from stellarframe.plans import gold

from .helpers import at, index, magnetic, observation, orbit, plasma, rows, seen


def activity(spark, *given):
    return gold.satnogs_activity(rows(spark, "satnogs_observation_history", *given)).collect()


def test_newest_version_of_an_observation_counts_once(spark):
    (r,) = activity(spark, *[observation(snapshot_at_utc=seen(30, h), status=s) for h, s in ((12, "future"), (14, "unknown"), (16, "good"))])
    assert (r.observation_count, r.good_count, r.completed_count, r.scheduled_count, r.good_percent_of_completed) == (1, 1, 1, 0, 100.0)


def test_a_later_verdict_replaces_the_first(spark):
    (r,) = activity(spark, observation(status="good"), observation(snapshot_at_utc=seen(30, 5), status="failed"))
    assert (r.good_count, r.completed_count) == (0, 1)


def test_no_rate_without_completed_passes(spark):
    (r,) = activity(spark, *[observation(observation_id=i, status="future") for i in range(3)])
    assert (r.observation_count, r.completed_count, r.scheduled_count, r.good_percent_of_completed) == (3, 0, 3, None)


def test_rate_and_distinct_counts(spark):
    (r,) = activity(spark, *[observation(observation_id=i, status=s, norad_catalog_id=n, station_id=t) for i, (s, n, t) in enumerate([("good", 100, 7), ("good", 100, 8), ("bad", 200, 7), ("failed", 200, 7), ("future", 200, 7)])])
    assert (r.completed_count, r.scheduled_count, r.good_percent_of_completed, r.distinct_satellites, r.distinct_stations) == (4, 1, 50.0, 2, 2)


def test_kp_comes_in_tenths_and_the_newest_day_wins(spark):
    (r,) = gold.sw_index_daily(rows(spark, "space_weather_index_history", index(kp1=67.0, kp_sum=277.0, ap_avg=15.0), index(snapshot_at_utc=seen(29), f10_7_observed=1.0))).collect()
    assert (r.kp1, r.kp_sum, r.ap_avg, r.f10_7_observed) == (6.7, 27.7, 15.0, 150.0)


def minute(spark, m, p=()):
    return gold.space_weather_minute(rows(spark, "noaa_magnetic_history", *m), rows(spark, "noaa_plasma_history", *p)).collect()


def test_one_row_a_minute_whatever_the_number_of_snapshots(spark):
    assert len(minute(spark, [magnetic(snapshot_at_utc=seen(30, h)) for h in range(6)])) == 1
    assert len(minute(spark, [magnetic(observed_at_utc=at(d)) for d in range(20, 27)])) == 7


@pytest.mark.parametrize(("a", "b", "want"), [
    ({"spacecraft": "ACE", "is_active_source": False, "bz_gsm": -1.0}, {"bz_gsm": -9.0}, -9.0), ({"quality_code": 5, "bz_gsm": -1.0}, {"bz_gsm": -7.0}, -7.0),
    ({"bz_gsm": -2.0}, {"snapshot_at_utc": seen(30, 6), "bz_gsm": -8.0}, -8.0), ({"is_active_source": None, "bz_gsm": -3.0}, {"is_active_source": False, "bz_gsm": -4.0}, -4.0),
])
def test_the_most_trustworthy_row_of_a_minute(spark, a, b, want):
    assert [r.bz_gsm_nanotesla for r in minute(spark, [magnetic(**a), magnetic(**b)])] == [want]


def test_minutes_join_and_survive_without_plasma(spark):
    (r,) = minute(spark, [magnetic(observed_at_utc=at(29, 23, 0, 12))], [plasma(observed_at_utc=at(29, 23, 0, 47), proton_speed=640.0)])
    assert r.proton_speed_km_per_second == 640.0 and r.observation_minute_utc == at(29, 23)
    (r,) = minute(spark, [magnetic()])
    assert r.proton_speed_km_per_second is None


def test_disturbance_levels(spark):
    given = [(-1.0, 380.0), (-8.0, 380.0), (-1.0, 650.0), (-8.0, 650.0), (-4.9, 499.0)]
    df = gold.space_weather_hourly(gold.space_weather_minute(rows(spark, "noaa_magnetic_history", *[magnetic(observed_at_utc=at(29, h), bz_gsm=b) for h, (b, _) in enumerate(given)]), rows(spark, "noaa_plasma_history", *[plasma(observed_at_utc=at(29, h), proton_speed=v) for h, (_, v) in enumerate(given)])))
    assert [r.disturbance_level for r in df.orderBy("hour_utc").collect()] == ["quiet", "southward_bz", "fast_wind", "southward_bz", "quiet"]


def scored(spark, bz=-1.0, speed=400.0, *given):
    hourly = gold.space_weather_hourly(gold.space_weather_minute(rows(spark, "noaa_magnetic_history", magnetic(bz_gsm=bz)), rows(spark, "noaa_plasma_history", plasma(proton_speed=speed))))
    return gold.orbit_reliability_index(rows(spark, "orbital_snapshot_history", *given), hourly).orderBy("norad_catalog_id").collect()


def test_fresh_and_high_beats_stale_and_low(spark):
    a, b = scored(spark, -1.0, 400.0, orbit(mean_motion_revolutions_per_day=12.5), orbit(norad_catalog_id=2, mean_motion_revolutions_per_day=16.2, element_epoch_utc=at(28, 12)))
    assert a.orbit_reliability_index > b.orbit_reliability_index and a.reliability_class == "high" and b.reliability_class == "low"


@pytest.mark.parametrize(("bz", "speed", "factor"), [(-9.0, 400.0, 0.8), (-1.0, 700.0, 0.9), (-1.0, 400.0, 1.0)])
def test_weather_factor(spark, bz, speed, factor):
    (r,) = scored(spark, bz, speed, orbit(mean_motion_revolutions_per_day=14.0))
    assert r.environment_factor == factor and abs(r.orbit_reliability_index - r.base_score * factor) <= 0.1


def test_index_stays_within_bounds_and_needs_its_inputs(spark):
    got = scored(spark, -1.0, 400.0, orbit(mean_motion_revolutions_per_day=11.0), orbit(norad_catalog_id=2, mean_motion_revolutions_per_day=16.4, element_epoch_utc=at(20)), orbit(norad_catalog_id=3, mean_motion_revolutions_per_day=None), orbit(norad_catalog_id=4, element_epoch_utc=None))
    assert [r.norad_catalog_id for r in got] == [1, 2] and all(0 <= r.orbit_reliability_index <= 100 for r in got)


def test_change_needs_a_positive_interval(spark):
    df = gold.orbit_change(rows(spark, "orbital_snapshot_history", orbit(), orbit(snapshot_at_utc=seen(31, 12), mean_motion_revolutions_per_day=15.6), orbit(snapshot_at_utc=seen(31, 12), mean_motion_revolutions_per_day=15.7, element_epoch_utc=at(31)), orbit(norad_catalog_id=None)))
    a, b = df.orderBy("mean_motion_revolutions_per_day").collect()
    assert a.interval_minutes == 1440 and abs(a.decay_rate_km_per_day + a.semi_major_axis_change_km) < 1e-9 and a.decay_rate_km_per_day > 0 and a.same_element_set
    assert b.interval_minutes == 0 and b.decay_rate_km_per_day is None


def test_freshness_uses_each_groups_latest_snapshot(spark):
    df = gold.element_freshness(rows(spark, "orbital_snapshot_history", orbit(), orbit(snapshot_at_utc=seen(31, 13)), orbit(norad_catalog_id=2, source_group="science", element_epoch_utc=at(29))))
    got = {r.source_group: r for r in gold.freshness_by_group(df).collect()}
    assert got["stations"].median_age_hours == 25.0 and got["stations"].stale_percent == 100.0 and got["science"].maximum_age_hours == 36.0


def silver(spark, *given):
    names = "source_group object_name norad_catalog_id element_epoch_utc inclination_degrees eccentricity mean_motion_revolutions_per_day bstar_drag_term retrieved_at_utc source_url".split()
    base = dict(zip(names, ["stations", "ISS", "25544", "2026-08-30T12:00:00", "51.64", "0.0004", "15.5", "", "2026-08-31T13:30:00+00:00", "u"], strict=True))
    return spark.createDataFrame([tuple((base | g)[n] for n in names) for g in given], ", ".join(f"{n} string" for n in names))


def test_features(spark):
    (r,) = gold.orbit_features(silver(spark, {}, {"mean_motion_revolutions_per_day": "x"}, {"eccentricity": "1.0"}, {"mean_motion_revolutions_per_day": "0"})).collect()
    assert abs(r.mean_altitude_km - 416.726) < 1e-3 and r.altitude_band == "lower_leo" and r.element_age_hours == 25 and r.is_stale_over_24_hours and r.bstar_drag_term is None
    assert abs(r.perigee_km - (r.semi_major_axis_km * (1 - 0.0004) - 6378.137)) < 1e-9 and abs(r.orbital_period_minutes - 1440 / 15.5) < 1e-9


def test_debris_cohort(spark):
    f = gold.orbit_features(silver(spark, {"source_group": gold.COHORT}, {}, {"source_group": "cubesat"}))
    assert [r.mean_altitude_km for r in gold.debris_population(f).collect()] == [416.7]
    assert gold.debris_population(f.limit(0)).count() == 0


def test_snapshot_summary_survives_missing_plasma(spark):
    (r,) = gold.space_weather_snapshot_summary(rows(spark, "noaa_magnetic_history", magnetic()), rows(spark, "noaa_plasma_history")).collect()
    assert r.magnetic_row_count == 1 and r.plasma_row_count is None


def test_expressions(spark):
    (r,) = spark.range(1).select(X.round_half_up(F.lit(-2.5), 0).alias("a"), X.boundaries("hour", F.lit("2026-08-30 00:59:59").cast("timestamp_ntz"), F.lit("2026-08-30 01:00:00").cast("timestamp_ntz")).alias("b"), X.clamp01(F.lit(None).cast("double")).alias("c"), X.flag(F.lit("false")).alias("d"), X.flag(F.lit("1")).alias("e"), X.number(F.lit(" null ")).alias("f"), X.snapshot_of(F.lit("/x/stations_20260830T120000Z.csv")).alias("g")).collect()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (-3.0, 1, None, False, True, None) and r.g.strftime("%H") == "12"
    a, b = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string").select(X.content_hash("x", "y", "z").alias("h")).collect()
    assert a.h != b.h
