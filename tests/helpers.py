"""Small tables for tests."""

from datetime import date, datetime, timezone

from stellarframe import schemas


def at(day: int, hour: int = 0, minute: int = 0, second: int = 0) -> datetime:
    return datetime(2026, 8, day, hour, minute, second)


def seen(day: int, hour: int = 0, minute: int = 0) -> datetime:
    return datetime(2026, 8, day, hour, minute, tzinfo=timezone.utc)


def rows(spark, table: str, *given: dict):
    """Rows of a history table; what isn't given is null."""
    schema = schemas.struct(schemas.HISTORY[table])
    return spark.createDataFrame([tuple({"source_file": "f", "source_sha256": "s"}.get(n) if n not in g else g[n] for n in schema.fieldNames()) for g in given], schema)


def orbit(**more) -> dict:
    """A made-up satellite on a nearly polar orbit of 14.2 revolutions a day."""
    element = {"inclination_degrees": 98.7, "eccentricity": 0.0012, "mean_motion_revolutions_per_day": 14.2, "bstar_drag_term": 3e-5, "ra_of_asc_node_degrees": 211.5, "arg_of_pericenter_degrees": 33.25, "mean_anomaly_degrees": 300.0, "mean_motion_dot": 0.0, "mean_motion_ddot": 0.0}
    return {"snapshot_at_utc": seen(30, 12), "object_name": "MADE-UP 1", "norad_catalog_id": 1, "element_epoch_utc": at(30, 12), "source_group": "stations"} | element | more


def magnetic(**more) -> dict:
    return {"snapshot_at_utc": seen(30), "observed_at_utc": at(29, 23), "spacecraft": "DSCOVR", "is_active_source": True, "bt": 5.0, "bx_gsm": 1.0, "by_gsm": 1.0, "bz_gsm": -1.0, "quality_code": 0} | more


def plasma(**more) -> dict:
    return {"snapshot_at_utc": seen(30), "observed_at_utc": at(29, 23), "spacecraft": "DSCOVR", "is_active_source": True, "proton_speed": 400.0, "proton_temperature": 1e5, "proton_density": 5.0, "quality_code": 0} | more


def observation(**more) -> dict:
    return {"snapshot_at_utc": seen(30), "observation_id": 1, "start_utc": at(30, 1), "end_utc": at(30, 2), "status": "good", "norad_catalog_id": 100, "satellite_id": "S", "station_id": 7} | more


def index(**more) -> dict:
    return {"snapshot_at_utc": seen(30), "observation_date": date(2026, 8, 29), **{f"kp{i}": 20.0 for i in range(1, 9)}, "kp_sum": 160.0, "ap_avg": 8.0, "sunspot_number": 50.0, "f10_7_observed": 150.0, "f10_7_data_type": "OBS"} | more
