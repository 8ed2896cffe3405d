"""Schemas of raw payloads and history tables; the column names are part of the data's format."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


LINEAGE = "source_file string, source_sha256 string"
HISTORY = {
    "orbital_snapshot_history": "snapshot_at_utc timestamp, object_name string, norad_catalog_id long, element_epoch_utc timestamp_ntz, inclination_degrees double, eccentricity double, mean_motion_revolutions_per_day double, bstar_drag_term double, ra_of_asc_node_degrees double, arg_of_pericenter_degrees double, mean_anomaly_degrees double, mean_motion_dot double, mean_motion_ddot double, source_group string, " + LINEAGE,
    "noaa_magnetic_history": "snapshot_at_utc timestamp, observed_at_utc timestamp_ntz, spacecraft string, is_active_source boolean, bt double, bx_gsm double, by_gsm double, bz_gsm double, quality_code int, " + LINEAGE,
    "noaa_plasma_history": "snapshot_at_utc timestamp, observed_at_utc timestamp_ntz, spacecraft string, is_active_source boolean, proton_speed double, proton_temperature double, proton_density double, quality_code int, " + LINEAGE,
    "space_weather_index_history": "snapshot_at_utc timestamp, observation_date date, " + ", ".join(f"kp{i} double" for i in range(1, 9)) + ", kp_sum double, ap_avg double, sunspot_number double, f10_7_observed double, f10_7_data_type string, " + LINEAGE,
    "satnogs_observation_history": "snapshot_at_utc timestamp, observation_id long, start_utc timestamp_ntz, end_utc timestamp_ntz, status string, norad_catalog_id long, satellite_id string, station_id long, station_lat double, station_lng double, observation_frequency_hz double, transmitter_mode string, " + LINEAGE,
}
REGISTRY = "file_path string, source string, snapshot_at_utc timestamp, sha256 string, loaded_at_utc timestamp, row_count int"
#: What is known of a file without reading it again.
FILE_INDEX = "file_path string, length long, modified_at timestamp, sha256 string, first_line string"

#: Fields of the raw payloads, fixed values of their formats; those in REQUIRED must be there.
RAW = {
    "celestrak": "OBJECT_NAME,NORAD_CAT_ID,EPOCH,INCLINATION,ECCENTRICITY,MEAN_MOTION,BSTAR,RA_OF_ASC_NODE,ARG_OF_PERICENTER,MEAN_ANOMALY,MEAN_MOTION_DOT,MEAN_MOTION_DDOT".split(","),
    "magnetic_field": "time_tag,source,active,bt,bx_gsm,by_gsm,bz_gsm,overall_quality".split(","),
    "plasma": "time_tag,source,active,proton_speed,proton_density,proton_temperature,overall_quality".split(","),
    "spaceweather": "DATE,KP1,KP2,KP3,KP4,KP5,KP6,KP7,KP8,KP_SUM,AP_AVG,ISN,F10.7_OBS,F10.7_DATA_TYPE".split(","),
    "satnogs": "id,start,end,status,norad_cat_id,sat_id,ground_station,station_lat,station_lng,observation_frequency,transmitter_mode".split(","),
}
REQUIRED = {
    "celestrak": "OBJECT_NAME,NORAD_CAT_ID,EPOCH,INCLINATION,ECCENTRICITY,MEAN_MOTION".split(","),
    "magnetic_field": "time_tag,source,active,bt,bz_gsm".split(","),
    "plasma": "time_tag,source,active,proton_speed,proton_density".split(","),
    "spaceweather": "DATE,KP1,KP_SUM,AP_AVG,F10.7_OBS".split(","),
    "satnogs": "id,start,end,status,norad_cat_id".split(","),
}
RUN_EVENT = "run_id string, step string, status string, started_at_utc string, duration_seconds double, return_code int, command string, stdout string, stderr string"
