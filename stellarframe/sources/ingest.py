"""Collecting: fetch a source, check the payload, land it as it came, and write the current rows under renamed columns.

Payloads are a few MB and are fetched by the driver; what is landed is loaded by Spark. A landed file is never replaced; the
current file of a source is replaced by one rename. The fetcher is a function of a URL, so that tests need no network.
"""

from __future__ import annotations

import csv
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from pathlib import Path

from . import bronze, sinks

#: Where the sources are, fixed values of their publishers.
ELEMENTS_URL = "https://celestrak.org/NORAD/elements/gp.php?GROUP={group}&FORMAT=csv"
SOLAR_WIND_URLS = {"magnetic_field": "https://services.swpc.noaa.gov/json/rtsw/rtsw_mag_1m.json", "plasma": "https://services.swpc.noaa.gov/json/rtsw/rtsw_wind_1m.json"}
INDICES_URL = "https://celestrak.org/SpaceData/SW-Last5Years.csv"
OBSERVATIONS_URL = "https://network.satnogs.org/api/observations/?format=json"
#: Pause between requests to the network of ground stations, in seconds.
SPACING_S = 1.0

#: Field of the payload to column of the current file, fixed values of the file format; two more columns say when and whence.
CURRENT = {
    "celestrak": {"OBJECT_NAME": "object_name", "NORAD_CAT_ID": "norad_catalog_id", "EPOCH": "element_epoch_utc", "INCLINATION": "inclination_degrees", "ECCENTRICITY": "eccentricity", "MEAN_MOTION": "mean_motion_revolutions_per_day", "BSTAR": "bstar_drag_term"},
    "magnetic_field": {"time_tag": "observed_at_utc", "source": "spacecraft", "active": "is_active_source", "bt": "total_field_nanotesla", "bx_gsm": "bx_gsm_nanotesla", "by_gsm": "by_gsm_nanotesla", "bz_gsm": "bz_gsm_nanotesla", "overall_quality": "quality_code"},
    "plasma": {"time_tag": "observed_at_utc", "source": "spacecraft", "active": "is_active_source", "proton_speed": "proton_speed_km_per_second", "proton_temperature": "proton_temperature_kelvin", "proton_density": "proton_density_per_cubic_cm", "overall_quality": "quality_code"},
    "spaceweather": {"DATE": "observation_date", **{f"KP{i}": f"kp{i}" for i in range(1, 9)}, "KP_SUM": "kp_sum", "AP_AVG": "ap_avg", "ISN": "sunspot_number", "F10.7_OBS": "f10_7_observed", "F10.7_DATA_TYPE": "f10_7_data_type"},
    "satnogs": {"id": "observation_id", "start": "start_utc", "end": "end_utc", "status": "status", "norad_cat_id": "norad_catalog_id", "sat_id": "satellite_id", "ground_station": "station_id", "station_lat": "station_lat", "station_lng": "station_lng", "observation_frequency": "observation_frequency_hz", "transmitter_mode": "transmitter_mode"},
}
#: Name of the current file of each kind, fixed values.
CURRENT_FILES = {"celestrak": "{group}_satellites_latest.csv", "magnetic_field": "noaa_magnetic_field_latest.csv", "plasma": "noaa_plasma_latest.csv", "spaceweather": "sw_indices_latest.csv", "satnogs": "satnogs_observations_latest.csv"}
Get = Callable[[str], bytes]


def write_current(folder: str, kind: str, rows: list[dict], at: datetime, url: str, group: str = "") -> str:
    """Replace the current file of a source; a field that is absent is empty."""
    path = Path(folder, CURRENT_FILES[kind].format(group=group))
    path.parent.mkdir(parents=True, exist_ok=True)
    columns = CURRENT[kind]
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with beside.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([*columns.values(), "retrieved_at_utc", "source_url"])
        out.writerows([*("" if r.get(c) is None else str(r[c]).strip() for c in columns), at.isoformat(), url] for r in rows)
    os.replace(beside, path)
    return str(path)


def _took(root: str, current: str, kind: str, source: str, name: str, data: bytes, at: datetime, url: str, group: str = "") -> int:
    """Check a payload, then land it and write its current file; how many rows it has."""
    rows = bronze.check_payload(kind, data)
    sinks.land(root, source, name, at, data)
    write_current(current, kind, rows, at, url, group)
    return len(rows)


def elements(get: Get, root: str, current: str, at: datetime, groups: Iterable[str] = bronze.GROUPS) -> dict[str, int]:
    """The elements of each group; rows by group."""
    out = {}
    for group in groups:
        url = ELEMENTS_URL.format(group=group)
        out[group] = _took(root, current, "celestrak", "celestrak", group, get(url), at, url, group)
    return out


def solar_wind(get: Get, root: str, current: str, at: datetime) -> dict[str, int]:
    """Both feeds, fetched and checked before either is landed."""
    got = {kind: (url, get(url)) for kind, url in SOLAR_WIND_URLS.items()}
    for kind, (_, data) in got.items():
        bronze.check_payload(kind, data)
    return {kind: _took(root, current, kind, "noaa", kind, data, at, url) for kind, (url, data) in got.items()}


def indices(get: Get, root: str, current: str, at: datetime) -> dict[str, int]:
    """The daily indices; forecast days are landed, but are not current rows."""
    return {"spaceweather": _took(root, current, "spaceweather", "spaceweather", "sw", get(INDICES_URL), at, INDICES_URL)}


def observations(get: Get, root: str, current: str, at: datetime, pending: Iterable[int] = (), spacing_s: float = SPACING_S, wait: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """The listing, one sweep for each final status, and what is pending by id: one request each, with pauses between them."""
    asked = []

    def polite(url: str) -> bytes:
        if asked:
            wait(spacing_s)
        asked.append(url)
        return get(url)

    rows = bronze.collect_observations(polite, OBSERVATIONS_URL, [f"{OBSERVATIONS_URL}&status={s}" for s in bronze.TERMINAL], [f"{OBSERVATIONS_URL}&id={i}" for i in pending])
    if not rows:
        raise ValueError("satnogs: no observations")
    sinks.land(root, "satnogs", "observations", at, json.dumps(rows, indent=1).encode())
    write_current(current, "satnogs", rows, at, OBSERVATIONS_URL)
    return {"satnogs": len(rows), "requests": len(asked)}


def now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0)
