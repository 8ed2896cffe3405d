"""A run with its optional steps: training, report, mirror and publication."""

import json
from datetime import datetime, timedelta, timezone

from stellarframe.plans import pipeline
from stellarframe.sources import bronze

HEAD = "OBJECT_NAME,NORAD_CAT_ID,EPOCH,INCLINATION,ECCENTRICITY,MEAN_MOTION,BSTAR,RA_OF_ASC_NODE,ARG_OF_PERICENTER,MEAN_ANOMALY,MEAN_MOTION_DOT,MEAN_MOTION_DDOT"
START = datetime(2026, 8, 30, tzinfo=timezone.utc)


def land(root, hours, objects):
    """A snapshot of made-up satellites for each hour, each with new elements, and the other sources once."""
    for name in ("celestrak", "noaa", "spaceweather", "satnogs"):
        (root / name).mkdir(parents=True, exist_ok=True)
    for h in range(hours):
        at = START + timedelta(hours=h)
        lines = [f"S{i},{i},{at - timedelta(minutes=30 + i):%Y-%m-%dT%H:%M:%S},98.7,0.001,{14.2 + i / 50 + h / 10_000},3e-5,211.5,33.2,{(300 + 15 * (14.2 + i / 50) * h) % 360:.4f},0,0" for i in range(1, objects + 1)]
        (root / f"celestrak/stations_{at:%Y%m%dT%H%M%SZ}.csv").write_text("\n".join([HEAD, *lines]) + "\n")
    wind = [{"time_tag": f"{START + timedelta(minutes=i):%Y-%m-%dT%H:%M:%S}", "source": "DSCOVR", "active": True} for i in range(30)]
    (root / "noaa/magnetic_field_20260830T010000Z.json").write_text(json.dumps([w | {"bt": 5.0, "bz_gsm": -1.0} for w in wind]))
    (root / "noaa/plasma_20260830T010000Z.json").write_text(json.dumps([w | {"proton_speed": 400.0, "proton_density": 5.0} for w in wind]))
    (root / "spaceweather/sw_20260830T010000Z.csv").write_text("DATE,KP1,KP_SUM,AP_AVG,F10.7_OBS\n2026-08-29,20,160,8,150\n")
    (root / "satnogs/observations_20260830T010000Z.json").write_text(json.dumps([{"id": 1, "start": "2026-08-29T01:00:00Z", "end": "2026-08-29T02:00:00Z", "status": "good", "norad_cat_id": 1}]))


def test_extras_of_a_run(spark, tmp_path):
    root, log, sent = tmp_path / "bronze", str(tmp_path / "runs.jsonl"), []
    land(root, 12, 6)
    extras = pipeline.Extras(train={"maxIter": 3}, report=str(tmp_path / "report.md"), mirror_to=str(tmp_path / "mirror"), publish=("nowhere:9092", "events"), send=lambda rows: sent.append(rows.count()))
    run = lambda: {e["step"]: (e["status"], e["stdout"]) for e in pipeline.run(spark, str(root), str(tmp_path / "out"), str(tmp_path / "lock"), log, at=START, extras=extras)}
    got = run()
    assert {s for s, _ in got.values()} == {"success"} and list(got)[-4:] == ["train_model", "write_report", "mirror_bronze", "publish_events"], got
    score = json.loads((tmp_path / "out/model/summary.json").read_text())
    assert score["scores"]["pairs"] >= 30 and score["settings"]["maxIter"] == 3 and (tmp_path / "out/model/latest").is_dir()
    assert "# Research report" in (tmp_path / "report.md").read_text() and sent == [6]
    files = bronze.found(spark, str(root)).count()
    assert got["mirror_bronze"][1] == f"{files} files" and bronze.found(spark, str(tmp_path / "mirror")).count() == files
    # a second run copies what is new alone
    (root / "noaa/plasma_20260830T020000Z.json").write_text((root / "noaa/plasma_20260830T010000Z.json").read_text())
    assert run()["mirror_bronze"] == ("success", "1 files") and (tmp_path / "mirror/noaa/plasma_20260830T020000Z.json").is_file()


def test_extras_that_have_nothing_to_do_are_skipped(spark, tmp_path):
    root, log = tmp_path / "bronze", str(tmp_path / "runs.jsonl")
    land(root, 2, 3)

    def refuse(rows):
        raise OSError("no broker")

    extras = pipeline.Extras(train={}, publish=("nowhere:9092", "events"), send=refuse)
    got = pipeline.run(spark, str(root), str(tmp_path / "out"), str(tmp_path / "lock"), log, at=START, extras=extras)
    assert [(e["step"], e["status"]) for e in got[-2:]] == [("train_model", "skipped"), ("publish_events", "skipped")]
