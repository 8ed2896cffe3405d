"""Raw payloads, the loader, the gate, orchestration, streams and serving."""

import json
import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stellarframe.operators import history, quality
from stellarframe.plans import pipeline, serve
from stellarframe.sources import bronze, ingest, sinks
from stellarframe.streaming import events

from .helpers import index, magnetic, orbit, plasma, rows, seen

NOW = datetime(2026, 8, 30, 12, tzinfo=timezone.utc)
HEAD = "OBJECT_NAME,NORAD_CAT_ID,EPOCH,INCLINATION,ECCENTRICITY,MEAN_MOTION,BSTAR"
ELEMENT = "ISS,25544,2026-08-30T10:00:00,51.64,0.0004,15.5,"


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "bronze"

    def put(path, text):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
        return str(p)

    put("celestrak/stations_20260830T120000Z.csv", f"﻿{HEAD}\n{ELEMENT}\nNULLID,,2026-08-30T10:00:00,1,0,15,\n")
    put("celestrak/cubesat_20260830T120000Z.csv", f"{HEAD}\n{ELEMENT.replace('ISS', 'COPY')}\nCUBE,7,2026-08-30T11:00:00,97,0.001,15.1,1e-4\n")
    put("noaa/magnetic_field_20260830T120000Z.json", json.dumps([{"time_tag": "2026-08-30T11:00:00", "source": "DSCOVR", "active": "false", "bt": 5.1, "bz_gsm": None}, {"time_tag": "2026-08-30T11:01:00", "source": "ACE", "active": True, "bt": 5, "bz_gsm": -2.5, "overall_quality": 0}]))
    put("noaa/plasma_20260830T120000Z.json", json.dumps([{"time_tag": "2026-08-30T11:00:00", "source": "DSCOVR", "active": True, "proton_speed": 420, "proton_density": 3.2}]))
    put("spaceweather/sw_20260830T120000Z.csv", "DATE,KP1,KP_SUM,AP_AVG,F10.7_OBS\n2026-08-29,20,160,8,150\n2026-08-31,,,,140\n")
    put("satnogs/observations_20260830T120000Z.json", json.dumps([{"id": 1, "start": "2026-08-30T09:00:00Z", "end": "2026-08-30T09:10:00Z", "status": "unknown", "norad_cat_id": 25544, "sat_id": "A-B", "ground_station": 3}, {"id": None, "status": "good"}]))
    return root, put


def test_payload_checks():
    assert len(bronze.check_payload("celestrak", f"﻿{HEAD}\n{ELEMENT}\n".encode())) == 1
    for kind, data in (("celestrak", b""), ("celestrak", b"OBJECT_NAME\nX\n"), ("plasma", b"[]"), ("plasma", b'{"a": 1}'), ("satnogs", b"3")):
        with pytest.raises(ValueError):
            bronze.check_payload(kind, data)
    one = {"id": 1, "start": "a", "end": "b", "status": "good", "norad_cat_id": 1}
    assert bronze.check_payload("satnogs", json.dumps(one).encode()) == [one]
    assert len(bronze.check_payload("spaceweather", b"DATE,KP1,KP_SUM,AP_AVG,F10.7_OBS\n2026-08-29,20,1,1,1\n2026-08-30, ,,,\n")) == 1


def test_later_answers_win_and_failures_of_sweeps_are_tolerated():
    base = {"start": "a", "end": "b", "norad_cat_id": 1}
    answers = {"list": [base | {"id": 2, "status": "future"}, base | {"id": 1, "status": "unknown"}], "good": [base | {"id": 1, "status": "good"}]}

    def get(url):
        if url not in answers:
            raise OSError(url)
        return json.dumps(answers[url]).encode()

    got = bronze.collect_observations(get, "list", ["good", "bad"], ["7"])
    assert [(r["id"], r["status"]) for r in got] == [(1, "good"), (2, "future")]
    with pytest.raises(OSError):
        bronze.collect_observations(get, "nothing", [], [])


def test_pending_ids(spark):
    given = [("a", "1", "2026-08-29T00:00:00Z", "future"), ("b", "1", "2026-08-29T00:00:00Z", "good"), ("a", "2", "2026-08-29T02:00:00Z", "unknown"), ("a", "3", "2026-09-29T00:00:00Z", "future"), ("a", "x", "2026-08-29T00:00:00Z", "future")]
    given += [("a", str(i), f"2026-08-28T00:00:{i}Z", "future") for i in range(10, 22)]
    got = bronze.pending_ids(spark.createDataFrame(given, "file_path string, id string, end string, status string"), F.lit(NOW)).collect()
    assert [r.observation_id for r in got] == list(range(10, 20))


def test_load_is_idempotent_and_guards_files(spark, landing, tmp_path):
    root, put = landing
    home = str(tmp_path / "history")
    assert history.load(spark, str(root), home) == {"orbital_snapshot_history": 2, "noaa_magnetic_history": 2, "noaa_plasma_history": 1, "space_weather_index_history": 1, "satnogs_observation_history": 1}
    assert history.load(spark, str(root), home) == {}
    orbits = {r.norad_catalog_id: r for r in history.read_history(spark, home, "orbital_snapshot_history").collect()}
    assert orbits[25544].object_name == "ISS" and orbits[25544].source_group == "stations" and orbits[25544].bstar_drag_term is None and set(orbits) == {25544, 7}
    m = {r.spacecraft: r for r in history.read_history(spark, home, "noaa_magnetic_history").collect()}
    assert m["DSCOVR"].is_active_source is False and m["DSCOVR"].bz_gsm is None and m["ACE"].bz_gsm == -2.5
    # unchanged content under a new name adds nothing, nulls and all; a changed status does
    put("satnogs/observations_20260830T130000Z.json", (root / "satnogs/observations_20260830T120000Z.json").read_text())
    put("spaceweather/sw_20260830T130000Z.csv", "KP1,DATE,KP_SUM,AP_AVG,F10.7_OBS\n20,2026-08-29,160,8,150\n")
    assert sum(history.load(spark, str(root), home).values()) == 0
    put("satnogs/observations_20260830T140000Z.json", (root / "satnogs/observations_20260830T120000Z.json").read_text().replace("unknown", "good"))
    assert history.load(spark, str(root), home) == {"satnogs_observation_history": 1}
    registry = history.read_registry(spark, home)
    gate = quality.gate({t: history.read_history(spark, home, t) for t in quality.SOURCES}, registry, bronze.unloadable(bronze.listing(spark, str(root))))
    assert {r.check_name: r.status for r in gate.collect() if r.status != "pass"} == {"magnetic_missing_bz_percent": "warn"}
    put("celestrak/stations_20260830T120000Z.csv", f"{HEAD}\n{ELEMENT}\n")
    with pytest.raises(history.ModifiedFile):
        history.load(spark, str(root), home)


def test_rows_of_an_unfinished_load_are_not_seen(spark, landing, tmp_path):
    root, _ = landing
    home = str(tmp_path / "history")
    history.load(spark, str(root), home)
    stray = rows(spark, "noaa_plasma_history", plasma(source_file="unregistered"))
    stray.write.mode("append").parquet(f"{home}/noaa_plasma_history/load=crashed")
    assert history.read_history(spark, home, "noaa_plasma_history").count() == 1


def test_migration_fills_and_widens(spark):
    old = spark.createDataFrame([(1, 5)], "norad_catalog_id int, mean_motion_revolutions_per_day int")
    r = history.migrate(old, "orbital_snapshot_history").first()
    assert r.source_group == "stations" and r.mean_motion_revolutions_per_day == 5.0 and r.mean_motion_dot is None


@pytest.mark.parametrize(("op", "value", "limit", "want"), [("greater_than", 1, 0, True), ("greater_than", 0, 0, False), ("less_than_or_equal", 0, 0, True), ("less_than_or_equal", 1, 0, False), ("less_than", 0, 1, True), ("greater_than_or_equal", 1, 1, True), ("equal", 2, 2, True), ("equal", None, 2, False)])
def test_operators(spark, op, value, limit, want):
    df = spark.createDataFrame([(value,)], "v int")
    assert df.select(quality.passes(F.col("v").cast("double"), op, limit).alias("p")).first().p is want
    with pytest.raises(ValueError):
        quality.passes(F.col("v"), "about", 1)


def gate_of(spark, orbital=(), registry=(), files=()):
    tables = {"orbital_snapshot_history": rows(spark, "orbital_snapshot_history", *orbital), "noaa_magnetic_history": rows(spark, "noaa_magnetic_history", magnetic()), "noaa_plasma_history": rows(spark, "noaa_plasma_history", plasma()), "space_weather_index_history": rows(spark, "space_weather_index_history", index()), "satnogs_observation_history": rows(spark, "satnogs_observation_history")}
    known = spark.createDataFrame([(f, "s", None, "s", None, n) for f, n in (registry or [("f", 1)])], "file_path string, source string, snapshot_at_utc timestamp, sha256 string, loaded_at_utc timestamp, row_count int")
    return {r.check_name: r.status for r in quality.gate(tables, known, spark.createDataFrame([(f,) for f in files], "file_path string")).collect()}


def test_gate(spark):
    assert gate_of(spark)["orbital_history_has_rows"] == "fail"
    good = gate_of(spark, [orbit()])
    assert len(good) == 13 and set(good.values()) == {"pass"}
    assert gate_of(spark, [orbit(source_file="lost")])["orphan_history_rows"] == "fail"
    assert gate_of(spark, [orbit(), orbit(norad_catalog_id=2, source_sha256="other")])["modified_bronze_paths"] == "fail"
    assert gate_of(spark, [orbit(), orbit()])["duplicate_orbital_snapshot_objects"] == "fail"
    for name, bad in (("invalid_eccentricity_rows", {"eccentricity": 1.0}), ("invalid_inclination_rows", {"inclination_degrees": 181.0}), ("invalid_mean_motion_rows", {"mean_motion_revolutions_per_day": None})):
        assert gate_of(spark, [orbit(**bad)])[name] == "fail"
    assert gate_of(spark, [orbit()], [("f", 1), ("g", 3)])["registered_files_missing_rows"] == "fail"
    assert gate_of(spark, [orbit()], [("f", 1), ("g", 0)])["registered_files_missing_rows"] == "pass"
    assert gate_of(spark, [orbit()], files=["odd.txt"])["unloadable_bronze_files"] == "warn"


def test_run_from_files_to_tables(spark, landing, tmp_path):
    root, _ = landing
    log, lock = str(tmp_path / "runs.jsonl"), str(tmp_path / "lock")
    got = pipeline.run(spark, str(root), str(tmp_path / "out"), lock, log)
    assert [(e["step"], e["status"]) for e in got] == [("load_history", "success"), ("check_quality", "success"), ("build_gold", "success")] and not os.path.exists(lock)
    assert sinks.read_table(spark, str(tmp_path / "out/gold/orbit_reliability_index")).count() == 2
    results = quality.read_report(spark, str(tmp_path / "out/quality"))
    r = quality.overall(results).first()
    assert (r.status, r.checks_total, r.failures, r.warnings) == ("warn", 13, 0, 1) and r.checked_at_utc is not None
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/quality_csv")).count() == 13
    log_rows = bronze.read_run_log(spark, log)
    assert log_rows.count() == 3 and sinks.kafka_rows(log_rows).select("key").distinct().count() == 1


class Web:
    """Answers for the sources' addresses."""

    def __init__(self, day=30):
        self.asked, self.day = [], day

    def __call__(self, url):
        self.asked.append(url)
        stamp = f"2026-08-{self.day}T"
        if "GROUP=" in url:
            group = url.split("GROUP=")[1].split("&")[0]
            i = bronze.GROUPS.index(group) + 1
            return f"{HEAD},RA_OF_ASC_NODE,ARG_OF_PERICENTER,MEAN_ANOMALY,MEAN_MOTION_DOT,MEAN_MOTION_DDOT\n{group.upper()},{i},{stamp}08:00:00,98.1,0.001,14.{i},2e-5,10,20,30,0,0\n".encode()
        if "rtsw_mag" in url:
            return json.dumps([{"time_tag": f"{stamp}11:0{i}:00", "source": "ACE", "active": True, "bt": 5, "bx_gsm": 1, "by_gsm": 1, "bz_gsm": -7.5, "overall_quality": 0} for i in range(3)]).encode()
        if "rtsw_wind" in url:
            return json.dumps([{"time_tag": f"{stamp}11:00:00", "source": "ACE", "active": True, "proton_speed": 420, "proton_density": 3.2}]).encode()
        if "SpaceData" in url:
            return b"DATE,KP1,KP8,KP_SUM,AP_AVG,F10.7_OBS\n2026-08-29,20,20,160,8,150\n2026-08-31,,,,,140\n"
        one = lambda i, status: {"id": i, "start": "2026-08-29T09:00:00Z", "end": "2026-08-29T09:10:00Z", "status": status, "norad_cat_id": 1, "sat_id": "A", "ground_station": 3}
        if "status=failed" in url:
            raise OSError("busy")
        return json.dumps([one(1, "future"), one(2, "unknown")] if url == ingest.OBSERVATIONS_URL else [one(3, "good")] if "status=" in url else [one(int(url.split("id=")[1]), "good")]).encode()


def test_from_payloads_to_derived_tables(spark, tmp_path):
    root, silver, out = (str(tmp_path / x) for x in ("bronze", "silver", "out"))
    web, pauses = Web(), []
    got = pipeline.run(spark, root, out, str(tmp_path / "lock"), str(tmp_path / "log"), silver, get=web, at=NOW, wait=pauses.append)
    assert [(e["step"], e["status"]) for e in got] == [(s, "success") for s in ("ingest_elements", "ingest_solar_wind", "ingest_indices", "ingest_observations", "load_history", "check_quality", "build_gold")]
    assert len(pauses) == 3 and set(pauses) == {1.0}
    read = lambda name: sinks.read_table(spark, f"{out}/gold/{name}").collect()
    assert {r.source_group: r.norad_catalog_id for r in read("orbit_features")} == {g: i + 1 for i, g in enumerate(bronze.GROUPS)}
    assert [r.object_name for r in read("debris_population")] == ["IRIDIUM-33-DEBRIS"] and len(read("orbit_reliability_index")) == 4
    (hour,) = read("space_weather_hourly")
    assert hour.disturbance_level == "southward_bz" and read("satnogs_activity")[0].scheduled_count == 1
    head = open(f"{silver}/noaa_plasma_latest.csv").read().split("\n")[0]
    assert head.split(",")[-2:] == ["retrieved_at_utc", "source_url"] and "proton_speed_km_per_second" in head
    assert len(open(f"{silver}/sw_indices_latest.csv").read().strip().split("\n")) == 2  # no forecast
    # an hour later nothing is due; later on all is, and what was pending is asked for by id
    for f in (tmp_path / "bronze").rglob("*.*"):
        os.utime(f, (NOW.timestamp(), NOW.timestamp()))
    from datetime import timedelta

    asked = len(web.asked)
    got = pipeline.run(spark, root, out, str(tmp_path / "lock"), str(tmp_path / "log"), silver, get=web, at=NOW + timedelta(hours=1), wait=pauses.append)
    assert [e["status"] for e in got[:4]] == ["skipped"] * 4 and len(web.asked) == asked
    later = NOW + timedelta(hours=30)
    web.day = 31
    got = pipeline.run(spark, root, out, str(tmp_path / "lock"), str(tmp_path / "log"), silver, get=web, at=later, wait=pauses.append)
    assert {e["status"] for e in got} == {"success"} and [u.split("id=")[1] for u in web.asked if "&id=" in u] == ["1", "2"]
    assert read("satnogs_activity")[0].good_count == 3 and len(read("orbit_change")) == 4


def test_one_bad_feed_lands_neither(tmp_path):
    def get(url):
        return b"[]" if "wind" in url else Web()(url)

    with pytest.raises(ValueError, match="plasma"):
        ingest.solar_wind(get, str(tmp_path / "b"), str(tmp_path / "s"), NOW)
    assert not (tmp_path / "b").exists()


def test_older_layouts_are_upgraded(spark, tmp_path):
    home = str(tmp_path)
    schema = "file_path string, source string, snapshot_at_utc timestamp, sha256 string, loaded_at_utc timestamp, row_count int"
    spark.createDataFrame([("f", "celestrak", NOW, "s", NOW, 1), ("o", "satnogs", NOW, "s", NOW, 1)], schema).write.parquet(f"{home}/bronze_file_registry")
    rows(spark, "orbital_snapshot_history", orbit()).drop(*history.ELEMENT_COLUMNS, "source_group").write.parquet(f"{home}/orbital_snapshot_history/load=a")
    observed = rows(spark, "satnogs_observation_history", {"observation_id": 1, "satellite_id": "7", "source_file": "o", "source_sha256": "s"})
    observed.withColumn("satellite_id", F.col("satellite_id").cast("long")).write.parquet(f"{home}/satnogs_observation_history/load=a")
    observed.withColumn("satellite_id", F.lit("A-B")).withColumn("observation_id", F.lit(2).cast("long")).write.parquet(f"{home}/satnogs_observation_history/load=b")
    rows(spark, "noaa_plasma_history", plasma()).write.parquet(f"{home}/noaa_plasma_history/load=a")
    assert "source_group" not in history.describe(spark, home)["orbital_snapshot_history"]
    assert history.upgrade(spark, home) == {"orbital_snapshot_history": "reset", "satnogs_observation_history": "filled"}
    assert [r.file_path for r in history.read_registry(spark, home).collect()] == ["o"]
    assert sorted(r.satellite_id for r in history.read_history(spark, home, "satnogs_observation_history").collect()) == ["7", "A-B"]
    assert history.upgrade(spark, home) == {}


def test_an_upgrade_that_stopped_is_finished(spark, tmp_path):
    home = str(tmp_path)
    spark.createDataFrame([("f", "noaa", NOW, "s", NOW, 1)], "file_path string, source string, snapshot_at_utc timestamp, sha256 string, loaded_at_utc timestamp, row_count int").write.parquet(f"{home}/bronze_file_registry")
    rows(spark, "noaa_plasma_history", plasma()).write.parquet(f"{home}/noaa_plasma_history.upgraded")
    assert history.upgrade(spark, home) == {"noaa_plasma_history": "filled"} and history.read_history(spark, home, "noaa_plasma_history").count() == 1


def test_a_consumer_stops_when_nothing_comes(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for i in range(3):
        sinks.append_json_line(str(folder / f"{i}.json"), {"run_id": f"r{i}", "step": "s", "status": "success"})
    seen_ids = []
    began = time.monotonic()
    n = events.consume(events.run_events(spark, str(folder)), lambda b: seen_ids.extend(r.run_id for r in b.collect()), idle_s=1.0, wait_s=30.0)
    assert n == 3 and sorted(seen_ids) == ["r0", "r1", "r2"] and time.monotonic() - began < 25
    empty = tmp_path / "none"
    empty.mkdir()
    assert events.consume(events.run_events(spark, str(empty)), print, wait_s=0.5) == 0


def test_publishing_counts_or_is_skipped(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(4):
        sinks.append_json_line(log, {"run_id": f"r{i}", "step": "s", "status": "success"})
    sent = []
    assert sinks.publish(bronze.read_run_log(spark, log), "host", "t", lambda rows: sent.extend(rows.collect())) == 4 and len(sent) == 4
    ok = pipeline.run_step(None, "r", "publish", pipeline.publish_step(spark, log, "host", "t", lambda rows: rows.collect()))
    assert (ok["status"], ok["stdout"]) == ("success", "4 events")

    def refuse(_):
        raise OSError("no broker")

    assert pipeline.run_step(None, "r", "publish", pipeline.publish_step(spark, log, "host", "t", refuse))["status"] == "skipped"


def test_order_and_missing_inputs(spark):
    names = pipeline.order()
    assert len(names) == 20 and all(names.index(n) < names.index(t) for t, (needs, _) in pipeline.TABLES.items() for n in needs if n in pipeline.TABLES)
    assert pipeline.order(["freshness_by_band"]) == ["element_freshness", "freshness_by_band"]
    assert set(pipeline.build({"orbital_snapshot_history": rows(spark, "orbital_snapshot_history")}, ["orbit_change", "debris_population"])) == {"orbit_change"}


def test_steps_stop_at_a_failure_and_pass_over_skips(spark, tmp_path):
    def fail():
        raise RuntimeError("no")

    def skip():
        raise pipeline.Skip("nothing new")

    got = pipeline.run_steps(None, [("a", skip), ("b", lambda: "done"), ("c", fail), ("d", lambda: 1)])
    assert [(e["step"], e["status"], e["return_code"]) for e in got] == [("a", "skipped", 2), ("b", "success", 0), ("c", "failed", 1)]
    assert pipeline.run_step(None, "r", "slow", lambda: time.sleep(0.3), timeout_s=0.05)["status"] == "timeout"


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with pipeline.lock(path) as refresh:
        refresh()
        with pytest.raises(pipeline.Locked), pipeline.lock(path):
            pass
    assert not os.path.exists(path)
    open(path, "w").close()
    os.utime(path, (0, 0))
    with pipeline.lock(path):
        assert os.path.getmtime(path) > 1e9


def test_due(tmp_path):
    f = tmp_path / "x"
    f.touch()
    os.utime(f, (1000, 1000))
    assert pipeline.is_due([], 10) and pipeline.is_due([str(f)], 10, now=1010) and not pipeline.is_due([str(f)], 10, now=1009)


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for i in range(3):
        sinks.append_json_line(str(folder / f"{i}.json"), {"run_id": f"r{i}", "step": "s", "status": "success" if i else "failed"})
    stream = events.drain(events.status_counts(events.run_events(spark, str(folder))), "counts", "complete")
    batch = events.status_counts(bronze.read_run_log(spark, str(folder)))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect())) == [("failed", 1), ("success", 2)]
    assert "failed" in events.event_line({"run_id": "r", "step": "s", "status": "failed"})


def test_newest_version_wins_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "table")
    apply = events.upsert_newest(path, ["id"], "seen")
    batches = [[(1, 5, "b"), (2, 1, "x")], [(1, 3, "late")], [(1, 9, "c")], [(1, 9, "c")]]
    for i, b in enumerate(batches):
        apply(spark.createDataFrame(b, "id int, seen int, v string"), i)
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, 9, "c"), (2, 1, "x")]


def test_a_batch_rewrites_the_parts_of_its_keys_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda *rows: spark.createDataFrame(rows, "id int, seen int, v string")
    apply = events.upsert_newest(path, ["id"], "seen")
    apply(frame(*[(i, 1, "a") for i in range(300)]), 0)
    before = sinks._parts(spark, path, sinks._manifests(spark, path)[-1])
    apply(frame((5, 2, "b"), (999, 1, "new")), 1)
    after = sinks._parts(spark, path, sinks._manifests(spark, path)[-1])
    assert 1 <= sum(after[k] != before.get(k) for k in after) <= 2
    assert {r.id: r.v for r in sinks.read_table(spark, path).collect()} == {i: "a" for i in range(300)} | {5: "b", 999: "new"}


def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = lambda: sorted(r.id for r in sinks.read_table(spark, path).collect())
    sinks.replace_table(spark.range(3), path)
    commit = sinks._commit

    def stop(*_):
        raise RuntimeError("stopped")

    for call in (lambda: sinks.replace_table(spark.range(9), path), lambda: sinks.upsert(spark.range(9).selectExpr("id", "1 AS seen"), path + "2", ["id"], "seen")):
        monkeypatch.setattr(sinks, "_commit", stop)
        with pytest.raises(RuntimeError):
            call()
        monkeypatch.setattr(sinks, "_commit", commit)
        assert rows() == [0, 1, 2]
    assert not sinks.has_table(spark, path + "2")
    # the next version may be made of the one that it replaces, and what was left behind goes
    for n in (4, 5, 6):
        sinks.replace_table(sinks.read_table(spark, path).union(spark.range(n - 1, n)).distinct(), path)
        assert rows() == list(range(3)) + list(range(3, n))
    assert len([x for x in os.listdir(path) if x.startswith("data-")]) == 2 and len(sinks._manifests(spark, path)) == 2
    plain = str(tmp_path / "plain")
    spark.range(2).write.parquet(plain)
    assert sinks.read_table(spark, plain).count() == 2


def test_hours_close_once_the_watermark_has_passed(spark, tmp_path):
    src = tmp_path / "obs"
    data = [(datetime(2026, 8, 30, h, m, tzinfo=timezone.utc), -1.0, 400.0) for h in range(6) for m in (0, 30)]
    spark.createDataFrame(data, "observed_at timestamp, bz double, speed double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("observed_at timestamp, bz double, speed double").parquet(str(src))
    got = events.drain(events.hourly_weather(stream), "hours", "append").orderBy("hour_utc").collect()
    assert [r.hour_utc.hour for r in got] == [0, 1, 2] and all(r.minute_count == 2 for r in got)


def test_mirror_and_reports(spark, tmp_path):
    root = tmp_path / "from"
    root.mkdir()
    (root / "a").write_text("1")
    have = spark.createDataFrame([(str(root / "a"), sinks.file_sha256(str(root / "a")))], "path string, sha256 string")
    todo = sinks.to_mirror(have, have.limit(0))
    assert sinks.to_mirror(have, have).count() == 0
    done = sinks.mirror(todo, str(root), str(tmp_path / "to"), str(tmp_path / "report")).first()
    assert (done.bytes, done.sha256, done.error) == (1, todo.first().sha256, None) and (tmp_path / "to/a").read_text() == "1"
    sinks.write_csv(have, str(tmp_path / "csv"), single=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["path", "sha256"]
    p = sinks.land(str(root), "celestrak", "stations", NOW, b"x")
    assert p.endswith("stations_20260830T120000Z.csv")
    with pytest.raises(FileExistsError):
        sinks.land(str(root), "celestrak", "stations", NOW, b"y")
    assert "| a |" in serve.report({"things": [{"a": 1}], "none": []})


def test_metrics_and_panels(spark):
    none = {"satnogs_activity": spark.createDataFrame([], "observation_count long, good_count long, completed_count long, scheduled_count long"), "noaa_magnetic_history": rows(spark, "noaa_magnetic_history")}
    gauges = serve.metrics(none)
    got = {r.name: r.value for r in gauges.collect()}
    assert got["database_reachable"] == 1 and got["magnetic_history_rows"] == 0 and got["satnogs_observations"] == 0 and "satnogs_good_percent_of_completed" not in got
    assert len(serve.PANELS) == 19 and serve.panels(gauges).select("panel").distinct().count() == 19
    text = serve.exposition(serve.metrics({"validation_stats": spark.createDataFrame([("pairs", 2.0)], "metric string, value double")}))
    assert 'orbit_validation_metric{metric="pairs"} 2.0' in text


def test_health_counts_absent_tables_as_empty(spark):
    got = {r.table: r.rows for r in serve.health(spark, {"noaa_plasma_history": rows(spark, "noaa_plasma_history", plasma())}).collect()}
    assert got == {t: 0 for t in serve.HEALTH} | {"noaa_plasma_history": 1}
    assert serve.health(spark, {}).count() == 5


def test_research_report_has_the_sections_of_its_tables(spark):
    from stellarframe.plans import catalogue, gold, measure

    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    o, hourly, measured = t.orbital(), catalogue._hourly(t), catalogue._proxy(t)
    index = catalogue._index(t)
    found = measure.validation_pairs(measured, o)
    tables = {"orbital_snapshot_history": o, "orbit_change": gold.orbit_change(o), "propagation_disagreement": measured, "validation_bins": measure.validation_bins(found), "validation_stats": measure.validation_stats(found, measured), "reliability_class_summary": gold.reliability_class_summary(index), "orbit_reliability_index": index, "space_weather_hourly": hourly, "debris_population": gold.debris_population(catalogue._features(t))}
    text = serve.research_report(tables, "2026-08-30")
    shown = [s for s, needs in serve.SECTIONS.items() if all(n in tables for n in needs)]
    assert [x[3:] for x in text.split("\n") if x.startswith("## ")] == [*shown, "Limits"] and len(shown) == 7
    assert "### Largest changes" in text and "median_along_track_km" in text
    assert set(serve.sections(tables)) == set(shown)
    assert serve.probe(serve.panels(serve.metrics({"noaa_magnetic_history": rows(spark, "noaa_magnetic_history", magnetic())}))).where("status = 'ok'").count() == 1
