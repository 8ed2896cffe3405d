"""One run: due sources, an exclusive lock, steps with their log, and the derived tables in order of their needs."""

from __future__ import annotations

import glob
import os
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, quality
from ..sources import bronze, ingest, sinks
from . import gold, measure, model, serve

STEP_TIMEOUT_S = 300
STALE_LOCK_S = 2 * STEP_TIMEOUT_S + 300
INTERVAL_S = {"celestrak": 2 * 3600, "noaa": 2 * 3600, "satnogs": 2 * 3600, "spaceweather": 3 * 3600}
SUCCESS, SKIPPED, TIMEOUT, FAILED = "success", "skipped", "timeout", "failed"

#: Derived table: what it needs, and its builder.
TABLES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "orbit_snapshot_summary": (("orbital_snapshot_history",), gold.orbit_snapshot_summary),
    "space_weather_snapshot_summary": (("noaa_magnetic_history", "noaa_plasma_history"), gold.space_weather_snapshot_summary),
    "space_weather_minute": (("noaa_magnetic_history", "noaa_plasma_history"), gold.space_weather_minute),
    "orbit_features": (("silver_orbits",), gold.orbit_features),
    "orbit_band_summary": (("orbit_features",), gold.orbit_band_summary),
    "propagation_disagreement": (("orbital_snapshot_history",), measure.propagation_disagreement),
    "validation_pairs": (("propagation_disagreement", "orbital_snapshot_history"), measure.validation_pairs),
    "validation_bins": (("validation_pairs",), measure.validation_bins),
    "validation_stats": (("validation_pairs", "propagation_disagreement"), measure.validation_stats),
    "orbit_change": (("orbital_snapshot_history",), gold.orbit_change),
    "space_weather_hourly": (("space_weather_minute",), gold.space_weather_hourly),
    "element_freshness": (("orbital_snapshot_history",), gold.element_freshness),
    "freshness_by_group": (("element_freshness",), gold.freshness_by_group),
    "freshness_by_band": (("element_freshness",), gold.freshness_by_band),
    "orbit_reliability_index": (("orbital_snapshot_history", "space_weather_hourly"), gold.orbit_reliability_index),
    "reliability_class_summary": (("orbit_reliability_index",), gold.reliability_class_summary),
    "reliability_group_summary": (("orbit_reliability_index",), gold.reliability_group_summary),
    "sw_index_daily": (("space_weather_index_history",), gold.sw_index_daily),
    "satnogs_activity": (("satnogs_observation_history",), gold.satnogs_activity),
    "debris_population": (("orbit_features",), gold.debris_population),
}


class Locked(RuntimeError):
    """Another run holds the lock."""


def order(wanted: list[str] | None = None) -> list[str]:
    """The wanted derived tables with all that they need, needs first."""
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...] = ()) -> None:
        if name in path:
            raise ValueError(f"circle: {' > '.join([*path, name])}")
        if name in TABLES and name not in out:
            for need in TABLES[name][0]:
                visit(need, (*path, name))
            out.append(name)

    for name in wanted or TABLES:
        if name not in TABLES:
            raise KeyError(name)
        visit(name)
    return out


def build(inputs: dict[str, DataFrame], wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """Plans of the derived tables over `inputs`; tables whose inputs are absent are left out."""
    have = dict(inputs)
    for name in order(wanted):
        needs, builder = TABLES[name]
        if all(n in have for n in needs):
            have[name] = builder(*(have[n] for n in needs))
    return {k: v for k, v in have.items() if k in TABLES}


def write_gold(spark: SparkSession, inputs: dict[str, DataFrame], root: str, wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """Write the derived tables, each read back as the next ones' input."""
    have = dict(inputs)
    for name in order(wanted):
        needs, builder = TABLES[name]
        if all(n in have for n in needs):
            sinks.replace_table(builder(*(have[n] for n in needs)), f"{root}/{name}")
            have[name] = sinks.read_table(spark, f"{root}/{name}")
    return {k: v for k, v in have.items() if k in TABLES}


def is_due(files: list[str], interval_s: float, now: float | None = None) -> bool:
    """Whether the newest file is at least `interval_s` old, or there is none."""
    newest = max((os.path.getmtime(f) for f in files if os.path.exists(f)), default=None)
    return newest is None or (time.time() if now is None else now) - newest >= interval_s


@contextmanager
def lock(path: str, stale_s: float = STALE_LOCK_S):
    """An exclusive lock file; one that nobody has refreshed for `stale_s` is taken over. Yields a way to refresh it."""
    token = uuid.uuid4().hex
    for _ in range(2):
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(token)
            break
        except FileExistsError:
            try:
                stale = time.time() - os.path.getmtime(path) > stale_s
            except FileNotFoundError:
                continue
            if not stale:
                raise Locked(path) from None
            aside = f"{path}.{token}"
            try:
                os.rename(path, aside)  # one taker only succeeds
                os.unlink(aside)
            except FileNotFoundError:
                pass
    else:
        raise Locked(path)
    try:
        yield lambda: os.utime(path)
    finally:
        try:
            if Path(path).read_text(encoding="utf-8") == token:
                os.unlink(path)
        except FileNotFoundError:
            pass


class Skip(Exception):
    """A step that has nothing to do says so."""


def run_step(spark: SparkSession | None, run_id: str, name: str, work: Callable[[], object], log: str | None = None, timeout_s: float = STEP_TIMEOUT_S) -> dict:
    """Run one step and log how it went; what takes longer than `timeout_s` has its Spark jobs cancelled."""
    import threading

    started, began = datetime.now(timezone.utc), time.monotonic()
    tag, late = f"{run_id}-{name}", threading.Event()

    def stop() -> None:
        late.set()
        if spark is not None:
            spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    timer.daemon = True
    if spark is not None:
        spark.sparkContext.addJobTag(tag)
    timer.start()
    status, note = SUCCESS, ""
    try:
        note = str(work() or "")
    except Skip as e:
        status, note = SKIPPED, str(e)
    except Exception as e:
        status, note = TIMEOUT if late.is_set() else FAILED, f"{type(e).__name__}: {e}"[:2000]
    finally:
        timer.cancel()
        if spark is not None:
            spark.sparkContext.removeJobTag(tag)
    if status == SUCCESS and late.is_set():
        status = TIMEOUT
    code = {SUCCESS: 0, SKIPPED: 2, TIMEOUT: 124, FAILED: 1}[status]
    event = {"run_id": run_id, "step": name, "status": status, "started_at_utc": started.isoformat(), "duration_seconds": round(time.monotonic() - began, 3), "return_code": code, "command": name, "stdout": note if status in (SUCCESS, SKIPPED) else "", "stderr": "" if status in (SUCCESS, SKIPPED) else note}
    if log:
        sinks.append_json_line(log, event)
    return event


def run_steps(spark: SparkSession | None, steps: list[tuple[str, Callable[[], object]]], log: str | None = None, refresh: Callable[[], object] = lambda: None, timeout_s: float = STEP_TIMEOUT_S) -> list[dict]:
    """Steps in order, until one fails or takes too long; a skipped one doesn't stop the run."""
    run_id, events = uuid.uuid4().hex, []
    for name, work in steps:
        refresh()
        events.append(run_step(spark, run_id, name, work, log, timeout_s))
        if events[-1]["status"] in (FAILED, TIMEOUT):
            break
    return events


def ingest_steps(spark: SparkSession, get: ingest.Get, bronze_root: str, silver_root: str, at: datetime, wait: Callable[[float], None] = time.sleep) -> list[tuple[str, Callable[[], object]]]:
    """A step for each source, which is skipped while its newest landed file is younger than the source's interval."""
    files = lambda pattern: glob.glob(f"{bronze_root}/{pattern}")
    due = lambda source, pattern: is_due(files(pattern), INTERVAL_S[source], at.timestamp())

    def elements() -> str:
        groups = [g for g in bronze.GROUPS if due("celestrak", f"celestrak/{g}_2*.csv")]
        if not groups:
            raise Skip("no group is due")
        return str(ingest.elements(get, bronze_root, silver_root, at, groups))

    def solar_wind() -> str:
        if not due("noaa", "noaa/*.json"):
            raise Skip("not due")
        return str(ingest.solar_wind(get, bronze_root, silver_root, at))

    def indices() -> str:
        if not due("spaceweather", "spaceweather/*.csv"):
            raise Skip("not due")
        return str(ingest.indices(get, bronze_root, silver_root, at))

    def observations() -> str:
        if not due("satnogs", "satnogs/*.json"):
            raise Skip("not due")
        landed = files("satnogs/*.json")
        pending = [r["observation_id"] for r in bronze.pending_ids(bronze.read_raw(spark, "satnogs", landed), F.lit(at).cast("timestamp")).collect()] if landed else []  # ten at most
        return str(ingest.observations(get, bronze_root, silver_root, at, pending, wait=wait))

    return [("ingest_elements", elements), ("ingest_solar_wind", solar_wind), ("ingest_indices", indices), ("ingest_observations", observations)]


@dataclass(frozen=True)
class Extras:
    """What a run does beside the tables, each only where it is asked for: train the regression (with these settings), write the research
    report, copy the raw files that another store lacks, and send the run's log."""

    train: dict | None = None
    report: str | None = None
    mirror_to: str | None = None
    publish: tuple[str, str] | None = None
    send: Callable[[DataFrame], None] | None = None


def extra_steps(spark: SparkSession, extras: Extras, bronze_root: str, root: str, log: str, at: datetime) -> list[tuple[str, Callable[[], object]]]:
    """A step for each of the extras; one that has too little to work on, or nobody to send to, is skipped."""

    def known() -> dict[str, DataFrame]:
        """All tables that are there."""
        tables = {t: history.read_history(spark, f"{root}/history", t) for t in quality.SOURCES}
        return tables | {t: sinks.read_table(spark, f"{root}/gold/{t}") for t in TABLES if sinks.has_table(spark, f"{root}/gold/{t}")}

    def train() -> str:
        pairs = sinks.read_table(spark, f"{root}/gold/validation_pairs")
        try:
            score = model.scores(model.cross_validated(pairs, f"{root}/model/folds", **extras.train))
        except model.TooFewRows as e:
            raise Skip(str(e)) from e
        _, importance = model.train(pairs, f"{root}/model/latest", **extras.train)
        found = model.write_summary(score, importance, f"{root}/model/summary.json", f"{root}/model/runs.jsonl", **extras.train)
        return f"{found['scores']['pairs']} pairs"

    def report() -> str:
        text = serve.research_report(known(), at.isoformat())
        Path(extras.report).write_text(text, encoding="utf-8")
        return f"{len(text)} characters"

    def copy() -> str:
        mine = bronze.listing(spark, bronze_root).select(F.col("file_path").alias("path"), "sha256")
        base, target = (p.removeprefix("file:").rstrip("/") for p in (bronze_root, extras.mirror_to))
        if history._has_files(spark, extras.mirror_to):
            there = bronze.listing(spark, extras.mirror_to)
            # a file is the same if it lies at the same place below its root
            below = F.expr(f"substring(regexp_replace(file_path, '^file:/*', '/'), {len(target) + 1})")
            same = there.select(below.alias("place"), "sha256")
            mine = mine.withColumn("place", F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(base) + 1})")).join(same, ["place", "sha256"], "left_anti")
        done = sinks.mirror(mine.select("path"), bronze_root, extras.mirror_to, f"{root}/mirrored").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).first()
        if done["bad"]:
            raise OSError(f"{done['bad']} of {done['n']} files were not copied; see {root}/mirrored")
        return f"{done['n']} files"

    wanted = [("train_model", train, extras.train is not None), ("write_report", report, extras.report), ("mirror_bronze", copy, extras.mirror_to)]
    steps = [(name, work) for name, work, given in wanted if given]
    return [*steps, ("publish_events", publish_step(spark, log, *extras.publish, extras.send))] if extras.publish else steps


def run(spark: SparkSession, bronze_root: str, root: str, lock_path: str, log: str, silver_root: str | None = None, *, get: ingest.Get | None = None, at: datetime | None = None, wait: Callable[[float], None] = time.sleep, extras: Extras | None = None) -> list[dict]:
    """Collect what is due (with `get`, which fetches a URL), load, check, build all derived tables, and do the `extras`.

    A failed check stops the run before any derived table is built. `silver_root` holds the current files; without it the
    tables made of them are left out.
    """
    def load() -> str:
        upgraded = history.upgrade(spark, f"{root}/history")
        return f"{history.load(spark, bronze_root, f'{root}/history')} {upgraded or ''}".strip()

    def tables() -> dict[str, DataFrame]:
        return {t: history.read_history(spark, f"{root}/history", t) for t in quality.SOURCES}

    def check() -> str:
        files = bronze.unloadable(bronze.found(spark, bronze_root))
        results = quality.gate(tables(), history.read_registry(spark, f"{root}/history"), files).select(F.current_timestamp().alias("checked_at_utc"), "*")
        sinks.write_json_report(results, f"{root}/quality", f"{root}/quality_csv")
        bad = [r["check_name"] for r in quality.read_report(spark, f"{root}/quality").where("status = 'fail'").collect()]
        if bad:
            raise ValueError(f"failed: {', '.join(sorted(bad))}")
        return "passed"

    def derive() -> str:
        inputs = tables()
        if silver_root and glob.glob(f"{silver_root}/*_satellites_latest.csv"):
            inputs["silver_orbits"] = bronze.read_silver_orbits(spark, f"{silver_root}/*_satellites_latest.csv")
        return f"{len(write_gold(spark, inputs, f'{root}/gold'))} tables"

    collect = ingest_steps(spark, get, bronze_root, silver_root or f"{root}/silver", at or ingest.now(), wait) if get else []
    with lock(lock_path) as refresh:
        more = extra_steps(spark, extras, bronze_root, root, log, at or ingest.now()) if extras else []
        return run_steps(spark, [*collect, ("load_history", load), ("check_quality", check), ("build_gold", derive), *more], log, refresh)


def publish_step(spark: SparkSession, log: str, servers: str, topic: str, send: Callable[[DataFrame], None] | None = None) -> Callable[[], str]:
    """A step that sends the run log; it is skipped where nothing could be delivered."""
    def work() -> str:
        try:
            return f"{sinks.publish(bronze.read_run_log(spark, log), servers, topic, send)} events"
        except sinks.Undelivered as e:
            raise Skip(str(e)) from e

    return work
