"""The loader: raw files into append-only history, each file once, whole or not at all.

Rows are written first, under a folder for their load, the registry last; readers take only rows whose file and
checksum the registry names. A load that dies in between leaves nothing that anyone sees, and the next one loads
those files again. A registered path whose content has changed is an error.

An index has length, time and digest of each file that was loaded; files that still look so are not read again, so that a load
costs what is new. `audit` reads all of them.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expr as X
from ..functions import sketches
from ..sources import bronze

TABLE_OF = {"celestrak": "orbital_snapshot_history", "magnetic_field": "noaa_magnetic_history", "plasma": "noaa_plasma_history", "spaceweather": "space_weather_index_history", "satnogs": "satnogs_observation_history"}

#: Columns whose distinct values gauges count: their sketches are kept with each load. Each has the table's rows beside it.
SKETCHED = {"orbital_snapshot_history": ("norad_catalog_id", "snapshot_at_utc"), "noaa_magnetic_history": ("snapshot_at_utc",), "noaa_plasma_history": ("snapshot_at_utc",), "satnogs_observation_history": ("norad_catalog_id", "station_id")}
SKETCHES = f"table string, source_file string, source_sha256 string, {sketches.SCHEMA}"


class ModifiedFile(ValueError):
    """A file that was loaded before now has other content."""


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/bronze_file_registry"
    return spark.read.schema(schemas.REGISTRY).parquet(path) if _has_files(spark, path) else spark.createDataFrame([], schemas.REGISTRY)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/bronze_file_index"
    return spark.read.schema(schemas.FILE_INDEX).parquet(path) if _has_files(spark, path) else spark.createDataFrame([], schemas.FILE_INDEX)


def unread(files: DataFrame, index: DataFrame, registry: DataFrame) -> DataFrame:
    """The files that are not known to be loaded as they look now."""
    loaded = index.join(registry.select("file_path", "sha256"), ["file_path", "sha256"], "left_semi")
    return files.join(loaded.select("file_path", "length", "modified_at"), ["file_path", "length", "modified_at"], "left_anti")


def audit(spark: SparkSession, bronze_root: str, root: str) -> DataFrame:
    """(file_path, known, sha256) of registered files whose content is another one now, or gone (null); all content is read."""
    known = read_registry(spark, root).select("file_path", F.col("sha256").alias("known"))
    there = bronze.listing(spark, bronze_root).select("file_path", "sha256")
    return known.join(there, "file_path", "left").where(~F.col("known").eqNullSafe(F.col("sha256"))).select("file_path", "known", "sha256")


def read_history(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of registered files."""
    path, schema = f"{root}/{table}", schemas.struct(schemas.HISTORY[table])
    if not _has_files(spark, path):
        return spark.createDataFrame([], schema)
    known = read_registry(spark, root).select(F.col("file_path").alias("source_file"), F.col("sha256").alias("source_sha256"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.join(known, ["source_file", "source_sha256"], "left_semi").select(schema.fieldNames())


def typed(kind: str, raw: DataFrame) -> DataFrame:
    """Text columns of raw rows (with snapshot_at_utc, priority, source_file, source_sha256) to those of the history table."""
    n, ts = X.number, lambda c: X.text_or_null(c).try_cast("timestamp_ntz")
    q = lambda c: F.col(f"`{c}`")
    out = {"snapshot_at_utc": F.col("snapshot_at_utc")}
    if kind == "celestrak":
        group = F.regexp_extract("source_file", r"/([a-z0-9-]+)_\d{8}T\d{6}Z\.csv$", 1)
        out |= {"object_name": X.text_or_null("OBJECT_NAME"), "norad_catalog_id": n("NORAD_CAT_ID", "long"), "element_epoch_utc": ts("EPOCH"), "inclination_degrees": n("INCLINATION"), "eccentricity": n("ECCENTRICITY"), "mean_motion_revolutions_per_day": n("MEAN_MOTION"), "bstar_drag_term": n("BSTAR"), "ra_of_asc_node_degrees": n("RA_OF_ASC_NODE"), "arg_of_pericenter_degrees": n("ARG_OF_PERICENTER"), "mean_anomaly_degrees": n("MEAN_ANOMALY"), "mean_motion_dot": n("MEAN_MOTION_DOT"), "mean_motion_ddot": n("MEAN_MOTION_DDOT"), "source_group": group}
    elif kind in ("magnetic_field", "plasma"):
        values = ("bt", "bx_gsm", "by_gsm", "bz_gsm") if kind == "magnetic_field" else ("proton_speed", "proton_temperature", "proton_density")
        out |= {"observed_at_utc": ts("time_tag"), "spacecraft": X.text_or_null("source"), "is_active_source": X.flag("active"), **{v: n(v) for v in values}, "quality_code": n("overall_quality", "long").cast("int")}
    elif kind == "spaceweather":
        out |= {"observation_date": X.text_or_null("DATE").try_cast("date"), **{f"kp{i}": n(f"KP{i}") for i in range(1, 9)}, "kp_sum": n("KP_SUM"), "ap_avg": n("AP_AVG"), "sunspot_number": n("ISN"), "f10_7_observed": n(q("F10.7_OBS")), "f10_7_data_type": X.text_or_null(q("F10.7_DATA_TYPE"))}
        raw = raw.where(X.text_or_null("KP1").isNotNull())
    else:
        out |= {"observation_id": n("id", "long"), "start_utc": ts("start"), "end_utc": ts("end"), "status": X.text_or_null("status"), "norad_catalog_id": n("norad_cat_id", "long"), "satellite_id": X.text_or_null("sat_id"), "station_id": n("ground_station", "long"), "station_lat": n("station_lat"), "station_lng": n("station_lng"), "observation_frequency_hz": n("observation_frequency"), "transmitter_mode": X.text_or_null("transmitter_mode")}
    names = schemas.struct(schemas.HISTORY[TABLE_OF[kind]]).fieldNames()
    return raw.select(*[out.get(c, F.col(c)).alias(c) for c in names if c in out or c in ("source_file", "source_sha256")], "priority")


def new_rows(kind: str, rows: DataFrame, history: DataFrame) -> DataFrame:
    """`rows` without those that history, or an earlier one of them, already says."""
    if kind in ("magnetic_field", "plasma"):
        return rows.drop("priority")
    if kind == "celestrak":  # one row of an object for each snapshot, by priority of its group
        rows = rows.where("norad_catalog_id IS NOT NULL")
        keys, order = ["snapshot_at_utc", "norad_catalog_id"], [F.asc("priority"), F.asc("source_file"), F.asc_nulls_last("element_epoch_utc")]
        known = history.select(*keys)
    else:  # one row for each content
        skip = {"snapshot_at_utc", "source_file", "source_sha256", "priority"}
        rows = rows.where("observation_id IS NOT NULL") if kind == "satnogs" else rows.where("observation_date IS NOT NULL")
        values = [c for c in rows.columns if c not in skip]
        rows = rows.withColumn("_hash", X.content_hash(*values))
        keys, order = ["_hash"], [F.asc("snapshot_at_utc"), F.asc("source_file")]
        known = history.select(X.content_hash(*values).alias("_hash"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1")
    return first.join(known, keys, "left_anti").drop("_r", "_hash", "priority")


def read_sketches(spark: SparkSession, root: str) -> DataFrame:
    """(table, column, rows, sketch) of each load that the registry has; a load is named by one of its files."""
    path = f"{root}/distinct_sketches"
    if not _has_files(spark, path):
        return spark.createDataFrame([], SKETCHES).drop("source_file", "source_sha256")
    known = read_registry(spark, root).select(F.col("file_path").alias("source_file"), F.col("sha256").alias("source_sha256"))
    rows = spark.read.schema(SKETCHES).option("recursiveFileLookup", "true").parquet(path)
    return rows.join(known, ["source_file", "source_sha256"], "left_semi").drop("source_file", "source_sha256")


def _write_sketches(rows: DataFrame, table: str, file: tuple[str, str], path: str) -> None:
    about = [F.lit(table).alias("table"), F.lit(file[0]).alias("source_file"), F.lit(file[1]).alias("source_sha256")]
    sketches.sketched(rows, SKETCHED[table]).select(*about, "column", "rows", "sketch").coalesce(1).write.mode("overwrite").parquet(path)


def fill_sketches(spark: SparkSession, root: str) -> None:
    """Sketches of a history that was loaded before there were any."""
    for kind, table in TABLE_OF.items():
        first = read_registry(spark, root).where(F.col("source") == kind).select("file_path", "sha256").first()
        if first and table in SKETCHED:
            _write_sketches(read_history(spark, root, table), table, tuple(first), f"{root}/distinct_sketches/load=before/{table}")


def load(spark: SparkSession, bronze_root: str, root: str) -> dict[str, int]:
    """Load what is new below `bronze_root` into the history below `root`; rows added by table."""
    registry = read_registry(spark, root)
    files = bronze.found(spark, bronze_root).where("source IS NOT NULL AND snapshot_at_utc IS NOT NULL")
    known = registry.select("file_path", F.col("sha256").alias("known"))
    # names and checksums alone are kept, so that each file is read once
    seen = bronze.digests(unread(files, read_index(spark, root), registry)).join(known, "file_path", "left").persist()
    try:
        changed = [r["file_path"] for r in seen.where("known <> sha256").select("file_path").limit(5).collect()]
        if changed:
            raise ModifiedFile(f"content changed under {', '.join(changed)}")
        read = seen.collect()  # a row for each new file
    finally:
        seen.unpersist()
    fresh = [f for f in read if f["known"] is None]
    if fresh and _has_files(spark, f"{root}/bronze_file_registry") and not _has_files(spark, f"{root}/distinct_sketches"):
        fill_sketches(spark, root)
    added, load_id = {}, uuid.uuid4().hex
    entries = []
    for kind, table in TABLE_OF.items():
        own = [f for f in fresh if f["source"] == kind]
        if not own:
            continue
        about = spark.createDataFrame([(f["file_path"], f["snapshot_at_utc"], f["priority"], f["sha256"]) for f in own], "file_path string, snapshot_at_utc timestamp, priority int, source_sha256 string")
        raw = bronze.read_raw(spark, kind, [f["file_path"] for f in own], {f["file_path"]: f["first_line"] for f in own}).join(about, "file_path").withColumnRenamed("file_path", "source_file")
        path = f"{root}/{table}/load={load_id}"
        new_rows(kind, typed(kind, raw), read_history(spark, root, table)).write.mode("overwrite").parquet(path)
        written = spark.read.schema(schemas.struct(schemas.HISTORY[table])).parquet(path)
        if table in SKETCHED:
            _write_sketches(written, table, (own[0]["file_path"], own[0]["sha256"]), f"{root}/distinct_sketches/load={load_id}/{table}")
        counts = {r["source_file"]: r["n"] for r in written.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).collect()}
        entries += [(f["file_path"], kind, f["snapshot_at_utc"], f["sha256"], counts.get(f["file_path"], 0)) for f in own]
        added[table] = sum(counts.values())
    if entries:
        done = spark.createDataFrame(entries, "file_path string, source string, snapshot_at_utc timestamp, sha256 string, row_count int")
        done.withColumn("loaded_at_utc", F.current_timestamp()).select(*schemas.struct(schemas.REGISTRY).fieldNames()).coalesce(1).write.mode("append").parquet(f"{root}/bronze_file_registry")
    if read:  # after the registry: without it they are read again
        names = schemas.struct(schemas.FILE_INDEX).fieldNames()
        spark.createDataFrame([tuple(f[c] for c in names) for f in read], schemas.FILE_INDEX).coalesce(1).write.mode("append").parquet(f"{root}/bronze_file_index")
    return added


#: Columns of a full element set; rows of a layout without them are worth nothing for propagation.
ELEMENT_COLUMNS = ("ra_of_asc_node_degrees", "arg_of_pericenter_degrees", "mean_anomaly_degrees", "mean_motion_dot", "mean_motion_ddot")


def describe(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """The tables that are there, with the columns and types of their files."""
    names = [t for t in (*schemas.HISTORY, "bronze_file_registry") if _has_files(spark, f"{root}/{t}")]
    return {t: dict(spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{t}").dtypes) for t in names}


def _layouts(spark: SparkSession, path: str) -> list[DataFrame]:
    """The rows of each load of a table, as they were written."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = here.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(here)
    folders = [x.getPath().toString() for x in found if x.isDirectory() and x.getPath().getName().startswith("load=")]
    return [spark.read.parquet(f) for f in folders] or [spark.read.parquet(path)]


def upgrade(spark: SparkSession, root: str) -> dict[str, str]:
    """Bring tables of an older layout to today's: table to what was done, `filled` or `reset`.

    Orbital rows without full elements are dropped, and their files struck from the registry, so that the next load reads
    those files again. Other tables are rewritten with `migrate`. The new rows are written beside the old ones before these
    go, and an upgrade that stopped in between is finished by the next. A table that was looked through gets a mark, so that
    it is looked through once for each layout.
    """
    done = {}
    if _has_files(spark, f"{root}/bronze_file_registry.upgraded/_SUCCESS"):
        _take_over(spark, f"{root}/bronze_file_registry.upgraded", f"{root}/bronze_file_registry")
    for table, layout in schemas.HISTORY.items():
        path = f"{root}/{table}"
        mark = f"{path}/_layout-{hashlib.sha256(layout.encode()).hexdigest()[:16]}"
        if _has_files(spark, f"{path}.upgraded/_SUCCESS"):
            _take_over(spark, f"{path}.upgraded", path)
            done[table] = "filled"
        if not _has_files(spark, path) or _has_files(spark, mark):
            continue
        wanted = {f.name: f.dataType.simpleString() for f in schemas.struct(layout).fields}
        loads = _layouts(spark, path)
        if table == "orbital_snapshot_history" and any(not set(ELEMENT_COLUMNS) <= set(x.columns) for x in loads):
            # rows that the registry does not name are not seen, so that nothing is counted twice if this stops here
            read_registry(spark, root).where("source <> 'celestrak'").coalesce(1).write.mode("overwrite").parquet(f"{root}/bronze_file_registry.upgraded")
            _take_over(spark, f"{root}/bronze_file_registry.upgraded", f"{root}/bronze_file_registry")
            _delete(spark, path)
            done[table] = "reset"
            continue
        if any(dict(x.dtypes) != wanted for x in loads):
            rows = migrate(loads[0], table)
            for x in loads[1:]:
                rows = rows.unionByName(migrate(x, table))
            rows.write.mode("overwrite").parquet(f"{path}.upgraded")
            _take_over(spark, f"{path}.upgraded", path)
            done[table] = "filled"
        here = spark._jvm.org.apache.hadoop.fs.Path(mark)
        here.getFileSystem(spark._jsc.hadoopConfiguration()).create(here).close()
    return done


def _delete(spark: SparkSession, path: str) -> None:
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    here.getFileSystem(spark._jsc.hadoopConfiguration()).delete(here, True)


def _take_over(spark: SparkSession, beside: str, path: str) -> None:
    _delete(spark, path)
    new, here = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    if not here.getFileSystem(spark._jsc.hadoopConfiguration()).rename(new, here):
        raise OSError(f"{beside} could not be moved to {path}")


def migrate(rows: DataFrame, table: str) -> DataFrame:
    """Rows of an older layout in today's: missing columns are null, an absent group is `stations`, types are widened."""
    schema = schemas.struct(schemas.HISTORY[table])
    out = []
    for f in schema.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, F.lit("stations")) if f.name == "source_group" else value).alias(f.name))
    return rows.select(*out)
