"""Raw files: where they lie, how each kind is read and checked, and what of them can't be loaded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import expr as X

GROUPS = ("stations", "cubesat", "science", "iridium-33-debris")
#: Kind of file by the end of its path.
PATTERNS = {
    "celestrak": r"/celestrak/[a-z0-9-]+_\d{8}T\d{6}Z\.csv$", "magnetic_field": r"/noaa/magnetic_field_\d{8}T\d{6}Z\.json$", "plasma": r"/noaa/plasma_\d{8}T\d{6}Z\.json$",
    "spaceweather": r"/spaceweather/sw_\d{8}T\d{6}Z\.csv$", "satnogs": r"/satnogs/observations_\d{8}T\d{6}Z\.json$",
}
#: Files are digested in blocks of so many bytes; what is looked at for the first line.
BLOCK_BYTES, HEAD_BYTES = 4 << 20, 1 << 16
#: Arrow's name of a file system where it is another than Hadoop's.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gcs"}
TERMINAL = ("good", "bad", "failed")
USER_AGENT = "stellarframe/1.0 (research)"


def stamp(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def fetch(url: str, timeout: float = 60) -> bytes:
    """The bytes of a resource; ingestion takes another fetcher in tests."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": USER_AGENT}), timeout=timeout) as got:  # noqa: S310
        return got.read()


def check_payload(kind: str, data: bytes) -> list[dict]:
    """The rows of a payload, or ValueError if it is empty or misses required fields. Forecast days are dropped."""
    if kind in ("celestrak", "spaceweather"):
        import csv
        import io

        rows = list(csv.DictReader(io.StringIO(data.decode("utf-8-sig"))))
        fields = set(rows[0]) if rows else set()
    else:
        rows = json.loads(data)
        if kind == "satnogs" and isinstance(rows, dict):
            rows = [rows]
        if not isinstance(rows, list):
            raise ValueError(f"{kind}: neither a list nor an object")
        fields = set(rows[0]) if rows and isinstance(rows[0], dict) else set()
        if not rows and kind == "satnogs":
            return []
    if not rows:
        raise ValueError(f"{kind}: no rows")
    if missing := sorted(set(schemas.REQUIRED[kind]) - fields):
        raise ValueError(f"{kind}: missing {', '.join(missing)}")
    return [r for r in rows if (r.get("KP1") or "").strip()] if kind == "spaceweather" else rows


def collect_observations(get: Callable[[str], bytes], listing: str, sweeps: Iterable[str], by_id: Iterable[str]) -> list[dict]:
    """The listing (which must succeed), then one request per final status and pending id; later answers win, order is by id."""
    found = {r["id"]: r for r in check_payload("satnogs", get(listing)) if r.get("id") is not None}
    for url in [*sweeps, *by_id]:
        try:
            found |= {r["id"]: r for r in check_payload("satnogs", get(url)) if r.get("id") is not None}
        except (OSError, ValueError):
            continue
    return [found[k] for k in sorted(found)]


def found(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, source, snapshot_at_utc, priority, length, modified_at) of every file below `root`; source is null if none fits.

    No content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    kind = F.lit(None).cast("string")
    for name, pattern in PATTERNS.items():
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    # where snapshots of several groups coincide, stations come first, then groups by name
    first = F.when(F.col("path").rlike("/stations_"), 0).otherwise(1)
    return files.select(F.col("path").alias("file_path"), kind.alias("source"), X.snapshot_of("path").alias("snapshot_at_utc"), first.alias("priority"), "length", F.col("modificationTime").alias("modified_at"))


def located(path: str) -> tuple:
    """The file system of a path, of any that Arrow knows, and the path there; for tasks, which have no Hadoop of their own."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon:
        scheme, rest = "file", path
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{'/' * (scheme == 'file')}{quote(rest.lstrip('/'))}")


def opened(path: str):
    """A file to be read in blocks."""
    system, name = located(path)
    return system.open_input_stream(name)


def digests(files: DataFrame, block: int = BLOCK_BYTES, open_file: Callable = opened) -> DataFrame:
    """`files` (which have file_path) with sha256 and first_line, each read once by a task, in blocks, however long it is."""
    schema = T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType()), T.StructField("first_line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for path in b.column("file_path").to_pylist():
                digest, head = hashlib.sha256(), b""
                with open_file(path) as f:
                    while data := f.read(block):
                        digest.update(data)
                        head += data[: HEAD_BYTES - len(head)]
                made.append((digest.hexdigest(), head.split(b"\n")[0].rstrip(b"\r").decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([d for d, _ in made], pa.string()), pa.array([h for _, h in made], pa.string())], names=schema.names)

    # one file to a row, dealt out: a task has few of them
    return files.repartition(F.xxhash64("file_path")).mapInArrow(run, schema)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """`found` with the digest of every file: all content is read."""
    return digests(found(spark, root)).drop("first_line")


def unloadable(files: DataFrame) -> DataFrame:
    return files.where("source IS NULL OR snapshot_at_utc IS NULL")


def text_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in schemas.RAW[kind]])


def read_raw(spark: SparkSession, kind: str, paths: list[str], first_lines: dict[str, str] | None = None) -> DataFrame:
    """The text columns of files of one kind, with file_path; no inference, corrupt records are null rows that go.

    `first_lines` are those of the files, where they are known.
    """
    schema = text_schema(kind)
    if not paths:
        return spark.createDataFrame([], schema.add("file_path", "string"))
    names = [f"`{c}`" for c in schema.fieldNames()]
    if kind in ("celestrak", "spaceweather"):
        # columns go by name: files of equal headers are read together, however many there are
        if first_lines is None:
            names_only = spark.createDataFrame([(p,) for p in paths], "file_path string")
            first_lines = {r["file_path"]: r["first_line"] for r in digests(names_only).select("file_path", "first_line").collect()}  # a row for each file
        alike: dict[str, list[str]] = {}
        for path in paths:
            alike.setdefault(first_lines[path], []).append(path)
        rows = None
        for same in alike.values():  # one for each way to order the columns
            raw = spark.read.option("header", "true").csv(same, inferSchema=False)
            have = {c.lstrip("\ufeff"): c for c in raw.columns}
            part = raw.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast("string").alias(c) for c in schema.fieldNames()], F.col("_metadata.file_path").alias("file_path"))
            rows = part if rows is None else rows.unionByName(part)
    else:
        rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(paths).select(*names, F.col("_metadata.file_path").alias("file_path"))
    return rows.where(" OR ".join(f"{c} IS NOT NULL" for c in names))


def read_silver_orbits(spark: SparkSession, glob: str) -> DataFrame:
    """All current element files, the group taken from the file's name."""
    rows = spark.read.option("header", "true").csv(glob, inferSchema=False)
    return rows.withColumn("source_group", F.regexp_extract(F.col("_metadata.file_name"), r"([a-z0-9-]+)_satellites_latest\.csv$", 1))


def pending_ids(rows: DataFrame, now: Column, limit: int = 10, order: str = "file_path") -> DataFrame:
    """Observations whose last status is not final though they have ended: the oldest `limit`, a bound of the source's own."""
    status = F.lower(F.trim("status"))
    ids = rows.withColumn("observation_id", X.number("id", "long")).withColumn("end_utc", F.col("end").try_cast("timestamp")).where("observation_id IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("observation_id").orderBy(F.desc(order), F.desc_nulls_last("end_utc")))
    latest = ids.withColumn("_r", last).where("_r = 1").where(~F.coalesce(status, F.lit("")).isin(*TERMINAL) & (F.col("end_utc") < now))
    return latest.orderBy("end_utc", "observation_id").limit(limit).select("observation_id", "end_utc", "status")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schemas.RUN_EVENT).json(path).where("run_id IS NOT NULL")


def read_s3_csv(spark: SparkSession, bucket: str, pattern: str, endpoint: str) -> DataFrame:
    """CSV files of an S3-compatible store, by path-style addresses; needs Hadoop's S3A on the class path."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.endpoint", endpoint)
    conf.set("fs.s3a.path.style.access", "true")
    return spark.read.option("header", "true").csv(f"s3a://{bucket}/{pattern}", inferSchema=False)
