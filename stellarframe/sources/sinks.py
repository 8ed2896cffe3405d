"""Where results go: versioned tables, single CSV files, JSON lines, Kafka, object stores, landing zones.

A versioned table is a folder of data folders and numbered manifests, each of which names the data folders of one version. A
manifest appears by one rename, last of all; readers take the newest one. So a writer that stops anywhere leaves the version
before, and readers see one version or the next, never a gap. The version before stays until the one after the next. One writer
at a time is assumed; `plans.pipeline.lock` sees to that.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bronze import located, opened, stamp

#: Parts of a table that `upsert` rewrites by themselves.
PARTS = 64
_PART = "part__"


def land(root: str, source: str, name: str, at: datetime, data: bytes) -> str:
    """Write raw bytes once under a stamped name; an existing file is never replaced."""
    path = Path(root, source, f"{name}_{stamp(at)}{'.csv' if source in ('celestrak', 'spaceweather') else '.json'}")
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("xb") as f:
        f.write(data)
    return str(path)


def _hadoop(spark: SparkSession, path: str):
    """The path as Hadoop has it, and its file system."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here, here.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """The names of a table's manifests, oldest first."""
    here, fs = _hadoop(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(here)] if fs.exists(here) else []
    return sorted(n for n in names if n.startswith("_manifest-"))


def _parts(spark: SparkSession, path: str, manifest: str) -> dict[str, str]:
    here, fs = _hadoop(spark, f"{path}/{manifest}")
    stream = fs.open(here)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Make `parts` the table's newest version, and delete what neither it nor the one before has."""
    old = _manifests(spark, path)
    name = f"_manifest-{int(old[-1][10:18]) + 1 if old else 1:08d}.json"
    temporary, fs = _hadoop(spark, f"{path}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    final = _hadoop(spark, f"{path}/{name}")[0]
    if fs.exists(final) or not fs.rename(temporary, final):
        raise OSError(f"{path}: version {name} could not be committed")
    keep = {*old[-1:], name}
    used = {folder.split("/")[0] for m in keep for folder in _parts(spark, path, m).values()}
    for status in fs.listStatus(_hadoop(spark, path)[0]):
        left = status.getPath().getName()
        if left not in keep and left not in used and left.startswith(("_manifest-", "._manifest-", ".._manifest-", "data-")):
            fs.delete(status.getPath(), True)


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether a version was committed."""
    return bool(_manifests(spark, path))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version of a table; a plain Parquet folder is read as it is."""
    manifests = _manifests(spark, path)
    folders = [f"{path}/{f}" for f in _parts(spark, path, manifests[-1]).values()] if manifests else [path]
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)


def replace_table(df: DataFrame, path: str) -> None:
    """Write the next version of a table, which may be made of the current one."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _commit(df.sparkSession, path, {"": folder})


def upsert(batch: DataFrame, path: str, keys: list[str], version: str, parts: int = PARTS) -> None:
    """Keep the newest version of each key of the table and `batch`; only parts that the batch has keys of are written anew.

    Keys are dealt into parts by their hash, and `parts` holds for the table's lifetime. A batch that comes again changes nothing.
    """
    spark = batch.sparkSession
    dealt = lambda df: df.withColumn(_PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    manifests = _manifests(spark, path)
    known = _parts(spark, path, manifests[-1]) if manifests else {}
    batch = batch.persist()
    try:
        touched = sorted(r[0] for r in dealt(batch).select(_PART).distinct().collect())  # at most `parts` numbers
        old = [f"{path}/{known[str(k)]}" for k in touched if str(k) in known]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version)))
        folder = f"data-{uuid.uuid4().hex}"
        dealt(rows.withColumn("_rank", first).where("_rank = 1").drop("_rank")).write.partitionBy(_PART).parquet(f"{path}/{folder}")
    finally:
        batch.unpersist()
    if touched:
        _commit(spark, path, known | {str(k): f"{folder}/{_PART}={k}" for k in touched})


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; `single` is for small reports that people open."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", "true").csv(path)


def write_json_report(df: DataFrame, path: str, csv: str | None = None) -> None:
    """A small report as JSON lines, and beside it as CSV."""
    df.coalesce(1).write.mode("overwrite").json(path)
    if csv:
        write_csv(df, csv, single=True)


def append_json_line(path: str, record: dict) -> None:
    """Add a record to a log on the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, default=str) + "\n")


def kafka_rows(events: DataFrame) -> DataFrame:
    """key, value and headers of run events: keyed by run, so that a run's steps keep their order."""
    header = F.array(F.struct(F.lit("event_step").alias("key"), F.col("step").cast("binary").alias("value")))
    return events.select(F.col("run_id").alias("key"), F.to_json(F.struct("*")).alias("value"), header.alias("headers"))


class Undelivered(RuntimeError):
    """No delivery was confirmed; callers skip the step."""


def publish(events: DataFrame, servers: str, topic: str, send: Callable[[DataFrame], None] | None = None) -> int:
    """Send run events; how many were sent, counted on their way. Needs Spark's Kafka connector on the class path, or `send`."""
    seen = Observation("published")
    rows = kafka_rows(events).observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        if send:
            send(rows)
        else:
            rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", "true").save()
    except Exception as e:
        raise Undelivered(f"nothing confirmed by {servers}: {type(e).__name__}") from e
    return seen.get["n"]


def to_mirror(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files (path, sha256) whose digest the other store doesn't have."""
    return local.join(remote.select("path", "sha256"), ["path", "sha256"], "left_anti")


MIRRORED = "path string, target string, bytes long, sha256 string, error string"


def _copied(path: str, target: str, block: int) -> tuple[int, str]:
    """Copy a file in blocks, under another name until it is whole; its length and digest."""
    beside, n, digest = f"{target}.{uuid.uuid4().hex}.part", 0, hashlib.sha256()
    system, name = located(beside)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    try:
        with opened(path) as source, system.open_output_stream(name) as out:
            while data := source.read(block):
                digest.update(data)
                out.write(data)
                n += len(data)
        system.move(name, located(target)[1])
    except BaseException:
        with contextlib.suppress(Exception):
            system.delete_file(name)
        raise
    return n, digest.hexdigest()


def mirror(files: DataFrame, root: str, target: str, report: str, block: int = 4 << 20) -> DataFrame:
    """Copy `files` (which have path, below `root`) to the same places below `target`, each by a task, and write what became of them.

    The report, a folder that is replaced, has a row for each file: its digest and length, or the error that kept it from being copied;
    the others are copied all the same. A copy that was done before is done again, to the same end.
    """
    base = root.removeprefix("file:").rstrip("/").lstrip("/") + "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for path in b.column("path").to_pylist():
                below = path.removeprefix("file:").lstrip("/")
                to = f"{target}/{below.removeprefix(base)}"
                try:
                    if not below.startswith(base):
                        raise ValueError(f"not below {root}")
                    made.append((path, to, *_copied(path, to, block), None))
                except Exception as e:  # a row of the report
                    made.append((path, to, None, None, f"{type(e).__name__}: {e}"))
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=["path", "target", "bytes", "sha256", "error"])

    files.select("path").distinct().mapInArrow(run, MIRRORED).write.mode("overwrite").parquet(report)
    return files.sparkSession.read.schema(MIRRORED).parquet(report)


def file_sha256(path: str, block: int = 1 << 20, opened: Callable = open) -> str:
    """The digest of a file, read in blocks."""
    digest = hashlib.sha256()
    with opened(path, "rb") as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()
