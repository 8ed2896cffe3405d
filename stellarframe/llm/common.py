"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What one Arrow batch of whole texts holds at most; a single longer text is a batch of its own. Parquet readers take fewer
#: rows at a time, since they can't bound bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
READ_ROWS = 512
#: Row groups of tables between steps: a writing task holds one of them in memory.
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what readers and Arrow batches hold of whole texts, by rows and by bytes.

    Spark reads these settings when a plan runs, after the query that asks for them has returned, so they stay; they are
    only ever lowered, and change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent and all run on one machine (tests) a temporary folder is set once; on a cluster that is an
    error, since executors don't share local folders.
    """
    context = spark.sparkContext
    path = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stellarframe-")
        context.setCheckpointDir(path)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size, from its files; 0 where it has none. No data are read for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    here.getFileSystem(spark._jsc.hadoopConfiguration()).delete(here, True)


class Stages:
    """Tables written to the shared folder between the steps of a plan; `with` deletes them, but for those to be kept.

    What is written is read again rather than recomputed: lineage is cut there, and a lost executor costs its own tasks. What is
    kept is handed to `outer`, the stages of the caller, if there are any: they delete it once its result is written too.
    """

    def __init__(self, spark: SparkSession, outer: Stages | None = None):
        self.spark, self.paths, self.outer = spark, [], outer

    def write(self, df: DataFrame, keep: bool = False, files: int | None = None) -> DataFrame:
        """`df` as written, into `files` files at most; `keep` for what results are still read from after the block."""
        path = scratch(self.spark, "stage")
        if not keep:
            self.paths.append(path)
        elif self.outer:
            self.outer.paths.append(path)
        (df.coalesce(files) if files else df).write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder for as long as that lives, and read it back."""
    return Stages(spark).write(df, keep=True)
