"""The session settings that the plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "stellarframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `master` and sizes come from the cluster unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in the folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and all run on one machine, as in tests, a temporary folder is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root := tempfile.mkdtemp(prefix="stellarframe-"))
    return f"{root}/{name}-{uuid.uuid4().hex}"
