"""A table played again as a stream: dealt into files that arrive one after another, and written as it comes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import new_folder


def arrive(df: DataFrame, path: str, batches: int, closing: DataFrame | None = None) -> DataFrame:
    """The stream of `df`, written below `path` in `batches` files that hold its rows in no order; `closing` comes last, so that
    watermarks pass all that came before."""
    df.repartition(batches).write.parquet(path)
    if closing is not None:
        closing.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(path)


def played(spark: SparkSession, name: str, made: Callable[[str], DataFrame]) -> DataFrame:
    """All that the stream `made` (of a new folder) gives until nothing is left to take; what it wrote stays in the folder."""
    out = new_folder(spark, name)
    stream = made(out)
    query = stream.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/out")
