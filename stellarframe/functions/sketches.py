"""Distinct counts that add up: a sketch for each load, merged when somebody asks, in place of a count over all history.

Sketches are HyperLogLog ones of Spark. With LG_K bits their relative standard error is about 1.04 / sqrt(2 ** LG_K), 0.8 %, whatever the
count; up to some hundred values they are exact. Merging sketches of overlapping rows counts each value once. Nulls are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
#: What a sketch's table has beside its keys.
SCHEMA = "column string, rows long, sketch binary"


def sketched(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, rows, sketch) of each of `columns`; all of them in one read."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("_v")) for c in columns]))
    rows = df.select(*by, each)
    return rows.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("_v", F.lit(LG_K)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch for each column (and `by`) of many."""
    return sketches.groupBy(*by, "column").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: Column | str = "sketch") -> Column:
    """How many distinct values a sketch has seen, about."""
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("long"))


def tolerance(sigmas: float = 3.0) -> float:
    """The relative error that an estimate keeps to."""
    return sigmas * 1.04 / 2 ** (LG_K / 2)
