"""Operators along time whose work is dealt by time range, so that no object, and no table without a key, is one task.

A range is RANGE_S long. What a range needs from before it is carried into it as a row of its own: the last row of the
nearest earlier range that has one, found among one row for each range. What reaches from a range into the next (a frame of
some hours) is copied there. Results don't depend on the length of a range.

Ties have a defined order: rows of one time are told apart by the values that are asked for. Rows without a time come before
all others where rows follow each other, and match nothing otherwise; a null key is a key like others for `previous` and
`rolling`, and matches nothing in `as_of`. Empty tables give no rows, or nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

RANGE_S = 86_400
_MICROS = 1_000_000


def _micros(time: str) -> Column:
    return F.unix_micros(X.col(time).cast("timestamp"))


def _range(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * _MICROS)).cast("long")


def previous(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str = "previous", range_s: int = RANGE_S) -> DataFrame:
    """`df` with a struct of `columns` of the row before, by `order` (the first of which is the time) among rows of equal `key`."""
    place = F.struct(*order, *[c for c in columns if c not in order])
    rows = df.withColumns({"_range": _range(_micros(order[0]), range_s), "_place": place, "_own": F.lit(True)})
    last = rows.groupBy(key, "_range").agg(F.max("_place").alias("_place"))  # one row for each range of a key
    before = F.lag("_place").over(Window.partitionBy(key).orderBy("_range"))
    carried = last.withColumn("_place", before).where("_place IS NOT NULL").withColumn("_own", F.lit(False))
    every = rows.unionByName(carried, allowMissingColumns=True)
    found = F.lag("_place").over(Window.partitionBy(key, "_range").orderBy("_own", "_place"))
    wanted = F.when(F.col("_before").isNotNull(), F.struct(*[F.col(f"_before.{c}").alias(c) for c in columns]))
    return every.withColumn("_before", found).where("_own").withColumn(name, wanted).drop("_range", "_place", "_own", "_before")


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], by: Sequence[str] = (), within_s: int | None = None, range_s: int = RANGE_S) -> DataFrame:
    """`left` with `values` of the latest row of `right` (of equal `by`) that is not later, and its time as `right_time`.

    With `within_s`, rows that are older than that don't count. Of rows of one time the largest by `values` counts. Only distinct
    times are put in order, so that many rows of one time are no load.
    """
    by = list(by)
    timed = lambda df, time: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (time, *by))).withColumn("_t", _micros(time))
    known = timed(right, right_time).groupBy(*by, "_t").agg(F.max(F.struct(F.col(right_time).alias("_time"), *values)).alias("_v")).withColumn("_range", _range(F.col("_t"), range_s))
    asked = timed(left, left_time).select(*by, "_t").distinct().withColumn("_range", _range(F.col("_t"), range_s))
    none = F.lit(None).cast(known.schema["_v"].dataType)
    seen = F.struct("_t", "_v")
    # one row for each range that has rows of either side
    ranges = known.groupBy(*by, "_range").agg(F.max_by(seen, "_t").alias("_last")).unionByName(asked.select(*by, "_range").distinct(), allowMissingColumns=True)
    ranges = ranges.groupBy(*by, "_range").agg(F.first("_last", True).alias("_last"))
    before = F.last("_last", True).over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranges.withColumn("_seen", before).where("_seen IS NOT NULL").select(*by, "_range", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_t"), "_seen")
    rows = known.select(*by, "_range", F.lit(1).alias("_side"), "_t", seen.alias("_seen"))
    rows = rows.unionByName(asked.select(*by, "_range", F.lit(2).alias("_side"), "_t", F.lit(None).cast(rows.schema["_seen"].dataType).alias("_seen"))).unionByName(carried)
    w = Window.partitionBy(*by, "_range").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_seen", F.last("_seen", True).over(w)).where("_side = 2")
    value = F.col("_seen._v") if within_s is None else F.when(F.col("_t") - F.col("_seen._t") <= within_s * _MICROS, F.col("_seen._v")).otherwise(none)
    found = found.select(*by, F.col("_t"), value.alias("_v")).select(*by, "_t", F.col("_v._time").alias(right_time), *[F.col(f"_v.{c}").alias(c) for c in values])
    return left.withColumn("_t", _micros(left_time)).join(found, [*by, "_t"], "left").drop("_t")


def rolling(df: DataFrame, time: str, span_s: int, wanted: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """`df` with aggregates over the rows of the last `span_s` seconds up to and with each row's time (of equal `by`).

    A row is copied once, into the range after its own; no frame reaches further.
    """
    at = _range(F.col("_t"), span_s)
    places = F.explode(F.array(F.struct(at.alias("range"), F.lit(True).alias("own")), F.struct((at + 1).alias("range"), F.lit(False).alias("own")))).alias("_p")
    dealt = df.withColumn("_t", _micros(time)).select("*", places)
    w = Window.partitionBy(*by, "_p.range").orderBy("_t").rangeBetween(1 - span_s * _MICROS, 0)
    made = dealt.withColumns({n: F.when(F.col("_t").isNotNull(), a.over(w)) for n, a in wanted.items()})
    return made.where("_p.own").drop("_t", "_p")
