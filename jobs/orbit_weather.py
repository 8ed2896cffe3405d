"""What space weather does to public orbits, day by day: each change of an object's elements beside the weather at its time.

The job reads snapshots of elements and solar-wind observations and writes, for each day of the range that is asked for:

- `changes/day=D`: every change from an object's previous snapshot, with the latest minute of weather that is not older than
  `weather_within_hours`, and the extremes of the `weather_span_hours` before it;
- `effects/day=D`: for each level of disturbance how many changes there were, how many brought new elements, and the median
  and the ninetieth percentile of the decay rate's size.

Days are written by dynamic partition overwrite: a day that is run again is replaced, others stay, so that late data take
a second run of their days. What a day needs from before it (an object's last snapshot, two spans of weather) is read as well, so
that its rows don't depend on the range that it was run in. A day without changes is not written.

    python -m jobs.orbit_weather --tables /data/tables --out /data/orbit_weather --first 2024-01-05 --last 2024-01-06
"""

from __future__ import annotations

import argparse
import json
import logging
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stellarframe.functions import expr as X
from stellarframe.functions import stats
from stellarframe.operators import timeline
from stellarframe.plans import catalogue, gold
from stellarframe.session import session

log = logging.getLogger("jobs.orbit_weather")
SETTINGS = Path(__file__).with_suffix(".json")
CHANGES = """object_name string, norad_catalog_id long, snapshot_at_utc timestamp_ntz, interval_minutes long, same_element_set boolean, semi_major_axis_change_km double, decay_rate_km_per_day double,
    observation_minute_utc timestamp_ntz, bz_gsm_nanotesla double, proton_speed_km_per_second double, disturbance_level string, lowest_bz_gsm double, highest_proton_speed double, disturbed_hours long, day date"""
EFFECTS = "disturbance_level string, changes long, new_elements long, median_decay double, p90_decay double, day date"
#: Of changes without weather near enough.
UNKNOWN = "unknown"


def changes_of(orbital: DataFrame, magnetic: DataFrame, plasma: DataFrame, settings: dict) -> DataFrame:
    """Each change of an object with the weather at its time."""
    minute = gold.space_weather_minute(magnetic, plasma)
    span = settings["weather_span_hours"]
    days = gold.weather_last_day(gold.space_weather_hourly(minute), span).drop("disturbance_level")
    now = minute.select("observation_minute_utc", "bz_gsm_nanotesla", "proton_speed_km_per_second")
    met = timeline.as_of(gold.orbit_change(orbital), now, "snapshot_at_utc", "observation_minute_utc", now.columns[1:], within_s=settings["weather_within_hours"] * 3600)
    met = timeline.as_of(met, days, "snapshot_at_utc", "hour_utc", ["lowest_bz_gsm", "highest_proton_speed", "disturbed_hours"], within_s=span * 3600)
    level = gold.disturbance(F.col("bz_gsm_nanotesla"), F.col("proton_speed_km_per_second"))
    made = met.withColumn("disturbance_level", F.when(F.col("observation_minute_utc").isNull(), UNKNOWN).otherwise(level)).withColumn("day", F.to_date("snapshot_at_utc"))
    return made.select([c.strip().split(" ")[0] for c in CHANGES.split(",")])


def effects_of(changes: DataFrame) -> DataFrame:
    """The levels of each day."""
    plain = [F.count(F.lit(1)).alias("changes"), X.count_if(~F.col("same_element_set")).alias("new_elements")]
    sized = changes.withColumn("decay", F.abs("decay_rate_km_per_day"))
    return stats.summary(sized, ["day", "disturbance_level"], plain, {"median_decay": ("decay", 0.5), "p90_decay": ("decay", 0.9, stats.NEAREST)})


def run(spark: SparkSession, tables: str, out: str, first: date | None = None, last: date | None = None, settings: dict | None = None) -> dict[str, int]:
    """Write the days from `first` to `last` (all unless given); how many changes and levels were written."""
    settings = json.loads(SETTINGS.read_text()) | (settings or {})
    t = catalogue.Tables(spark, tables)
    orbital, magnetic, plasma = t.orbital(), t.magnetic(), t.plasma()
    at = lambda day: F.lit(datetime.combine(day, datetime.min.time())).cast("timestamp_ntz")
    if last:
        end = at(last + timedelta(days=1))
        orbital = orbital.where(X.naive("snapshot_at_utc") < end)
        magnetic, plasma = (w.where(F.col("observed_at_utc") < end) for w in (magnetic, plasma))
    if first:
        # whole days: an hour is never cut
        reach = -(-(2 * settings["weather_span_hours"] + settings["weather_within_hours"]) // 24)
        magnetic, plasma = (w.where(F.col("observed_at_utc") >= at(first - timedelta(days=reach))) for w in (magnetic, plasma))
    rows = changes_of(orbital, magnetic, plasma, settings)
    rows = rows.where(F.col("day") >= F.lit(first)) if first else rows
    written = {}
    for name, made in (("changes", lambda: rows), ("effects", lambda: effects_of(_days(spark, out, first, last)))):
        seen = Observation(name)
        # `day` may hold most rows: adaptive execution splits it, a day is a folder and not a file
        made().hint("rebalance", "day").observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/{name}")
        written[name] = seen.get["rows"]
    log.info("read %s from %s to %s, wrote %s: %s", tables, first or "the first day", last or "the last", out, written)
    return written


def _days(spark: SparkSession, out: str, first: date | None, last: date | None) -> DataFrame:
    """The changes of a range of days as written."""
    rows = spark.read.schema(CHANGES).parquet(f"{out}/changes")
    rows = rows.where(F.col("day") >= F.lit(first)) if first else rows
    return rows.where(F.col("day") <= F.lit(last)) if last else rows


def read_output(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The changes and the effects of all days."""
    return _days(spark, out, None, None), spark.read.schema(EFFECTS).parquet(f"{out}/effects")


def main() -> None:
    options = argparse.ArgumentParser(description="Write orbit changes and the weather at their time, by day.")
    options.add_argument("--tables", required=True, help="folder of the tables")
    options.add_argument("--out", required=True, help="folder of the output")
    options.add_argument("--first", type=date.fromisoformat, help="first day (YYYY-MM-DD)")
    options.add_argument("--last", type=date.fromisoformat, help="last day")
    options.add_argument("--config", default=str(SETTINGS), help="settings (JSON)")
    given = options.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("orbit weather")
    try:
        run(spark, given.tables, given.out, given.first, given.last, json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
