"""The quality gate: checks are a name, a one-row measure, a comparison and a severity; the result is one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "greater_than": lambda a, b: a > b, "greater_than_or_equal": lambda a, b: a >= b, "less_than": lambda a, b: a < b,
    "less_than_or_equal": lambda a, b: a <= b, "equal": lambda a, b: a == b,
}
SOURCES = ("orbital_snapshot_history", "noaa_magnetic_history", "noaa_plasma_history", "space_weather_index_history", "satnogs_observation_history")


@dataclass(frozen=True)
class Check:
    """`measure` has one row and one numeric column."""

    name: str
    severity: str
    measure: DataFrame
    operator: str
    threshold: float
    description: str = ""


def passes(value: Column, operator: str, threshold: float) -> Column:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator: {operator}")
    return F.coalesce(OPERATORS[operator](value, F.lit(float(threshold))), F.lit(False))


def run_checks(checks: list[Check]) -> DataFrame:
    """check_name, status, severity, observed_value, operator, threshold, description; an error fails, a warning warns."""
    out = None
    for c in checks:
        row = c.measure.toDF("v").select(F.col("v").cast("double").alias("v")).select(
            F.lit(c.name).alias("check_name"), F.when(passes(F.col("v"), c.operator, c.threshold), "pass").otherwise("fail" if c.severity == "error" else "warn").alias("status"),
            F.lit(c.severity).alias("severity"), X.round_half_up("v", 6).alias("observed_value"), F.lit(c.operator).alias("operator"), F.lit(float(c.threshold)).alias("threshold"), F.lit(c.description).alias("description"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return count(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def null_percent(df: DataFrame, column: str) -> DataFrame:
    """Of no rows, 100."""
    n = F.count(F.lit(1))
    return df.agg(F.coalesce(F.try_divide(F.lit(100.0) * (n - F.count(column)), n.cast("double")), F.lit(100.0)))


def changed_paths(history: DataFrame) -> DataFrame:
    """Files whose rows carry more than one checksum."""
    return count(history.groupBy("source_file").agg(F.countDistinct("source_sha256").alias("n")).where("n > 1"))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key is one."""
    return count(rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti"))


def gate(tables: dict[str, DataFrame], registry: DataFrame, unloadable: DataFrame) -> DataFrame:
    """The thirteen checks over history tables, the file registry and the files that no pattern loads."""
    orbital, magnetic, plasma = (tables[t] for t in SOURCES[:3])
    files = None
    for t in SOURCES:
        own = tables[t].select("source_file")
        files = own if files is None else files.unionByName(own)
    shas = orbital.select("source_file", "source_sha256")
    # a file that repeated known rows alone is registered with none; that is no loss
    silent = registry.where("row_count > 0").join(files.select(F.col("source_file").alias("file_path")), "file_path", "left_anti")
    outside = lambda c, low, high: f"{c} IS NULL OR {c} {low} OR {c} {high}"
    return run_checks([
        Check("orbital_history_has_rows", "error", count(orbital), "greater_than", 0),
        Check("duplicate_orbital_snapshot_objects", "error", duplicate_keys(orbital, "snapshot_at_utc", "norad_catalog_id"), "less_than_or_equal", 0),
        Check("invalid_mean_motion_rows", "error", count(orbital.where(outside("mean_motion_revolutions_per_day", "<= 0", "> 20"))), "less_than_or_equal", 0),
        Check("invalid_eccentricity_rows", "error", count(orbital.where(outside("eccentricity", "< 0", ">= 1"))), "less_than_or_equal", 0),
        Check("invalid_inclination_rows", "error", count(orbital.where(outside("inclination_degrees", "< 0", "> 180"))), "less_than_or_equal", 0),
        Check("modified_bronze_paths", "error", changed_paths(shas), "less_than_or_equal", 0),
        Check("orphan_history_rows", "error", orphans(files, "source_file", registry, "file_path"), "less_than_or_equal", 0),
        Check("registered_files_missing_rows", "error", count(silent), "less_than_or_equal", 0),
        Check("unloadable_bronze_files", "warning", count(unloadable), "less_than_or_equal", 0),
        Check("magnetic_missing_bz_percent", "warning", null_percent(magnetic, "bz_gsm"), "less_than_or_equal", 10.0),
        Check("plasma_missing_speed_percent", "warning", null_percent(plasma, "proton_speed"), "less_than_or_equal", 10.0),
        Check("active_magnetic_rows", "warning", count(magnetic.where("is_active_source")), "greater_than", 0),
        Check("active_plasma_rows", "warning", count(plasma.where("is_active_source")), "greater_than", 0),
    ])


def verdict(results: DataFrame) -> DataFrame:
    """One row: failures, warnings, passes and checks."""
    s = F.col("status")
    return results.agg(X.count_if(s == "fail").alias("failures"), X.count_if(s == "warn").alias("warnings"), X.count_if(s == "pass").alias("passes"), F.count(F.lit(1)).alias("checks"))


#: Columns of a written report.
REPORT = "checked_at_utc timestamp, check_name string, status string, severity string, observed_value double, operator string, threshold double, description string"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The last gate's results as they were written."""
    return spark.read.schema(REPORT).json(path)


def overall(results: DataFrame) -> DataFrame:
    """One row: when the checks ran, fail, warn or pass for all of them, and how many there were, failed and warned."""
    n = verdict(results)
    status = F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass")
    when = results.agg(F.max("checked_at_utc").alias("checked_at_utc"))
    return n.crossJoin(F.broadcast(when)).select("checked_at_utc", status.alias("status"), F.col("checks").alias("checks_total"), "failures", "warnings")  # one row each
