"""Propagation disagreement of successive elements, and the backtest of the index against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import sgp4, stats
from ..operators import timeline

#: Bounds of the analysis envelope and the order of classes, fixed values.
MAX_SPAN_HOURS = 72.0
MAX_TOTAL_KM = 500.0
CLASSES = ("high", "moderate", "reduced", "low")
_ELEMENT = {"epoch": "element_epoch_utc", "inclination": "inclination_degrees", "eccentricity": "eccentricity", "mean_motion": "mean_motion_revolutions_per_day", "bstar": "bstar_drag_term", "raan": "ra_of_asc_node_degrees", "arg_perigee": "arg_of_pericenter_degrees", "mean_anomaly": "mean_anomaly_degrees"}


def quality_label(span_hours: Column | str, total_km: Column | str) -> Column:
    return F.when(X.col(total_km) > MAX_TOTAL_KM, "extreme").when(X.col(span_hours) > MAX_SPAN_HOURS, "long_span").otherwise("ok")


def element_pairs(orbital: DataFrame) -> DataFrame:
    """Successive snapshots of an object whose element changed; the earlier side is the last that carried the old one."""
    rows = orbital.where("norad_catalog_id IS NOT NULL").withColumn("element", F.struct(*[F.col(c).alias(n) for n, c in _ELEMENT.items()]))
    before = timeline.previous(rows, "norad_catalog_id", ["snapshot_at_utc", "element_epoch_utc"], ["snapshot_at_utc", "element"])
    lagged = before.withColumns({"earlier": F.col("previous.element"), "earlier_snapshot_at_utc": F.col("previous.snapshot_at_utc")})
    return lagged.where("earlier.epoch IS NOT NULL AND element.epoch IS NOT NULL AND earlier.epoch <> element.epoch").select("object_name", "norad_catalog_id", "source_group", "earlier_snapshot_at_utc", "snapshot_at_utc", "earlier", F.col("element").alias("later"))


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """`pairs` with their kind: forward, or retrograde when the newer snapshot has an older element."""
    return pairs.withColumn("kind", F.when(F.col("later.epoch") > F.col("earlier.epoch"), "forward").otherwise("retrograde"))


def measured(pairs: DataFrame) -> DataFrame:
    """Forward pairs propagated to the later epoch; `error` is not 0 where SGP4 gives no state."""
    epoch = lambda side: F.col(side).withField("epoch", F.col(f"{side}.epoch").cast("timestamp"))
    forward = classify_pairs(pairs).where("kind = 'forward'")
    return forward.withColumn("m", sgp4.disagreement(epoch("earlier"), epoch("later"))).select("*", "m.*").drop("m")


def propagation_disagreement(orbital: DataFrame) -> DataFrame:
    rows = measured(element_pairs(orbital)).where("error = 0")
    return rows.select(
        "object_name", "norad_catalog_id", "source_group", F.col("earlier.epoch").alias("earlier_element_epoch_utc"), F.col("later.epoch").alias("later_element_epoch_utc"), F.col("span_hours").alias("propagation_span_hours"),
        "radial_km", "along_track_km", "cross_track_km", "total_km", X.naive("earlier_snapshot_at_utc").alias("earlier_snapshot_at_utc"), X.naive("snapshot_at_utc").alias("later_snapshot_at_utc"), quality_label("span_hours", "total_km").alias("measurement_quality"),
    )


def measurement_counts(orbital: DataFrame) -> DataFrame:
    """(kind, pairs): how many pairs are measured, by label, and how many are not, by reason."""
    pairs = element_pairs(orbital)
    done = measured(pairs).select(F.when(F.col("error") != 0, "skipped").otherwise(quality_label("span_hours", "total_km")).alias("kind"))
    back = classify_pairs(pairs).where("kind = 'retrograde'").select("kind")
    return done.unionByName(back).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"))


def validation_pairs(disagreement: DataFrame, orbital: DataFrame) -> DataFrame:
    """The index as it was at prediction time, without weather, beside the error that came after."""
    h = orbital.select("norad_catalog_id", F.col("element_epoch_utc").alias("earlier_element_epoch_utc"), X.naive("snapshot_at_utc").alias("earlier_snapshot_at_utc"), "mean_motion_revolutions_per_day", F.col("inclination_degrees").alias("inclination_degrees_at_prediction"), F.col("eccentricity").alias("eccentricity_at_prediction"), F.col("bstar_drag_term").alias("bstar_at_prediction"))
    met = disagreement.where("measurement_quality = 'ok'").join(h, ["norad_catalog_id", "earlier_element_epoch_utc", "earlier_snapshot_at_utc"])
    met = met.withColumn("age", X.hours_by_minutes("earlier_element_epoch_utc", "earlier_snapshot_at_utc")).withColumn("altitude", X.altitude("mean_motion_revolutions_per_day")).where("age IS NOT NULL AND altitude IS NOT NULL AND propagation_span_hours IS NOT NULL AND total_km IS NOT NULL")
    met = met.withColumn("fresh", X.freshness_score("age")).withColumn("drag", X.drag_safety_score("altitude")).withColumn("base", X.base_score("fresh", "drag"))
    size = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    r = X.round_half_up
    return met.select(
        "norad_catalog_id", "object_name", "source_group", r("base", 1).alias("base_score"), r("fresh", 1).alias("freshness_score"), r("drag", 1).alias("drag_safety_score"), X.reliability_class("base").alias("reliability_class"),
        r("age", 2).alias("element_age_hours_at_prediction"), r("altitude", 2).alias("mean_altitude_km_at_prediction"), "inclination_degrees_at_prediction", "eccentricity_at_prediction", "bstar_at_prediction",
        r("propagation_span_hours", 2).alias("propagation_span_hours"), "radial_km", "along_track_km", "cross_track_km", r("total_km", 4).alias("total_km"),
        F.when(F.col("propagation_span_hours") > 0, r(F.try_divide("total_km", "propagation_span_hours"), 4)).alias("km_per_hour"),
        ((size("along_track_km") > size("radial_km")) & (size("along_track_km") > size("cross_track_km"))).alias("is_along_track_dominant"),
    )


def validation_bins(pairs: DataFrame) -> DataFrame:
    """Medians by class; classes without pairs are left out. The class order is high to low."""
    known = pairs.withColumn("along", F.abs(F.coalesce("along_track_km", F.lit(0.0))))
    plain = [F.count(F.lit(1)).cast("int").alias("pair_count")]
    wanted = {"median_total_km": ("total_km", 0.5), "p90_total_km": ("total_km", 0.9, stats.NEAREST), "median_km_per_hour": ("km_per_hour", 0.5), "median_along_track_km": ("along", 0.5)}
    bins = stats.summary(known, ["reliability_class"], plain, wanted).withColumns({n: X.round_half_up(n, 4) for n in wanted})
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("reliability_class"))
    return bins.select("reliability_class", "pair_count", *wanted).orderBy(order)


def validation_stats(pairs: DataFrame, disagreement: DataFrame) -> DataFrame:
    """(metric, value): counts and rank correlations, 0 without rows; those of drag-like pairs only if there are three."""
    km, drag = "total_km", "is_along_track_dominant"
    series = {
        "spearman_score_vs_total_km": ("base_score", km, "true"), "spearman_score_vs_km_per_hour": ("base_score", "km_per_hour", "true"), "spearman_age_vs_total_km": ("element_age_hours_at_prediction", km, "true"),
        "spearman_score_vs_total_km_drag_like": ("base_score", km, drag), "spearman_altitude_vs_total_km_drag_like": ("mean_altitude_km_at_prediction", km, drag),
    }
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), X.count_if(F.col(drag)).alias("drag_like_pairs")).crossJoin(F.broadcast(disagreement.agg(X.count_if(F.col("measurement_quality") != "ok").alias("excluded"))))  # one row each
    names = [("pairs", "pairs"), ("excluded_pairs_outside_envelope", "excluded"), ("drag_like_pairs", "drag_like_pairs"), *[(m, None) for m in series]]
    listed = counts.select("drag_like_pairs", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(c) if c else F.lit(None)).cast("double").alias("n")) for m, c in names])))
    wanted = listed.where("drag_like_pairs >= 3 OR NOT contains(metric, 'drag_like')")
    rho = stats.spearman_many(pairs, series).select("metric", X.round_half_up("rho", 4).alias("rho"))
    return wanted.join(rho, "metric", "left").select("metric", F.coalesce("n", "rho", F.lit(0.0)).alias("value"))
