"""What the service, the report, the dashboard and the charts read: small DataFrames over derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import sketches, stats
from ..operators import history

DISCLAIMER = "A trust signal for public orbit data, not a collision warning."
#: What is served, fixed paths, and the function here that gives it.
ROUTES = {"/health": "health", "/quality": "read_report and overall of operators.quality", "/space-weather": "space_weather", "/population": "population", "/reliability": "bottom, and the class and group summaries", "/reliability/{id}": "reliability_of", "/disagreement": "disagreement and top", "/validation": "validation_stats and validation_bins of plans.measure", "/metrics": "metrics and exposition"}
R = X.round_half_up


def count() -> Column:
    return F.count(F.lit(1))


def _labels(**labels: str | Column) -> Column:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.col(v) if isinstance(v, str) else v)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _gauges(row: DataFrame, **values: str) -> DataFrame:
    """One gauge for each column of a one-row frame."""
    named = F.array(*[F.struct(F.lit(k).alias("name"), _labels().alias("labels"), F.col(c).cast("double").alias("value")) for k, c in values.items()])
    return row.select(F.inline(named))


def _by(df: DataFrame, label: str, **values: str) -> DataFrame:
    """A gauge for each column and row, labelled by `label`; the table is read once for all of them."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), _labels(**{label: label}).alias("labels"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for n, c in values.items()])
    return df.select(F.inline(named))


#: Gauges of raw history: table, column, and whether it is the distinct values or the rows that count.
SKETCHED = {
    "objects_tracked": ("orbital_snapshot_history", "norad_catalog_id", True), "orbital_snapshots": ("orbital_snapshot_history", "snapshot_at_utc", True), "magnetic_history_rows": ("noaa_magnetic_history", "snapshot_at_utc", False),
    "plasma_history_rows": ("noaa_plasma_history", "snapshot_at_utc", False), "satnogs_distinct_satellites": ("satnogs_observation_history", "norad_catalog_id", True), "satnogs_distinct_stations": ("satnogs_observation_history", "station_id", True),
}


def sketched_gauges(kept: DataFrame) -> DataFrame:
    """The gauges of raw history from the loads' sketches."""
    m = sketches.merged(kept, ["table"]).withColumn("distinct", sketches.estimate())
    own = lambda table, column, distinct: F.coalesce(F.max(F.when((F.col("table") == table) & (F.col("column") == column), F.col("distinct" if distinct else "rows"))), F.lit(0))
    return _gauges(m.agg(*[own(*which).alias(n) for n, which in SKETCHED.items()]), **{n: n for n in SKETCHED})


def metrics(t: dict[str, DataFrame]) -> DataFrame:
    """All gauges as (name, labels, value). Tables that are missing give no gauges; those of raw history count as empty.

    Where `distinct_sketches` are given, the gauges of raw history come from them alone, and no history is read.
    """
    z = lambda c: F.coalesce(c, F.lit(0.0))
    parts = []
    if "distinct_sketches" in t:
        parts.append(sketched_gauges(t["distinct_sketches"]))
        t = {k: v for k, v in t.items() if k not in history.SKETCHED}
    if "orbital_snapshot_history" in t:
        h = t["orbital_snapshot_history"].agg(F.countDistinct("norad_catalog_id").alias("o"), F.countDistinct("snapshot_at_utc").alias("s"))
        parts.append(_gauges(h, objects_tracked="o", orbital_snapshots="s"))
    for name, table in (("magnetic_history_rows", "noaa_magnetic_history"), ("plasma_history_rows", "noaa_plasma_history")):
        if table in t:
            parts.append(_gauges(t[table].agg(count().alias("n")), **{name: "n"}))
    if "propagation_disagreement" in t:
        row = disagreement(t["propagation_disagreement"]).withColumn("excluded", F.col("excluded_long_span") + F.col("excluded_extreme"))
        parts.append(_gauges(row, disagreement_pairs="pairs", disagreement_median_km="median_total_km", disagreement_max_km="maximum_total_km", disagreement_median_span_hours="median_span_hours", disagreement_excluded_pairs="excluded"))
    if "validation_stats" in t:
        parts.append(_by(t["validation_stats"], "metric", validation_metric="value"))
    if "reliability_class_summary" in t:
        parts.append(_by(t["reliability_class_summary"], "reliability_class", ori_class_objects="object_count"))
    if "orbit_reliability_index" in t:
        parts.append(_gauges(t["orbit_reliability_index"].select("environment_factor").limit(1), environment_factor="environment_factor"))
    if "freshness_by_group" in t:
        parts.append(_by(t["freshness_by_group"], "source_group", group_objects="object_count", freshness_median_age_hours="median_age_hours", freshness_stale_percent="stale_percent"))
    if "space_weather_hourly" in t:
        level = F.col("disturbance_level")
        row = t["space_weather_hourly"].agg(z(R(F.min("minimum_bz_gsm"), 2)).alias("b"), z(R(F.max("average_proton_speed"), 2)).alias("v"), X.count_if(level == "southward_bz").alias("s"), X.count_if(level == "fast_wind").alias("f"))
        parts.append(_gauges(row, spaceweather_min_bz_nt="b", spaceweather_max_proton_speed="v", spaceweather_southward_bz_hours="s", spaceweather_fast_wind_hours="f"))
    if "sw_index_daily" in t:
        d = t["sw_index_daily"]
        last = lambda c, n: z(R(F.max_by(c, "observation_date"), n))
        row = d.agg(count().alias("n"), z(R(F.max("kp_sum"), 2)).alias("k"), z(R(F.max("ap_avg"), 1)).alias("a"), z(R(F.max("f10_7_observed"), 1)).alias("f"), last("kp_sum", 2).alias("lk"), last("ap_avg", 1).alias("la"), last("f10_7_observed", 1).alias("lf"))
        parts.append(_gauges(row, sw_index_days="n", sw_max_kp_sum_5y="k", sw_max_ap_5y="a", sw_max_f10_7_5y="f", sw_latest_kp_sum="lk", sw_latest_ap_avg="la", sw_latest_f10_7="lf"))
    if "debris_population" in t:
        own = t["debris_population"]
        row = debris_summary(own).crossJoin(F.broadcast(own.agg(X.percent(X.count_if(F.col("element_age_hours") > X.STALE_HOURS), count()).alias("stale"))))  # one row each
        row = row.select("objects", *[z(F.col(c)).alias(c) for c in ("median_altitude_km", "median_bstar", "stale")])
        parts.append(_gauges(row, debris_objects="objects", debris_median_altitude_km="median_altitude_km", debris_median_bstar="median_bstar", debris_stale_percent="stale"))
    if "satnogs_activity" in t:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        row = t["satnogs_activity"].agg(count().alias("days"), *map(total, ("observation_count", "good_count", "completed_count", "scheduled_count")))
        parts.append(_gauges(row, satnogs_days="days", satnogs_observations="observation_count", satnogs_good_observations="good_count", satnogs_completed_observations="completed_count", satnogs_scheduled_observations="scheduled_count"))
        rate = row.where("completed_count > 0").select(R(F.lit(100.0) * F.col("good_count") / F.col("completed_count"), 1).alias("p"))
        parts.append(_gauges(rate, satnogs_good_percent_of_completed="p"))
    if "satnogs_observation_history" in t:
        row = t["satnogs_observation_history"].agg(F.countDistinct("norad_catalog_id").alias("o"), F.countDistinct("station_id").alias("s"))
        parts.append(_gauges(row, satnogs_distinct_satellites="o", satnogs_distinct_stations="s"))
    if "quality" in t:
        s = F.col("status")
        parts.append(_gauges(t["quality"].agg(count().alias("n"), X.count_if(s == "fail").alias("f"), X.count_if(s == "warn").alias("w")), quality_checks_total="n", quality_failures="f", quality_warnings="w"))
    if not parts:
        raise ValueError("no table to serve")
    out = _gauges(parts[0].sparkSession.range(1).select(F.lit(1.0).alias("one")), database_reachable="one")
    for p in parts:
        out = out.unionByName(p)
    return out


def exposition(gauges: DataFrame, prefix: str = "orbit_") -> str:
    """The gauges in the text form that scrapers read."""
    out, last = [], None
    for name, labels, value in gauges.orderBy("name", F.to_json("labels")).collect():  # a few dozen rows
        if name != last:
            out.append(f"# TYPE {prefix}{name} gauge")
            last = name
        text = ",".join(f'{k}="{v}"' for k, v in sorted((labels or {}).items()))
        out.append(f"{prefix}{name}{'{' + text + '}' if text else ''} {value}")
    return "\n".join(out) + "\n"


def routes() -> dict[str, object]:
    """The index of what is served."""
    return {"routes": ROUTES, "disclaimer": DISCLAIMER}


#: Tables whose rows are reported, fixed names.
HEALTH = ("orbital_snapshot_history", "noaa_magnetic_history", "noaa_plasma_history", "propagation_disagreement", "validation_pairs")


def health(spark: SparkSession, tables: dict[str, DataFrame], names: tuple[str, ...] = HEALTH) -> DataFrame:
    """(table, rows) of each name; a table that is absent has 0."""
    out = spark.createDataFrame([(n, 0) for n in names if n not in tables], "table string, rows long")
    for n in names:
        if n in tables:
            out = out.unionByName(tables[n].agg(count().alias("rows")).select(F.lit(n).alias("table"), "rows"))
    return out


def space_weather(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("disturbance_level").agg(count().alias("hours"), F.min("minimum_bz_gsm").alias("minimum_bz_gsm"), F.max("average_proton_speed").alias("maximum_proton_speed"), F.max("hour_utc").alias("last_hour_utc"))


def population(freshness_by_group: DataFrame, orbital: DataFrame) -> DataFrame:
    """Groups with their freshness and all objects ever seen in them."""
    seen = orbital.groupBy("source_group").agg(F.countDistinct("norad_catalog_id").alias("distinct_objects"), F.countDistinct("snapshot_at_utc").alias("snapshots"))
    return freshness_by_group.join(seen, "source_group", "left")


def bottom(df: DataFrame, by: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(by), key).limit(n)


def top(df: DataFrame, by: str | Column, key: str, n: int) -> DataFrame:
    return df.orderBy(X.col(by).desc_nulls_last(), key).limit(n)


def reliability_of(index: DataFrame, norad_catalog_id: int) -> DataFrame:
    """The breakdown of one object; no row if it is unknown."""
    return index.where(F.col("norad_catalog_id") == F.lit(norad_catalog_id))


def disagreement(measured: DataFrame) -> DataFrame:
    """One row: medians of what is inside the envelope, and how many pairs are outside by label."""
    q = F.col("measurement_quality")
    own = measured.select("measurement_quality", F.when(q == "ok", F.col("total_km")).alias("km"), F.when(q == "ok", F.col("propagation_span_hours")).alias("span"))
    plain = [X.count_if(q == "ok").alias("pairs"), R(F.max("km"), 3).alias("maximum_total_km"), X.count_if(q == "long_span").alias("excluded_long_span"), X.count_if(q == "extreme").alias("excluded_extreme")]
    row = stats.summary(own, [], plain, {"median_total_km": ("km", 0.5), "median_span_hours": ("span", 0.5)})
    return row.withColumns({"median_total_km": R("median_total_km", 3), "median_span_hours": R("median_span_hours", 2)})


def index_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(count().alias("days"), F.min("observation_date").alias("first_day"), F.max("observation_date").alias("last_day"), R(F.min("kp_sum"), 2).alias("minimum_kp_sum"), R(F.max("kp_sum"), 2).alias("maximum_kp_sum"), R(F.max("ap_avg"), 1).alias("maximum_ap"), R(F.max("f10_7_observed"), 1).alias("maximum_f10_7"))


def activity_summary(activity: DataFrame, observations: DataFrame) -> DataFrame:
    """Sums over days, and beside the sums of daily distinct counts the true ones."""
    days = activity.agg(count().alias("days"), F.sum("observation_count").alias("observations"), F.sum("good_count").alias("good"), F.sum("completed_count").alias("completed"), F.sum("scheduled_count").alias("scheduled"), F.sum("distinct_satellites").alias("satellite_days"), F.sum("distinct_stations").alias("station_days"))
    true = observations.agg(F.countDistinct("norad_catalog_id").alias("distinct_satellites"), F.countDistinct("station_id").alias("distinct_stations"))
    return days.crossJoin(F.broadcast(true)).withColumn("good_percent_of_completed", X.percent(F.col("good"), F.col("completed")))  # one row each


def debris_summary(debris: DataFrame) -> DataFrame:
    places = {"median_altitude_km": ("mean_altitude_km", 1), "median_age_hours": ("element_age_hours", 1), "median_bstar": ("bstar_drag_term", 8)}
    row = stats.summary(debris, [], [count().alias("objects")], {n: (c, 0.5) for n, (c, _) in places.items()})
    return row.withColumns({n: R(n, d) for n, (_, d) in places.items()})


def change_refresh(change: DataFrame) -> DataFrame:
    same = F.col("same_element_set")
    return change.agg(count().alias("compared"), X.count_if(same).alias("same_set"), X.count_if(~same).alias("refreshed"), X.percent(X.count_if(~same), count()).alias("refreshed_percent"))


def latest_by_group(orbital: DataFrame) -> DataFrame:
    """Objects in each group's newest snapshot, by the group's own maximum."""
    last = orbital.groupBy("source_group").agg(F.max("snapshot_at_utc").alias("snapshot_at_utc"))
    return orbital.join(last, ["source_group", "snapshot_at_utc"], "left_semi").groupBy("source_group").agg(count().alias("object_count"), F.countDistinct("norad_catalog_id").alias("unique_objects"))


def lakehouse(silver: DataFrame) -> DataFrame:
    """Counts, distinct objects and median altitude by group, from current files in an object store."""
    typed = silver.select("source_group", X.number("norad_catalog_id", "long").alias("id"), X.altitude(X.number("mean_motion_revolutions_per_day")).alias("km"))
    plain = [count().alias("rows"), F.countDistinct("id").alias("objects")]
    return stats.summary(typed, ["source_group"], plain, {"median_altitude_km": ("km", 0.5)}).withColumn("median_altitude_km", R("median_altitude_km", 1))


def raw_counts(elements: DataFrame) -> DataFrame:
    """One row: records and distinct objects of raw element files (columns of the payload, file_path)."""
    return elements.agg(count().alias("rows"), F.countDistinct(X.number("NORAD_CAT_ID", "long")).alias("objects"))


def raw_groups(elements: DataFrame) -> DataFrame:
    """Distinct objects of each group of raw element files, the group taken from the file's name."""
    group = F.regexp_extract("file_path", r"([a-z0-9-]+)_\d{8}T\d{6}Z\.csv$", 1).alias("source_group")
    return elements.groupBy(group).agg(F.countDistinct(X.number("NORAD_CAT_ID", "long")).alias("objects"))


def raw_median_altitude(elements: DataFrame, group: str = "cubesat") -> DataFrame:
    """One row: the median altitude of one group's raw records with a positive motion."""
    own = elements.where(F.regexp_extract("file_path", r"([a-z0-9-]+)_\d{8}T\d{6}Z\.csv$", 1) == group).select(X.altitude(X.number("MEAN_MOTION")).alias("km"))
    return stats.quantiles(own, [], {"median_altitude_km": ("km", 0.5)}).select(R("median_altitude_km", 1).alias("median_altitude_km"))


def current_rows(silver: DataFrame) -> DataFrame:
    """One row: how many rows a current file has."""
    return silver.agg(count().alias("rows"))


def chart_rows(name: str, t: dict[str, DataFrame]) -> DataFrame:
    """The rows behind one chart, from the table that it needs."""
    return CHARTS[name](t)


def chart_extracts(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows behind each chart; drawing is left to the caller."""
    return {name: make(t) for name, make in CHARTS.items()}


CHARTS = {
    "bz_series": lambda t: t["space_weather_minute"].where("bz_gsm_nanotesla IS NOT NULL").select("observation_minute_utc", "bz_gsm_nanotesla").orderBy("observation_minute_utc"),
    "hourly_weather": lambda t: t["space_weather_hourly"].select("hour_utc", "average_bz_gsm", "average_proton_speed", "disturbance_level").orderBy("hour_utc"),
    "altitude_by_inclination": lambda t: t["orbit_features"].where("mean_altitude_km IS NOT NULL AND inclination_degrees IS NOT NULL").select("inclination_degrees", "mean_altitude_km", "source_group"),
    "largest_changes": lambda t: top(t["orbit_change"].where("decay_rate_km_per_day IS NOT NULL").select("object_name", "norad_catalog_id", "decay_rate_km_per_day", "snapshot_at_utc"), F.abs(F.col("decay_rate_km_per_day")), "norad_catalog_id", 25),
    "freshness": lambda t: t["element_freshness"].where("element_age_hours IS NOT NULL").select("source_group", "element_age_hours"),
    "index_by_age": lambda t: t["orbit_reliability_index"].where("element_age_hours IS NOT NULL AND orbit_reliability_index IS NOT NULL").select("element_age_hours", "orbit_reliability_index", "reliability_class"),
    "disagreement": lambda t: t["propagation_disagreement"].where("measurement_quality = 'ok'").select("propagation_span_hours", "total_km"),
    "daily_indices": lambda t: t["sw_index_daily"].select("observation_date", "kp_sum", "ap_avg", "f10_7_observed").orderBy("observation_date"),
}


def report(rows: dict[str, list[dict]]) -> str:
    """A Markdown report of small results that were collected by name."""
    out = ["# Orbit and space-weather report", "", DISCLAIMER, ""]
    for name, data in rows.items():
        out += [f"## {name.replace('_', ' ').capitalize()}", "", *_table(data), ""]
    return "\n".join(out)


def _table(data: list[dict]) -> list[str]:
    if not data:
        return ["No rows."]
    head = list(data[0])
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join("–" if r[h] is None else str(r[h]) for h in head) + " |" for r in data]]


#: Sections of the research report and the derived tables that each needs.
SECTIONS = {
    "Coverage": ("orbital_snapshot_history",), "Orbit change": ("orbit_change", "orbital_snapshot_history"), "Propagation disagreement": ("propagation_disagreement",),
    "Index validation": ("validation_bins", "validation_stats"), "Element freshness": ("freshness_by_group", "freshness_by_band"), "Reliability index": ("reliability_class_summary", "orbit_reliability_index"),
    "Space weather of the last 24 hours": ("space_weather_hourly",), "Daily indices": ("sw_index_daily",), "Debris": ("debris_population",), "Ground stations": ("satnogs_activity", "satnogs_observation_history"),
}
LIMITS = "A change of mean motion stands for drag and is no measurement of density; manoeuvres look the same. A later element is an estimate too, not the truth. Medians and correlations describe what was collected and give no cause."


def last_hours(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """The hours from `hours` before the last one on."""
    last = hourly.agg(F.max("hour_utc").alias("last"))  # one row
    return hourly.join(F.broadcast(last), F.col("hour_utc") > F.col("last") - F.expr(f"INTERVAL {hours} HOURS")).drop("last")


def largest_changes(change: DataFrame, n: int = 10) -> DataFrame:
    """Objects with the fastest decay among pairs whose element was refreshed."""
    rows = change.where("NOT same_element_set AND decay_rate_km_per_day IS NOT NULL")
    return top(rows, "decay_rate_km_per_day", "object_name", n).select("object_name", R("decay_rate_km_per_day", 4).alias("decay_rate_km_per_day"), "interval_minutes")


def disagreement_by_axis(measured: DataFrame) -> DataFrame:
    """One row: spans and medians of what is inside the envelope, in total and by axis."""
    ok = measured.where("measurement_quality = 'ok'")
    plain = [count().alias("pairs"), R(F.max("propagation_span_hours"), 2).alias("maximum_span_hours"), R(F.max("total_km"), 3).alias("maximum_total_km")]
    wanted = {"median_span_hours": ("propagation_span_hours", 2), "median_total_km": ("total_km", 3), "median_along_track_km": ("along_track_km", 3), "median_radial_km": ("radial_km", 3), "median_cross_track_km": ("cross_track_km", 3)}
    return stats.summary(ok, [], plain, {n: (c, 0.5) for n, (c, _) in wanted.items()}).withColumns({n: R(n, d) for n, (_, d) in wanted.items()})


def sections(t: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """The small results of each section whose tables are there; sections are in order, results have titles."""
    made = {
        "Coverage": lambda: {"Snapshots and objects": t["orbital_snapshot_history"].agg(F.countDistinct("snapshot_at_utc").alias("snapshots"), F.countDistinct("norad_catalog_id").alias("objects_ever_seen")), "Latest snapshot of each group": latest_by_group(t["orbital_snapshot_history"]).orderBy("source_group")},
        "Orbit change": lambda: {"Pairs compared": change_refresh(t["orbit_change"]), "Largest changes": largest_changes(t["orbit_change"])},
        "Propagation disagreement": lambda: {"Inside the envelope": disagreement_by_axis(t["propagation_disagreement"]), "Outside the envelope": t["propagation_disagreement"].where("measurement_quality <> 'ok'").groupBy("measurement_quality").agg(count().alias("pairs")).orderBy("measurement_quality"), "Largest": top(t["propagation_disagreement"].where("measurement_quality = 'ok'"), "total_km", "object_name", 10).select("object_name", "source_group", R("propagation_span_hours", 1).alias("span_hours"), R("total_km", 2).alias("total_km"), R("along_track_km", 2).alias("along_track_km"))},
        "Index validation": lambda: {"By predicted class": t["validation_bins"].orderBy("pair_count"), "Rank correlations": t["validation_stats"].orderBy("metric")},
        "Element freshness": lambda: {"By group": t["freshness_by_group"].orderBy("source_group"), "By altitude": t["freshness_by_band"].orderBy("median_age_hours")},
        "Reliability index": lambda: {"Environment": t["orbit_reliability_index"].select("environment_factor", "context_through_hour").limit(1), "Classes": t["reliability_class_summary"].orderBy("median_index"), "Least reliable": bottom(t["orbit_reliability_index"], "orbit_reliability_index", "object_name").select("object_name", "source_group", "orbit_reliability_index", "element_age_hours")},
        "Space weather of the last 24 hours": lambda: {"Levels": space_weather(last_hours(t["space_weather_hourly"])).orderBy("disturbance_level")},
        "Daily indices": lambda: {"Range": index_summary(t["sw_index_daily"])},
        "Debris": lambda: {"Cohort": debris_summary(t["debris_population"]), "Altitudes": t["debris_population"].agg(F.min("mean_altitude_km").alias("lowest_km"), F.max("mean_altitude_km").alias("highest_km"), F.max("element_age_hours").alias("oldest_element_hours"))},
        "Ground stations": lambda: {"Activity": activity_summary(t["satnogs_activity"], t["satnogs_observation_history"])},
    }
    return {name: make() for name, make in made.items() if all(n in t for n in SECTIONS[name])}


def research_report(t: dict[str, DataFrame], generated_at: str) -> str:
    """The Markdown report of all derived tables that are there; results are small and collected one by one."""
    out = ["# Research report", "", f"Generated: {generated_at}", "", DISCLAIMER, ""]
    for name, results in sections(t).items():
        out += [f"## {name}", ""]
        for title, df in results.items():
            out += [f"### {title}", "", *_table([r.asDict() for r in df.collect()]), ""]  # summaries and tops of ten
    return "\n".join([*out, "## Limits", "", LIMITS, ""])


#: Dashboard panels, fixed values: title, kind and the gauges that they read, each with a factor.
PANELS = [
    ("Database", "stat", {"database_reachable": 1}), ("Quality Failures", "stat", {"quality_failures": 1}), ("Environment Factor", "stat", {"environment_factor": 1}), ("Objects Tracked", "stat", {"objects_tracked": 1}),
    ("Measured Pairs", "stat", {"disagreement_pairs": 1}), ("Median Disagreement", "stat", {"disagreement_median_km": 1}), ("ORI Validation (Spearman)", "stat", {"validation_metric": 1}),
    ("Space Weather (24 h)", "stat", {"spaceweather_min_bz_nt": 1, "spaceweather_max_proton_speed": 1, "spaceweather_southward_bz_hours": 1}), ("Max Disagreement", "stat", {"disagreement_max_km": 1}),
    ("Reliability Class Distribution", "timeseries", {"ori_class_objects": 1}), ("Median Element Age by Group", "timeseries", {"freshness_median_age_hours": 60}), ("Debris Cohort", "stat", {"debris_objects": 1}), ("Debris Stale %", "stat", {"debris_stale_percent": 1}),
    ("Peak Daily Kp Sum", "stat", {"sw_max_kp_sum_5y": 1}), ("Latest Kp Sum", "stat", {"sw_latest_kp_sum": 1}), ("Latest F10.7", "stat", {"sw_latest_f10_7": 1}), ("SatNOGS Observations", "stat", {"satnogs_observations": 1}),
    ("SatNOGS Completed Passes", "stat", {"satnogs_completed_observations": 1}), ("SatNOGS Good Pass Rate", "stat", {"satnogs_good_percent_of_completed": 1}),
]


def panels(gauges: DataFrame) -> DataFrame:
    """(panel, kind, name, labels, value): what each panel shows; panels without a value come with nulls."""
    spark = gauges.sparkSession
    wanted = spark.createDataFrame([(p, k, n, float(f)) for p, k, g in PANELS for n, f in g.items()], "panel string, kind string, name string, factor double")
    return F.broadcast(wanted).join(gauges, "name", "left").select("panel", "kind", "name", "labels", (F.col("value") * F.col("factor")).alias("value"))


def probe(shown: DataFrame) -> DataFrame:
    """(panel, status): `ok` for a panel with a value, `empty` for one without."""
    return shown.groupBy("panel").agg(F.when(F.count("value") > 0, "ok").otherwise("empty").alias("status"))
