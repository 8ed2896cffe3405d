"""Queries over the star-schema tables, each with the SQL that another engine runs for the same rows.

The derived tables are built by their own builders over views of `events` and `orders` in the shape of the history
tables, so that SQL holds the builders themselves to account.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import sketches, stats
from ..operators import quality
from ..session import new_folder
from ..streaming import pending, replay, weather
from . import gold, measure, serve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The tables of a folder, and history views of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def orbital(self) -> DataFrame:
        c = F.col
        return self.events.select(
            c("ts").cast("timestamp").alias("snapshot_at_utc"), F.concat(F.lit("OBJ-"), c("user_id")).alias("object_name"), c("user_id").alias("norad_catalog_id"), X.trunc("day", "ts").alias("element_epoch_utc"),
            (c("event_id") % 180).cast("double").alias("inclination_degrees"), ((c("event_id") % 40) / F.lit(1000.0)).alias("eccentricity"), (F.lit(11.0) + c("value") / F.lit(100.0)).alias("mean_motion_revolutions_per_day"), (c("value") / F.lit(1000000.0)).alias("bstar_drag_term"),
            (c("event_id") % 360).cast("double").alias("ra_of_asc_node_degrees"), (c("event_id") % 350).cast("double").alias("arg_of_pericenter_degrees"), (c("event_id") % 340).cast("double").alias("mean_anomaly_degrees"), F.lit(0.0).alias("mean_motion_dot"), F.lit(0.0).alias("mean_motion_ddot"),
            c("event_type").alias("source_group"), F.concat(F.lit("f"), (c("event_id") % 50)).alias("source_file"), F.lit("x").alias("source_sha256"),
        )

    def daily(self) -> DataFrame:
        """The same elements as one snapshot a day, so that the latest holds many objects."""
        rows = self.orbital().withColumn("element_epoch_utc", X.naive("snapshot_at_utc"))
        return rows.withColumn("snapshot_at_utc", (X.trunc("day", "element_epoch_utc") + F.expr("INTERVAL 1 DAY")).cast("timestamp"))

    def magnetic(self) -> DataFrame:
        c = F.col
        rows = self.events.where(c("event_type").isin("view", "click"))
        return rows.select((X.trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("snapshot_at_utc"), c("ts").alias("observed_at_utc"), F.concat(c("event_type"), F.lit("-"), c("event_id")).alias("spacecraft"), (c("event_id") % 2 == 0).alias("is_active_source"), c("value").alias("bt"), (c("value") / 2).alias("bx_gsm"), (-c("value")).alias("by_gsm"), F.when(c("event_id") % 11 != 0, F.lit(60.0) - c("value")).alias("bz_gsm"), (c("event_id") % 3).cast("int").alias("quality_code"))

    def plasma(self) -> DataFrame:
        c = F.col
        rows = self.events.where(c("event_type").isin("purchase", "signup"))
        return rows.select((X.trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("snapshot_at_utc"), c("ts").alias("observed_at_utc"), F.concat(c("event_type"), F.lit("-"), c("event_id")).alias("spacecraft"), (c("event_id") % 2 == 0).alias("is_active_source"), (c("value") * 8.0).alias("proton_speed"), (c("value") * 100.0).alias("proton_temperature"), (c("value") / 7.0).alias("proton_density"), (c("event_id") % 3).cast("int").alias("quality_code"))

    def indices(self) -> DataFrame:
        c = F.col
        kp = [((c("o_orderkey") * i) % 91).cast("double").alias(f"kp{i}") for i in range(1, 9)]
        return self.orders.select((c("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey)")).cast("timestamp").alias("snapshot_at_utc"), c("o_orderdate").cast("date").alias("observation_date"), *kp, (c("o_orderkey") % 721).cast("double").alias("kp_sum"), (c("o_custkey") % 100).cast("double").alias("ap_avg"), (c("o_custkey") % 200).cast("double").alias("sunspot_number"), F.round(c("o_totalprice") / F.lit(1000.0), 0).alias("f10_7_observed"), c("o_orderstatus").alias("f10_7_data_type"))

    def observations(self) -> DataFrame:
        c = F.col
        status = F.when(c("event_type") == "view", "good").when(c("event_type") == "click", "bad").when(c("event_type") == "error", "failed").when(c("event_type") == "signup", "future").otherwise("unknown")
        return self.events.select(c("ts").cast("timestamp").alias("snapshot_at_utc"), (c("event_id") % 3001).alias("observation_id"), c("ts").alias("start_utc"), c("ts").alias("end_utc"), status.alias("status"), c("user_id").alias("norad_catalog_id"), (c("event_id") % 53).alias("station_id"))

    def silver(self) -> DataFrame:
        """Text columns, as current files have them."""
        c = F.col
        return self.orbital().select(
            F.when(c("source_group") == "error", gold.COHORT).otherwise(c("source_group")).alias("source_group"), "object_name", c("norad_catalog_id").cast("string").alias("norad_catalog_id"), F.date_format("element_epoch_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("element_epoch_utc"),
            F.format_string("%.1f", "inclination_degrees").alias("inclination_degrees"), F.format_string("%.3f", "eccentricity").alias("eccentricity"), F.format_string("%.6f", "mean_motion_revolutions_per_day").alias("mean_motion_revolutions_per_day"), F.lit("").alias("bstar_drag_term"),
            F.date_format(X.naive("snapshot_at_utc"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at_utc"), F.lit("https://example.org/elements").alias("source_url"),
        )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` places, so that the last bits of sums and powers don't count."""
    return df.select(*[X.round_half_up(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


AXIS = "POWER(398600.4418::DOUBLE / POWER({} * 2.0::DOUBLE * PI() / 86400.0::DOUBLE, 2), 1.0::DOUBLE / 3.0::DOUBLE)"
ALT = f"({AXIS} - 6378.137::DOUBLE)"
BAND = "CASE WHEN {0} < 300 THEN 'very_low_leo' WHEN {0} < 600 THEN 'lower_leo' WHEN {0} < 2000 THEN 'upper_leo' ELSE 'above_leo' END"
CLASS = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'moderate' WHEN {0} >= 40 THEN 'reduced' ELSE 'low' END"
ORBITAL = "SELECT ts AS snapshot_at_utc, 'OBJ-' || user_id AS object_name, user_id AS norad_catalog_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS element_epoch_utc, CAST(event_id % 180 AS DOUBLE) AS inclination_degrees, CAST(event_id % 40 AS DOUBLE) / 1000.0::DOUBLE AS eccentricity, 11.0::DOUBLE + value / 100.0::DOUBLE AS mean_motion_revolutions_per_day, value / 1000000.0::DOUBLE AS bstar_drag_term, event_type AS source_group, 'f' || (event_id % 50) AS source_file, event_id FROM events"
_NOAA = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS snapshot_at_utc, ts AS observed_at_utc, event_type || '-' || event_id AS spacecraft, event_id % 2 = 0 AS is_active_source, {}, CAST(event_id % 3 AS INTEGER) AS quality_code FROM events WHERE event_type IN {}"
MAGNETIC = _NOAA.format("value AS bt, value / 2 AS bx_gsm, -value AS by_gsm, CASE WHEN event_id % 11 <> 0 THEN 60.0::DOUBLE - value END AS bz_gsm", "('view', 'click')")
PLASMA = _NOAA.format("value * 8.0::DOUBLE AS proton_speed, value * 100.0::DOUBLE AS proton_temperature, value / 7.0::DOUBLE AS proton_density", "('purchase', 'signup')")
OBSERVATIONS = "SELECT ts AS snapshot_at_utc, event_id % 3001 AS observation_id, ts AS start_utc, CASE event_type WHEN 'view' THEN 'good' WHEN 'click' THEN 'bad' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'future' ELSE 'unknown' END AS status, user_id AS norad_catalog_id, event_id % 53 AS station_id FROM events"


def _ranked(name: str) -> str:
    return f"SELECT *, CAST(date_trunc('minute', observed_at_utc) AS TIMESTAMP) AS observation_minute_utc, row_number() OVER (PARTITION BY date_trunc('minute', observed_at_utc) ORDER BY is_active_source DESC NULLS LAST, quality_code ASC NULLS LAST, snapshot_at_utc DESC, observed_at_utc DESC, spacecraft) AS rk FROM {name}"


MINUTE = f"""m AS ({MAGNETIC}), p AS ({PLASMA}), mr AS ({_ranked("m")}), pr AS ({_ranked("p")}),
minutes AS (SELECT mr.observation_minute_utc, mr.observed_at_utc AS magnetic_observed_at_utc, pr.observed_at_utc AS plasma_observed_at_utc, mr.spacecraft AS magnetic_spacecraft, pr.spacecraft AS plasma_spacecraft, mr.is_active_source AS magnetic_source_is_active, pr.is_active_source AS plasma_source_is_active, bt AS total_field_nanotesla, bx_gsm AS bx_gsm_nanotesla, by_gsm AS by_gsm_nanotesla, bz_gsm AS bz_gsm_nanotesla, proton_speed AS proton_speed_km_per_second, proton_temperature AS proton_temperature_kelvin, proton_density AS proton_density_per_cubic_cm, mr.quality_code AS magnetic_quality_code, pr.quality_code AS plasma_quality_code FROM mr LEFT JOIN pr ON mr.observation_minute_utc = pr.observation_minute_utc AND pr.rk = 1 WHERE mr.rk = 1)"""
HOURLY = MINUTE + """, hours AS (SELECT CAST(date_trunc('hour', observation_minute_utc) AS TIMESTAMP) AS hour_utc, AVG(bz_gsm_nanotesla) AS average_bz_gsm, MIN(bz_gsm_nanotesla) AS minimum_bz_gsm, AVG(proton_speed_km_per_second) AS average_proton_speed, AVG(proton_density_per_cubic_cm) AS average_proton_density, COUNT(*) AS minute_count, COUNT(bz_gsm_nanotesla) AS minutes_with_bz FROM minutes GROUP BY 1),
hourly AS (SELECT *, CASE WHEN average_bz_gsm < -5 THEN 'southward_bz' WHEN average_proton_speed > 500 THEN 'fast_wind' ELSE 'quiet' END AS disturbance_level FROM hours)"""
CURRENT = f"""o AS (SELECT * REPLACE (snapshot_at_utc AS element_epoch_utc, CAST(date_trunc('day', snapshot_at_utc) AS TIMESTAMP) + INTERVAL 1 DAY AS snapshot_at_utc) FROM ({ORBITAL})), latest AS (SELECT source_group AS g, MAX(snapshot_at_utc) AS s FROM o GROUP BY 1),
cur AS (SELECT o.*, date_diff('minute', element_epoch_utc, snapshot_at_utc) / 60.0::DOUBLE AS age, {ALT.format("mean_motion_revolutions_per_day")} AS alt FROM o JOIN latest ON source_group = g AND snapshot_at_utc = s WHERE mean_motion_revolutions_per_day > 0),
fresh AS (SELECT object_name, norad_catalog_id, source_group, element_epoch_utc, age AS element_age_hours, age > 24 AS is_stale_over_24_hours, alt AS mean_altitude_km, {BAND.format("alt")} AS altitude_band FROM cur)"""
INDEX = HOURLY + ", " + CURRENT + f""", ctx AS (SELECT CASE WHEN COUNT(*) FILTER (WHERE disturbance_level = 'southward_bz') > 0 THEN 0.8::DOUBLE WHEN COUNT(*) FILTER (WHERE disturbance_level = 'fast_wind') > 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS environment_factor, MAX(hour_utc) AS context_through_hour FROM hourly WHERE hour_utc >= (SELECT MAX(hour_utc) FROM hourly) - INTERVAL 3 HOUR),
sc AS (SELECT *, 100.0::DOUBLE * GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 1.0::DOUBLE - age / 48.0::DOUBLE)) AS fr, 100.0::DOUBLE * GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, (alt - 300.0::DOUBLE) / 500.0::DOUBLE)) AS dr FROM cur),
bs AS (SELECT *, 0.55::DOUBLE * fr + 0.45::DOUBLE * dr AS b FROM sc),
idx AS (SELECT object_name, norad_catalog_id, source_group, ROUND(age, 2) AS element_age_hours, ROUND(alt, 2) AS mean_altitude_km, ROUND(fr, 1) AS freshness_score, ROUND(dr, 1) AS drag_safety_score, environment_factor, context_through_hour, ROUND(b, 1) AS base_score, ROUND(b * environment_factor, 1) AS orbit_reliability_index, {CLASS.format("b * environment_factor")} AS reliability_class FROM bs, ctx)"""
CHANGE = f"""o AS ({ORBITAL}), lagged AS (SELECT *, LAG(snapshot_at_utc) OVER w AS ps, LAG(element_epoch_utc) OVER w AS pe, LAG(mean_motion_revolutions_per_day) OVER w AS pm, LAG(eccentricity) OVER w AS pc FROM o WINDOW w AS (PARTITION BY norad_catalog_id ORDER BY snapshot_at_utc, element_epoch_utc)),
c AS (SELECT *, date_diff('minute', ps, snapshot_at_utc) AS mins, {AXIS.format("pm")} AS pa, {AXIS.format("mean_motion_revolutions_per_day")} AS ca FROM lagged WHERE pm > 0 AND mean_motion_revolutions_per_day > 0),
change AS (SELECT object_name, norad_catalog_id, ps AS previous_snapshot_at_utc, snapshot_at_utc, mins AS interval_minutes, pe AS previous_element_epoch_utc, element_epoch_utc, pe = element_epoch_utc AS same_element_set, pm AS previous_mean_motion, mean_motion_revolutions_per_day, mean_motion_revolutions_per_day - pm AS mean_motion_delta, pc AS previous_eccentricity, eccentricity, eccentricity - pc AS eccentricity_delta, inclination_degrees, pa AS previous_semi_major_axis_km, ca AS current_semi_major_axis_km, ca - pa AS semi_major_axis_change_km, CASE WHEN mins > 0 THEN -1.0::DOUBLE * (ca - pa) * 1440.0::DOUBLE / mins END AS decay_rate_km_per_day FROM c)"""
PAIRS = "pairs AS (SELECT norad_catalog_id, ps, snapshot_at_utc, pe, element_epoch_utc FROM lagged WHERE pe IS NOT NULL AND pe <> element_epoch_utc)"


def sql_quantile(column: str, share: float) -> str:
    """On rows ranked from 0 (`i`) to `last`: each value weighs what is left of 1 at its distance from the quantile's place."""
    return f"SUM({column} * GREATEST(0.0::DOUBLE, 1.0::DOUBLE - ABS(i - {share}::DOUBLE * last)))"


def sql_ranked(source: str, key: str, column: str) -> str:
    """Rows of `source` with their rank by `column` within `key`, and the rank of the last."""
    return f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {column}) - 1 AS i, COUNT(*) OVER (PARTITION BY {key}) - 1 AS last FROM {source} WHERE {column} IS NOT NULL)"


def sql_count(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def sql_rounded(with_: str, table: str, doubles: str, others: str, digits: int = 6) -> str:
    cols = [f"ROUND({c}, {digits}) AS {c}" for c in doubles.split()] + others.split()
    return f"WITH {with_} SELECT {', '.join(cols)} FROM {table}"


MINUTE_D = "total_field_nanotesla bx_gsm_nanotesla by_gsm_nanotesla bz_gsm_nanotesla proton_speed_km_per_second proton_temperature_kelvin proton_density_per_cubic_cm"
MINUTE_O = "observation_minute_utc magnetic_observed_at_utc plasma_observed_at_utc magnetic_spacecraft plasma_spacecraft magnetic_source_is_active plasma_source_is_active magnetic_quality_code plasma_quality_code"


def _minute(t: Tables) -> DataFrame:
    return gold.space_weather_minute(t.magnetic(), t.plasma())


def _hourly(t: Tables) -> DataFrame:
    return gold.space_weather_hourly(_minute(t))


def _index(t: Tables) -> DataFrame:
    return gold.orbit_reliability_index(t.daily(), _hourly(t))


_AT_SNAPSHOTS = f"""WITH {MINUTE}, w AS (SELECT observation_minute_utc AS m, bz_gsm_nanotesla AS bz, proton_speed_km_per_second AS speed FROM minutes), o AS ({ORBITAL}),
met AS (SELECT object_name, norad_catalog_id, source_group, snapshot_at_utc, CASE WHEN m >= snapshot_at_utc - INTERVAL 1 HOUR THEN m END AS m, bz, speed FROM o ASOF LEFT JOIN w ON snapshot_at_utc >= m)
SELECT object_name, norad_catalog_id, source_group, snapshot_at_utc, m AS observation_minute_utc, CASE WHEN m IS NOT NULL THEN ROUND(bz, 6) END AS bz_gsm_nanotesla, CASE WHEN m IS NOT NULL THEN ROUND(speed, 6) END AS proton_speed_km_per_second,
    date_diff('minute', m, snapshot_at_utc) AS weather_age_minutes, CASE WHEN m IS NULL THEN NULL WHEN bz < -5 THEN 'southward_bz' WHEN speed > 500 THEN 'fast_wind' ELSE 'quiet' END AS disturbance_level FROM met"""


@query("weather_at_snapshots", _AT_SNAPSHOTS)
def _q(spark, d):
    t = Tables(spark, d)
    return rounded(gold.weather_at_snapshots(t.orbital(), _minute(t), within_hours=1))


_LAST_DAY = f"""WITH {HOURLY} SELECT hour_utc, disturbance_level, ROUND(MIN(minimum_bz_gsm) OVER day, 6) AS lowest_bz_gsm, ROUND(MAX(average_proton_speed) OVER day, 6) AS highest_proton_speed, ROUND(AVG(average_bz_gsm) OVER day, 6) AS mean_bz_gsm,
    COUNT(*) OVER day AS known_hours, COUNT(*) FILTER (WHERE disturbance_level <> 'quiet') OVER day AS disturbed_hours FROM hourly WINDOW day AS (ORDER BY hour_utc RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW)"""


@query("weather_last_day", _LAST_DAY)
def _q(spark, d):
    return rounded(gold.weather_last_day(_hourly(Tables(spark, d))))


_CUBE = f"""WITH {INDEX}, b AS (SELECT *, {BAND.format("mean_altitude_km")} AS altitude_band, orbit_reliability_index AS x FROM idx)
SELECT source_group, altitude_band, reliability_class, CAST(GROUPING_ID(source_group, altitude_band, reliability_class) AS INTEGER) AS level, COUNT(*) AS object_count, COUNT(*) FILTER (WHERE element_age_hours > 24) AS stale_count,
    ROUND(MIN(x), 1) AS minimum_index, ROUND(MAX(x), 1) AS maximum_index, CAST(SUM(CAST(ROUND(x * 10) AS BIGINT)) AS BIGINT) AS index_tenths
FROM b GROUP BY GROUPING SETS ((source_group, altitude_band, reliability_class), (source_group, altitude_band), (source_group), (altitude_band), (reliability_class), ())"""


@query("population_cube", _CUBE)
def _q(spark, d):
    return gold.population_cube(_index(Tables(spark, d)))


_LEVELS = f"""WITH {INDEX}, b AS (SELECT *, {BAND.format("mean_altitude_km")} AS altitude_band, orbit_reliability_index AS x FROM idx)"""
_LEVEL = "SELECT '{0}' AS part, {0} AS value, COUNT(*) AS object_count, COUNT(*) FILTER (WHERE element_age_hours > 24) AS stale_count, ROUND(MIN(x), 1) AS minimum_index, ROUND(MAX(x), 1) AS maximum_index, ROUND(CAST(SUM(CAST(ROUND(x * 10) AS BIGINT)) AS DOUBLE) / 10 / COUNT(*), 1) AS average_index FROM b GROUP BY {0}"


@query("population_levels", f"{_LEVELS} {_LEVEL.format('source_group')} UNION ALL {_LEVEL.format('reliability_class')}")
def _q(spark, d):
    """The summaries by group and by class, both from the cube."""
    cube = gold.population_cube(_index(Tables(spark, d)))
    levels = [gold.cube_level(cube, c).withColumnRenamed(c, "value").select(F.lit(c).alias("part"), "*") for c in ("source_group", "reliability_class")]
    return levels[0].unionByName(levels[1])


@query("space_weather_minute", sql_rounded(MINUTE, "minutes", MINUTE_D, MINUTE_O))
def _q(spark, d):
    return rounded(_minute(Tables(spark, d)))


#: After all that is played: closes the minutes and passes before it.
_FAR = "2200-01-01 00:00:00"


def _span(*times: DataFrame) -> str:
    """How late a row can come when tables are dealt into files in no order."""
    first, last = zip(*[t.toDF("t").agg(F.min(F.col("t").cast("timestamp").cast("long")), F.max(F.col("t").cast("timestamp").cast("long"))).first() for t in times], strict=True)
    known = [x for x in (*first, *last) if x is not None]
    return f"{max(known, default=0) - min(known, default=0) + 60} seconds"


@query("streamed_weather_minute", sql_rounded(MINUTE, "minutes", MINUTE_D, MINUTE_O))
def _q(spark, d):
    """Both feeds as streams of files that arrive in no order."""
    t = Tables(spark, d)
    feeds = {"magnetic": t.magnetic(), "plasma": t.plasma()}
    late = _span(*[f.select("observed_at_utc") for f in feeds.values()])

    def made(out: str) -> DataFrame:
        return weather.joined_minutes(*[replay.arrive(f, f"{out}/{n}", 2, f.limit(1).withColumn("observed_at_utc", F.lit(_FAR).cast("timestamp_ntz"))) for n, f in feeds.items()], late)

    return rounded(replay.played(spark, "streamed-minutes", made))


_OPEN = f"""WITH obs AS ({OBSERVATIONS}), newest AS (SELECT observation_id, MAX(snapshot_at_utc) AS snapshot_at_utc FROM obs GROUP BY 1)
SELECT observation_id, date_trunc('millisecond', start_utc)::TIMESTAMP AS end_utc, status FROM obs JOIN newest USING (observation_id, snapshot_at_utc) WHERE status NOT IN ('good', 'bad', 'failed')"""


@query("streamed_open_observations", _OPEN)
def _q(spark, d):
    """Observations as a stream, each with a timer at its end."""
    rows = Tables(spark, d).observations()
    closing = rows.limit(1).withColumns({"snapshot_at_utc": F.lit(_FAR).cast("timestamp"), "observation_id": F.lit(-1).cast("long"), "end_utc": F.lit(None).cast("timestamp_ntz")})
    late = _span(rows.select("snapshot_at_utc"))
    found = replay.played(spark, "streamed-open", lambda out: pending.still_open(replay.arrive(rows, f"{out}/observations", 3, closing), late))
    return found.withColumn("end_utc", X.naive("end_utc"))


@query("space_weather_hourly", sql_rounded(HOURLY, "hourly", "average_bz_gsm minimum_bz_gsm average_proton_speed average_proton_density", "hour_utc minute_count minutes_with_bz disturbance_level"))
def _q(spark, d):
    return rounded(_hourly(Tables(spark, d)))


@query("space_weather_levels", f"WITH {HOURLY} SELECT disturbance_level, COUNT(*) AS hours, ROUND(MIN(minimum_bz_gsm), 6) AS minimum_bz_gsm, ROUND(MAX(average_proton_speed), 6) AS maximum_proton_speed, MAX(hour_utc) AS last_hour_utc FROM hourly GROUP BY 1")
def _q(spark, d):
    return rounded(serve.space_weather(_hourly(Tables(spark, d))))


@query("orbit_reliability_index", f"WITH {INDEX} SELECT * FROM idx")
def index_score(spark, d):
    return _index(Tables(spark, d))


_I = "orbit_reliability_index"
#: From ranks: the middle ones give the median, the first and the last one the range.
_CLASSES_SQL = f"""SELECT reliability_class, MAX(last) + 1 AS object_count, ROUND({sql_quantile(_I, 0.5)}, 1) AS median_index, ROUND(MAX(CASE WHEN i = 0 THEN {_I} END), 1) AS minimum_index, ROUND(MAX(CASE WHEN i = last THEN {_I} END), 1) AS maximum_index
FROM {sql_ranked("idx", "reliability_class", _I)} GROUP BY reliability_class"""
_GROUPS_SQL = f"""SELECT source_group, MAX(last) + 1 AS object_count, ROUND(SUM({_I}) / (MAX(last) + 1), 1) AS average_index, ROUND({sql_quantile(_I, 0.5)}, 1) AS median_index, {sql_count("reliability_class = 'low'")} AS low_count, {sql_count("reliability_class = 'reduced'")} AS reduced_count
FROM {sql_ranked("idx", "source_group", _I)} GROUP BY source_group"""


@query("reliability_class_summary", f"WITH {INDEX} {_CLASSES_SQL}")
def _q(spark, d):
    return gold.reliability_class_summary(_index(Tables(spark, d)))


@query("reliability_group_summary", f"WITH {INDEX} {_GROUPS_SQL}")
def _q(spark, d):
    return gold.reliability_group_summary(_index(Tables(spark, d)))


_SCORED = f"""SELECT event_id, 100.0::DOUBLE * GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 1.0::DOUBLE - (date_diff('minute', date_trunc('day', ts), ts) / 60.0::DOUBLE) / 48.0::DOUBLE)) AS fr, 100.0::DOUBLE * GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, ({ALT.format("(11.0::DOUBLE + value / 100.0::DOUBLE)")} - 300.0::DOUBLE) / 500.0::DOUBLE)) AS dr FROM events"""
_FACTOR = "SELECT CASE WHEN COUNT(*) FILTER (WHERE event_type = 'error') > 0 THEN 0.8::DOUBLE WHEN COUNT(*) FILTER (WHERE event_type = 'view') > 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS f FROM events WHERE date_trunc('hour', ts) >= (SELECT MAX(date_trunc('hour', ts)) FROM events) - INTERVAL 3 HOUR"


@query("index_score", f"WITH ctx AS ({_FACTOR}), s AS ({_SCORED}), b AS (SELECT event_id, 0.55::DOUBLE * fr + 0.45::DOUBLE * dr AS base FROM s) SELECT event_id, ROUND(base, 6) AS base_score, ROUND(base * f, 6) AS index_value, f AS environment_factor, {CLASS.format('base * f')} AS reliability_class FROM b, ctx")
def event_index(spark, d):
    """Every event scored, times a factor from the last hours: the flagship."""
    e = Tables(spark, d).events
    hour = X.trunc("hour", "ts")
    last = e.agg(F.max(hour).alias("last"))  # one row
    kind = F.col("event_type")
    factor = F.when(X.count_if(kind == "error") > 0, F.lit(0.8)).when(X.count_if(kind == "view") > 0, F.lit(0.9)).otherwise(F.lit(1.0))
    ctx = e.select("event_type", hour.alias("h")).join(F.broadcast(last), F.col("h") >= F.col("last") - F.expr("INTERVAL 3 HOURS")).agg(factor.alias("environment_factor"))
    s = e.select("event_id", X.freshness_score(X.hours_by_minutes(X.trunc("day", "ts"), "ts")).alias("fr"), X.drag_safety_score(X.altitude(F.lit(11.0) + F.col("value") / F.lit(100.0))).alias("dr")).select("event_id", X.base_score("fr", "dr").alias("base"))
    return s.crossJoin(F.broadcast(ctx)).select("event_id", X.round_half_up("base", 6).alias("base_score"), X.round_half_up(F.col("base") * F.col("environment_factor"), 6).alias("index_value"), "environment_factor", X.reliability_class(F.col("base") * F.col("environment_factor")).alias("reliability_class"))


@query("element_freshness", sql_rounded(CURRENT, "fresh", "element_age_hours mean_altitude_km", "object_name norad_catalog_id source_group element_epoch_utc is_stale_over_24_hours altitude_band"))
def _q(spark, d):
    return rounded(gold.element_freshness(Tables(spark, d).daily()))


def sql_fresh(key: str, largest: bool, source: str = "fresh") -> str:
    """Ages by `key`, all from the rank of each age within its group."""
    stale = sql_count("is_stale_over_24_hours")
    top = ", ROUND(MAX(CASE WHEN i = last THEN element_age_hours END), 2) AS maximum_age_hours" * largest
    return f"""SELECT {key}, MAX(last) + 1 AS object_count, ROUND({sql_quantile("element_age_hours", 0.5)}, 2) AS median_age_hours, ROUND({sql_quantile("element_age_hours", 0.9)}, 2) AS p90_age_hours{top},
    {stale} AS stale_count, ROUND({stale} * 100.0::DOUBLE / (MAX(last) + 1), 1) AS stale_percent
FROM {sql_ranked(source, key, "element_age_hours")} GROUP BY {key}"""


@query("freshness_by_group", f"WITH {CURRENT} " + sql_fresh("source_group", True))
def _q(spark, d):
    return gold.freshness_by_group(gold.element_freshness(Tables(spark, d).daily()))


@query("freshness_by_band", f"WITH {CURRENT} " + sql_fresh("altitude_band", False))
def _q(spark, d):
    return gold.freshness_by_band(gold.element_freshness(Tables(spark, d).daily()))


# the latest day of each type holds more rows than one snapshot does
_DAILY = "l AS (SELECT event_type AS g, MAX(date_trunc('day', ts)) AS d FROM events GROUP BY 1), fresh AS (SELECT e.event_type AS event_type, date_diff('minute', date_trunc('week', e.ts), e.ts) / 60.0::DOUBLE AS element_age_hours, date_diff('minute', date_trunc('week', e.ts), e.ts) / 60.0::DOUBLE > 24 AS is_stale_over_24_hours FROM events e JOIN l ON e.event_type = l.g AND date_trunc('day', e.ts) = l.d)"


@query("freshness_by_type_latest_day", f"WITH {_DAILY} " + sql_fresh("event_type", True))
def _q(spark, d):
    e = Tables(spark, d).events.withColumn("day", X.trunc("day", "ts"))
    latest = e.groupBy("event_type").agg(F.max("day").alias("day"))
    age = X.hours_by_minutes(X.trunc("week", "ts"), "ts")
    rows = e.join(latest, ["event_type", "day"]).withColumn("element_age_hours", age).withColumn("is_stale_over_24_hours", F.col("element_age_hours") > X.STALE_HOURS)
    return gold.freshness_by(rows, "event_type", True)


_CH_D = "previous_mean_motion mean_motion_revolutions_per_day mean_motion_delta previous_eccentricity eccentricity eccentricity_delta inclination_degrees previous_semi_major_axis_km current_semi_major_axis_km semi_major_axis_change_km"


@query("orbit_change", sql_rounded(CHANGE, "change", _CH_D, "object_name norad_catalog_id previous_snapshot_at_utc snapshot_at_utc interval_minutes previous_element_epoch_utc element_epoch_utc same_element_set") .replace(" FROM change", ", ROUND(decay_rate_km_per_day, 3) AS decay_rate_km_per_day FROM change"))
def _q(spark, d):
    df = gold.orbit_change(Tables(spark, d).orbital())
    return rounded(df.withColumn("decay_rate_km_per_day", X.round_half_up("decay_rate_km_per_day", 3)))


@query("change_refresh", f"WITH {CHANGE} SELECT COUNT(*) AS compared, COUNT(*) FILTER (WHERE same_element_set) AS same_set, COUNT(*) FILTER (WHERE NOT same_element_set) AS refreshed, ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE NOT same_element_set) / COUNT(*), 1) AS refreshed_percent FROM change")
def _q(spark, d):
    return serve.change_refresh(gold.orbit_change(Tables(spark, d).orbital()))


@query("element_pairs", f"WITH {CHANGE}, {PAIRS} SELECT norad_catalog_id, ps AS earlier_snapshot_at_utc, snapshot_at_utc AS later_snapshot_at_utc, pe AS earlier_element_epoch_utc, element_epoch_utc AS later_element_epoch_utc, CASE WHEN element_epoch_utc > pe THEN 'forward' ELSE 'retrograde' END AS kind FROM pairs")
def _q(spark, d):
    p = measure.classify_pairs(measure.element_pairs(Tables(spark, d).orbital()))
    return p.select("norad_catalog_id", X.naive("earlier_snapshot_at_utc").alias("earlier_snapshot_at_utc"), X.naive("snapshot_at_utc").alias("later_snapshot_at_utc"), F.col("earlier.epoch").alias("earlier_element_epoch_utc"), F.col("later.epoch").alias("later_element_epoch_utc"), "kind")


@query("orbit_snapshot_summary", f"WITH o AS ({ORBITAL}) SELECT date_trunc('day', snapshot_at_utc)::TIMESTAMP AS snapshot_at_utc, COUNT(*) AS object_count, COUNT(DISTINCT norad_catalog_id) AS unique_object_count, ROUND(AVG(mean_motion_revolutions_per_day), 5) AS average_mean_motion, ROUND(AVG(bstar_drag_term), 8) AS average_bstar FROM o GROUP BY 1")
def _q(spark, d):
    daily = Tables(spark, d).orbital().withColumn("snapshot_at_utc", F.date_trunc("day", "snapshot_at_utc"))
    return gold.orbit_snapshot_summary(daily)


@query("space_weather_snapshot_summary", f"WITH m AS ({MAGNETIC}), p AS ({PLASMA}), a AS (SELECT snapshot_at_utc, COUNT(*) AS magnetic_row_count, ROUND(AVG(bz_gsm), 3) AS average_bz_gsm, ROUND(MIN(bz_gsm), 3) AS minimum_bz_gsm FROM m GROUP BY 1), b AS (SELECT snapshot_at_utc, COUNT(*) AS plasma_row_count, ROUND(AVG(proton_speed), 2) AS average_proton_speed FROM p GROUP BY 1) SELECT * FROM a LEFT JOIN b USING (snapshot_at_utc)")
def _q(spark, d):
    t = Tables(spark, d)
    return gold.space_weather_snapshot_summary(t.magnetic(), t.plasma())


_KP = ", ".join(f"ROUND(CAST(o_orderkey * {i} % 91 AS DOUBLE) / 10.0::DOUBLE, 2) AS kp{i}" for i in range(1, 9))
DAILY = f"d AS (SELECT CAST(o_orderdate AS DATE) AS observation_date, {_KP}, ROUND(CAST(o_orderkey % 721 AS DOUBLE) / 10.0::DOUBLE, 2) AS kp_sum, CAST(o_custkey % 100 AS DOUBLE) AS ap_avg, CAST(o_custkey % 200 AS DOUBLE) AS sunspot_number, ROUND(o_totalprice / 1000.0::DOUBLE, 0) AS f10_7_observed, o_orderstatus AS f10_7_data_type, o_orderdate + to_seconds(o_orderkey) AS last_retrieved_at_utc, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate + to_seconds(o_orderkey) DESC) AS rk FROM orders), daily AS (SELECT * EXCLUDE (rk) FROM d WHERE rk = 1)"


@query("sw_index_daily", f"WITH {DAILY} SELECT * FROM daily")
def _q(spark, d):
    return gold.sw_index_daily(Tables(spark, d).indices())


@query("sw_index_summary", f"WITH {DAILY} SELECT COUNT(*) AS days, MIN(observation_date) AS first_day, MAX(observation_date) AS last_day, ROUND(MIN(kp_sum), 2) AS minimum_kp_sum, ROUND(MAX(kp_sum), 2) AS maximum_kp_sum, ROUND(MAX(ap_avg), 1) AS maximum_ap, ROUND(MAX(f10_7_observed), 1) AS maximum_f10_7 FROM daily")
def _q(spark, d):
    return serve.index_summary(gold.sw_index_daily(Tables(spark, d).indices()))


#: An observation's newest version is the one that no later one follows; of versions of one time the first by status counts.
ACTIVITY = f"""obs AS ({OBSERVATIONS}), newest AS (SELECT observation_id, MAX(snapshot_at_utc) AS snapshot_at_utc FROM obs GROUP BY observation_id),
v AS (SELECT observation_id, MIN(status) AS status FROM obs JOIN newest USING (observation_id, snapshot_at_utc) GROUP BY observation_id),
marked AS (SELECT DISTINCT obs.observation_id, CAST(obs.start_utc AS DATE) AS observation_date, obs.norad_catalog_id AS satellite, obs.station_id AS station, CAST(v.status = 'good' AS BIGINT) AS good, CAST(v.status IN ('good', 'bad', 'failed') AS BIGINT) AS completed, CAST(v.status = 'future' AS BIGINT) AS scheduled
    FROM obs JOIN newest USING (observation_id, snapshot_at_utc) JOIN v ON v.observation_id = obs.observation_id AND v.status = obs.status),
act AS (SELECT observation_date, COUNT(*) AS observation_count, COUNT(DISTINCT satellite) AS distinct_satellites, COUNT(DISTINCT station) AS distinct_stations, CAST(SUM(good) AS BIGINT) AS good_count, CAST(SUM(completed) AS BIGINT) AS completed_count, CAST(SUM(scheduled) AS BIGINT) AS scheduled_count,
    CASE WHEN SUM(completed) > 0 THEN ROUND(SUM(good) * 100.0::DOUBLE / SUM(completed), 1) END AS good_percent_of_completed FROM marked GROUP BY observation_date)"""


@query("satnogs_activity", f"WITH {ACTIVITY} SELECT * FROM act")
def _q(spark, d):
    return gold.satnogs_activity(Tables(spark, d).observations())


@query("activity_summary", f"WITH {ACTIVITY}, s AS (SELECT COUNT(*) AS days, CAST(SUM(observation_count) AS BIGINT) AS observations, CAST(SUM(good_count) AS BIGINT) AS good, CAST(SUM(completed_count) AS BIGINT) AS completed, CAST(SUM(scheduled_count) AS BIGINT) AS scheduled, CAST(SUM(distinct_satellites) AS BIGINT) AS satellite_days, CAST(SUM(distinct_stations) AS BIGINT) AS station_days FROM act), u AS (SELECT COUNT(DISTINCT norad_catalog_id) AS distinct_satellites, COUNT(DISTINCT station_id) AS distinct_stations FROM obs) SELECT *, ROUND(100.0::DOUBLE * good / NULLIF(completed, 0), 1) AS good_percent_of_completed FROM s, u")
def _q(spark, d):
    t = Tables(spark, d)
    return serve.activity_summary(gold.satnogs_activity(t.observations()), t.observations())


# the text columns that a file would have: six places of the motion, three of the eccentricity
FEATURES = f"""o AS ({ORBITAL}), s AS (SELECT CASE source_group WHEN 'error' THEN 'iridium-33-debris' ELSE source_group END AS source_group, object_name, norad_catalog_id, element_epoch_utc, inclination_degrees, eccentricity, CAST(printf('%.6f', mean_motion_revolutions_per_day) AS DOUBLE) AS mean_motion_revolutions_per_day, CAST(NULL AS DOUBLE) AS bstar_drag_term, CAST(date_trunc('second', snapshot_at_utc) AS TIMESTAMP) AS retrieved_at_utc FROM o),
a AS (SELECT *, {AXIS.format("mean_motion_revolutions_per_day")} AS semi_major_axis_km FROM s),
f AS (SELECT object_name, norad_catalog_id, source_group, element_epoch_utc, retrieved_at_utc, date_diff('hour', element_epoch_utc, retrieved_at_utc) AS element_age_hours, date_diff('hour', element_epoch_utc, retrieved_at_utc) > 24 AS is_stale_over_24_hours, inclination_degrees, eccentricity, mean_motion_revolutions_per_day, bstar_drag_term, 1440.0::DOUBLE / mean_motion_revolutions_per_day AS orbital_period_minutes, semi_major_axis_km, semi_major_axis_km - 6378.137::DOUBLE AS mean_altitude_km, semi_major_axis_km * (1 - eccentricity) - 6378.137::DOUBLE AS perigee_km, semi_major_axis_km * (1 + eccentricity) - 6378.137::DOUBLE AS apogee_km, {BAND.format("(semi_major_axis_km - 6378.137::DOUBLE)")} AS altitude_band FROM a)"""
_F_D = "inclination_degrees eccentricity mean_motion_revolutions_per_day bstar_drag_term orbital_period_minutes semi_major_axis_km mean_altitude_km perigee_km apogee_km"


def _features(t: Tables) -> DataFrame:
    return gold.orbit_features(t.silver())


@query("orbit_features", sql_rounded(FEATURES, "f", _F_D, "object_name norad_catalog_id source_group element_epoch_utc retrieved_at_utc element_age_hours is_stale_over_24_hours altitude_band"))
def _q(spark, d):
    return rounded(_features(Tables(spark, d)).drop("source_url"))


_BANDS = f"""WITH {FEATURES} SELECT altitude_band, COUNT(*) AS object_count, ROUND(AVG(mean_altitude_km), 2) AS average_altitude_km, ROUND(MIN(perigee_km), 2) AS minimum_perigee_km, ROUND(MAX(apogee_km), 2) AS maximum_apogee_km,
    COUNT(*) FILTER (WHERE element_age_hours > 24) AS stale_object_count FROM f GROUP BY altitude_band"""


@query("orbit_band_summary", _BANDS)
def _q(spark, d):
    return gold.orbit_band_summary(_features(Tables(spark, d)))


@query("debris_population", f"WITH {FEATURES} SELECT object_name, norad_catalog_id, ROUND(mean_altitude_km, 1) AS mean_altitude_km, ROUND(eccentricity, 6) AS eccentricity, bstar_drag_term, element_age_hours, element_epoch_utc, retrieved_at_utc AS snapshot_at_utc FROM f WHERE source_group = 'iridium-33-debris'")
def _q(spark, d):
    return gold.debris_population(_features(Tables(spark, d)))


@query("debris_summary", f"WITH {FEATURES}, g AS (SELECT ROUND(mean_altitude_km, 1) AS a, element_age_hours AS h, bstar_drag_term AS b FROM f WHERE source_group = 'iridium-33-debris') SELECT COUNT(*) AS objects, ROUND(MEDIAN(a), 1) AS median_altitude_km, ROUND(MEDIAN(h), 1) AS median_age_hours, ROUND(MEDIAN(b), 8) AS median_bstar FROM g")
def _q(spark, d):
    return serve.debris_summary(gold.debris_population(_features(Tables(spark, d))))


@query("lakehouse_groups", f"WITH {FEATURES} SELECT source_group, COUNT(*) AS rows, COUNT(DISTINCT norad_catalog_id) AS objects, ROUND(MEDIAN(mean_altitude_km), 1) AS median_altitude_km FROM f GROUP BY 1")
def _q(spark, d):
    return serve.lakehouse(Tables(spark, d).silver())


@query("newest_version_activity", "WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1) SELECT CAST(ts AS DATE) AS activity_date, COUNT(*) AS n, COUNT(DISTINCT event_type) AS kinds, COUNT(*) FILTER (WHERE event_type = 'view') AS good, COUNT(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS completed, ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE event_type = 'view') / NULLIF(COUNT(*) FILTER (WHERE event_type IN ('view', 'click', 'error')), 0), 1) AS good_percent FROM v GROUP BY 1")
def _q(spark, d):
    e = Tables(spark, d).events.withColumn("activity_date", F.col("ts").cast("date"))
    v = gold.newest(e, ["user_id", "activity_date"], F.desc("ts"), F.desc("event_id"))
    kind = F.col("event_type")
    good, done = X.count_if(kind == "view"), X.count_if(kind.isin("view", "click", "error"))
    return v.groupBy("activity_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), good.alias("good"), done.alias("completed"), X.percent(good, done).alias("good_percent"))


@query("snapshot_summary", "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS orders_n, COUNT(DISTINCT o_custkey) AS customers, ROUND(CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100, 4) AS average_price FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS lines_n, MIN(l_discount) AS minimum_discount FROM lineitem GROUP BY 1) SELECT * FROM o LEFT JOIN l USING (day)")
def _q(spark, d):
    t = Tables(spark, d)
    o = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders_n"), F.countDistinct("o_custkey").alias("customers"), X.round_half_up(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100, 4).alias("average_price"))
    li = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("lines_n"), F.min("l_discount").alias("minimum_discount"))
    return o.join(li, "day", "left")


@query("latest_correlated", "SELECT event_type AS source_group, COUNT(*) AS object_count, COUNT(DISTINCT user_id) AS unique_objects FROM events h WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events i WHERE i.event_type = h.event_type) GROUP BY 1")
def _q(spark, d):
    e = Tables(spark, d).events
    return serve.latest_by_group(e.select(F.col("event_type").alias("source_group"), F.col("user_id").alias("norad_catalog_id"), F.col("ts").cast("date").alias("snapshot_at_utc")))


@query("orphan_rows", "SELECT (SELECT COUNT(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))::DOUBLE AS documents_without_labels, (SELECT COUNT(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))::DOUBLE AS customers_without_orders")
def _q(spark, d):
    t = Tables(spark, d)
    a = quality.orphans(t.documents.select("doc_id"), "doc_id", t.labels, "doc_id").toDF("documents_without_labels")
    b = quality.orphans(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey").toDF("customers_without_orders")
    return a.crossJoin(F.broadcast(b))  # one row each


@query("duplicate_keys", "SELECT COUNT(*)::DOUBLE AS duplicated FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)")
def _q(spark, d):
    return quality.duplicate_keys(Tables(spark, d).lineitem, "l_orderkey", "l_linenumber").toDF("duplicated")


@query("distinct_violation", "SELECT COUNT(*)::DOUBLE AS orders_with_several_flags FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_returnflag) > 1)")
def _q(spark, d):
    rows = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("source_file"), F.col("l_returnflag").alias("source_sha256"))
    return quality.changed_paths(rows).toDF("orders_with_several_flags")


_CHECKS = [
    ("events_have_rows", "error", "SELECT COUNT(*) FROM events", "greater_than", 0), ("duplicate_event_ids", "error", "SELECT COUNT(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING COUNT(*) > 1)", "less_than_or_equal", 0),
    ("duplicate_line_keys", "error", "SELECT COUNT(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)", "less_than_or_equal", 0), ("invalid_discount_rows", "error", "SELECT COUNT(*) FROM lineitem WHERE l_discount IS NULL OR l_discount < 0 OR l_discount > 1", "less_than_or_equal", 0),
    ("unlabelled_percent", "warning", "SELECT COALESCE(100.0::DOUBLE * COUNT(*) FILTER (WHERE quality IS NULL) / NULLIF(COUNT(*), 0), 100.0) FROM documents LEFT JOIN labels USING (doc_id)", "less_than_or_equal", 10), ("purchase_rows", "warning", "SELECT COUNT(*) FROM events WHERE event_type = 'purchase'", "greater_than", 0),
]
_SIGN = {"greater_than": ">", "less_than_or_equal": "<="}


def _gate(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    measures = [
        quality.count(t.events), quality.duplicate_keys(t.events, "event_id"), quality.duplicate_keys(t.lineitem, "l_orderkey", "l_linenumber"), quality.count(t.lineitem.where("l_discount IS NULL OR l_discount < 0 OR l_discount > 1")),
        quality.null_percent(joined, "quality"), quality.count(t.events.where("event_type = 'purchase'")),
    ]
    return quality.run_checks([quality.Check(n, s, m, o, th) for (n, s, _, o, th), m in zip(_CHECKS, measures, strict=True)])


_GATE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, CASE WHEN v {_SIGN[o]} {t} THEN 'pass' ELSE '{'fail' if s == 'error' else 'warn'}' END AS status, '{s}' AS severity, ROUND(v, 6) AS observed_value, '{o}' AS operator, {t}::DOUBLE AS threshold, '' AS description FROM (SELECT CAST(({q}) AS DOUBLE) AS v)"
    for n, s, q, o, t in _CHECKS
)


@query("gate_overall", f"""WITH g AS ({_GATE_SQL}), l AS (SELECT MAX(ts) AS newest FROM events)
SELECT ANY_VALUE(newest) AS checked_at_utc, CASE WHEN COUNT(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail' WHEN COUNT(*) FILTER (WHERE status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS status,
    COUNT(*) AS checks_total, COUNT(*) FILTER (WHERE status = 'fail') AS failures, COUNT(*) FILTER (WHERE status = 'warn') AS warnings FROM g, l""")
def _q(spark, d):
    """The answer of the quality route; the checks are as old as the newest event."""
    t = Tables(spark, d)
    at = t.events.agg(F.max("ts").alias("checked_at_utc"))
    return quality.overall(_gate(t).crossJoin(F.broadcast(at)))  # one row


@query("gate_report", _GATE_SQL)
def _q(spark, d):
    return _gate(Tables(spark, d))


_SKETCHES = "SELECT event_type AS source_group, {0!r} AS column, COUNT({0}) AS rows, COUNT(DISTINCT {0}) AS exact, true AS within_tolerance FROM events GROUP BY 1"


@query("distinct_sketches", " UNION ALL ".join(_SKETCHES.format(c).replace("COUNT(" + c + ") AS rows", "COUNT(*) AS rows") for c in ("user_id", "event_id")))
def _q(spark, d):
    """A sketch for each day, merged by group, beside the exact counts."""
    e = Tables(spark, d).events.select(F.col("event_type").alias("source_group"), "user_id", "event_id", F.to_date("ts").alias("day"))
    path = new_folder(spark, "sketches")
    sketches.sketched(e, ("user_id", "event_id"), ["source_group", "day"]).write.partitionBy("day").parquet(path)
    kept = sketches.merged(spark.read.parquet(path), ["source_group"]).withColumn("estimate", sketches.estimate())
    exact = e.select("source_group", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("user_id", "event_id")]))).groupBy("source_group", "column").agg(F.countDistinct("v").alias("exact"))
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * F.lit(sketches.tolerance()))
    return exact.join(kept, ["source_group", "column"]).select("source_group", "column", "rows", "exact", close.alias("within_tolerance"))


@query("top25_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY ABS(c_acctbal) DESC NULLS LAST, c_custkey LIMIT 25")
def _q(spark, d):
    return serve.top(Tables(spark, d).customer.select("c_custkey", "c_acctbal"), F.abs("c_acctbal"), "c_custkey", 25)


@query("top5_changes", f"WITH {CHANGE} SELECT norad_catalog_id, snapshot_at_utc, ROUND(decay_rate_km_per_day, 3) AS decay_rate_km_per_day FROM change WHERE decay_rate_km_per_day IS NOT NULL ORDER BY ABS(decay_rate_km_per_day) DESC, norad_catalog_id LIMIT 5")
def _q(spark, d):
    rows = gold.orbit_change(Tables(spark, d).orbital()).where("decay_rate_km_per_day IS NOT NULL").select("norad_catalog_id", "snapshot_at_utc", "decay_rate_km_per_day")
    return rounded(serve.top(rows, F.abs("decay_rate_km_per_day"), "norad_catalog_id", 5), 3)


@query("bottom10", "SELECT event_id, value FROM events ORDER BY value ASC NULLS LAST, event_id LIMIT 10")
def _q(spark, d):
    return serve.bottom(Tables(spark, d).events.select("event_id", "value"), "value", "event_id")


@query("latest_row", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 1")
def _q(spark, d):
    return serve.top(Tables(spark, d).events.select("event_id", "ts", "value"), "ts", "event_id", 1)


@query("point_lookup", f"WITH {INDEX} SELECT * FROM idx WHERE norad_catalog_id = 7")
def _q(spark, d):
    return serve.reliability_of(_index(Tables(spark, d)), 7)


@query("regexp_group", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, COUNT(*) AS pages, COUNT(DISTINCT url) AS urls FROM pages GROUP BY 1")
def _q(spark, d):
    return Tables(spark, d).pages.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


@query("try_cast_props", "SELECT event_type, COUNT(k) AS parsed, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS total FROM (SELECT event_type, TRY_CAST(NULLIF(regexp_extract(props, '\"k\": *([0-9]+)', 1), '') AS BIGINT) AS k FROM events) GROUP BY 1")
def _q(spark, d):
    k = X.number(F.regexp_extract("props", r'"k": *([0-9]+)', 1), "long")
    return Tables(spark, d).events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("parsed"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


_RANKS = "x AS (SELECT c_custkey, c_acctbal AS a, SUM(o_totalprice) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("spearman", f"WITH {_RANKS}, r AS (SELECT rank() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY t) + (COUNT(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE AS rt FROM x) SELECT ROUND(corr(ra, rt), 6) AS rho FROM r")
def _q(spark, d):
    t = Tables(spark, d)
    sums = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return rounded(stats.spearman(t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey")), "c_acctbal", "t"))


@query("average_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS size_rank FROM part")
def _q(spark, d):
    return stats.average_ranks(Tables(spark, d).part.select("p_partkey", "p_size"), "p_size", "size_rank").select("p_partkey", "size_rank")


@query("pearson", "SELECT ROUND(corr(l_quantity, l_extendedprice), 6) AS r, 0.0::DOUBLE AS flat FROM lineitem")
def _q(spark, d):
    li = Tables(spark, d).lineitem
    return rounded(li.agg(stats.pearson("l_quantity", "l_extendedprice").alias("r"), stats.pearson("l_quantity", F.lit(1.0)).alias("flat")))


@query("nearest_p90", "SELECT event_type, list_sort(list(value))[LEAST(COUNT(*) - 1, CAST(floor(0.9 * COUNT(*)) AS BIGINT)) + 1] AS p90 FROM events GROUP BY 1")
def _q(spark, d):
    return stats.nearest_p90_by(Tables(spark, d).events, ["event_type"], "value", "p90")


_SPAN = "date_diff('hour', pe, element_epoch_utc)::DOUBLE"
_LABELLED = f"lab AS (SELECT *, {_SPAN} AS span, ABS(mean_motion_revolutions_per_day - pm) * 130 AS total FROM c WHERE element_epoch_utc > pe), ql AS (SELECT *, CASE WHEN total > 500 THEN 'extreme' WHEN span > 72 THEN 'long_span' ELSE 'ok' END AS q FROM lab)"


def _proxy(t: Tables) -> DataFrame:
    """Disagreement without a propagator: the change of motion stands for the error, so that SQL can follow."""
    p = measure.classify_pairs(measure.element_pairs(t.orbital())).where("kind = 'forward'")
    total = F.abs(F.col("later.mean_motion") - F.col("earlier.mean_motion")) * 130
    span = X.boundaries("hour", "earlier.epoch", "later.epoch").cast("double")
    made = p.withColumn("total_km", total).withColumn("propagation_span_hours", span)
    return made.select("object_name", "norad_catalog_id", "source_group", F.col("earlier.epoch").alias("earlier_element_epoch_utc"), F.col("later.epoch").alias("later_element_epoch_utc"), "propagation_span_hours", (F.col("total_km") / 3).alias("radial_km"), (F.col("total_km") * F.when(F.col("norad_catalog_id") % 3 == 0, 0.2).otherwise(0.8)).alias("along_track_km"), (F.col("total_km") / 4).alias("cross_track_km"), "total_km", X.naive("earlier_snapshot_at_utc").alias("earlier_snapshot_at_utc"), X.naive("snapshot_at_utc").alias("later_snapshot_at_utc"), measure.quality_label("propagation_span_hours", "total_km").alias("measurement_quality"))


@query("quality_label_counts", f"WITH {CHANGE}, {_LABELLED} SELECT q AS measurement_quality, COUNT(*) AS pairs FROM ql GROUP BY 1")
def _q(spark, d):
    return _proxy(Tables(spark, d)).groupBy("measurement_quality").agg(F.count(F.lit(1)).alias("pairs"))


@query("disagreement_summary", f"WITH {CHANGE}, {_LABELLED} SELECT COUNT(*) FILTER (WHERE q = 'ok') AS pairs, ROUND(MEDIAN(total) FILTER (WHERE q = 'ok'), 3) AS median_total_km, ROUND(MAX(total) FILTER (WHERE q = 'ok'), 3) AS maximum_total_km, ROUND(MEDIAN(span) FILTER (WHERE q = 'ok'), 2) AS median_span_hours, COUNT(*) FILTER (WHERE q = 'long_span') AS excluded_long_span, COUNT(*) FILTER (WHERE q = 'extreme') AS excluded_extreme FROM ql")
def _q(spark, d):
    return serve.disagreement(_proxy(Tables(spark, d)))


BACKTEST = CHANGE + ", " + _LABELLED + f""", h AS (SELECT ql.*, date_diff('minute', ql.pe, ql.ps) / 60.0::DOUBLE AS age, {ALT.format("ql.pm")} AS alt FROM ql WHERE q = 'ok'),
sc AS (SELECT *, 100.0::DOUBLE * GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 1.0::DOUBLE - age / 48.0::DOUBLE)) AS fr, 100.0::DOUBLE * GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, (alt - 300.0::DOUBLE) / 500.0::DOUBLE)) AS dr FROM h),
bk AS (SELECT norad_catalog_id, ROUND(0.55::DOUBLE * fr + 0.45::DOUBLE * dr, 1) AS base_score, {CLASS.format("0.55::DOUBLE * fr + 0.45::DOUBLE * dr")} AS reliability_class, ROUND(age, 2) AS age_h, ROUND(alt, 2) AS alt_km, ROUND(total, 4) AS total_km, CASE WHEN span > 0 THEN ROUND(total / span, 4) END AS km_per_hour, total * (CASE WHEN norad_catalog_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END) AS along, norad_catalog_id % 3 <> 0 AND total > 0 AS dominant FROM sc)"""


@query("backtest_pairs", f"WITH {BACKTEST} SELECT norad_catalog_id, base_score, reliability_class, age_h AS element_age_hours_at_prediction, alt_km AS mean_altitude_km_at_prediction, total_km, km_per_hour, dominant AS is_along_track_dominant FROM bk")
def _q(spark, d):
    t = Tables(spark, d)
    return measure.validation_pairs(_proxy(t), t.orbital()).select("norad_catalog_id", "base_score", "reliability_class", "element_age_hours_at_prediction", "mean_altitude_km_at_prediction", "total_km", "km_per_hour", "is_along_track_dominant")


@query("backtest_bins", f"WITH {BACKTEST} SELECT reliability_class, COUNT(*)::INTEGER AS pair_count, ROUND(MEDIAN(total_km), 4) AS median_total_km, ROUND(list_sort(list(total_km))[LEAST(COUNT(*) - 1, CAST(floor(0.9 * COUNT(*)) AS BIGINT)) + 1], 4) AS p90_total_km, ROUND(MEDIAN(km_per_hour), 4) AS median_km_per_hour, ROUND(MEDIAN(ABS(along)), 4) AS median_along_track_km FROM bk GROUP BY 1")
def _q(spark, d):
    t = Tables(spark, d)
    return measure.validation_bins(measure.validation_pairs(_proxy(t), t.orbital()))


def _rho(name: str, x: str, y: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS metric, ROUND(corr(rx, ry), 4) AS value FROM (SELECT rank() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY {y}) + (COUNT(*) OVER (PARTITION BY {y}) - 1) / 2.0::DOUBLE AS ry FROM bk WHERE {where} AND {x} IS NOT NULL AND {y} IS NOT NULL)"


@query("backtest_stats", f"WITH {BACKTEST} SELECT 'pairs' AS metric, COUNT(*)::DOUBLE AS value FROM bk UNION ALL SELECT 'excluded_pairs_outside_envelope', COUNT(*)::DOUBLE FROM ql WHERE q <> 'ok' UNION ALL " + " UNION ALL ".join([_rho("spearman_score_vs_total_km", "base_score", "total_km"), _rho("spearman_score_vs_km_per_hour", "base_score", "km_per_hour"), _rho("spearman_age_vs_total_km", "age_h", "total_km"), "SELECT 'drag_like_pairs', COUNT(*)::DOUBLE FROM bk WHERE dominant", _rho("spearman_score_vs_total_km_drag_like", "base_score", "total_km", "dominant"), _rho("spearman_altitude_vs_total_km_drag_like", "alt_km", "total_km", "dominant")]))
def _q(spark, d):
    t = Tables(spark, d)
    proxy = _proxy(t)
    return measure.validation_stats(measure.validation_pairs(proxy, t.orbital()), proxy)


@query("content_dedupe", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(coalesce(text, '')), lang ORDER BY doc_id) AS rk FROM documents) WHERE rk = 1")
def _q(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "lang", X.content_hash("text", "lang").alias("h"))
    return gold.newest(docs, ["h"], F.asc("doc_id")).drop("h")


@query("priority_dedupe", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_type, event_id) AS rk FROM events) WHERE rk = 1")
def _q(spark, d):
    e = Tables(spark, d).events.withColumn("day", X.trunc("day", "ts"))
    return gold.newest(e, ["user_id", "day"], F.when(F.col("event_type") == "view", 0).otherwise(1).asc(), F.asc("event_type"), F.asc("event_id")).select("event_id", "user_id", "event_type")


@query("pending_ids", "WITH v AS (SELECT *, row_number() OVER (PARTITION BY event_id % 3001 ORDER BY ts DESC, event_id DESC) AS rk FROM events) SELECT event_id % 3001 AS observation_id, ts AS end_utc, event_type AS status FROM v WHERE rk = 1 AND event_type NOT IN ('view', 'click', 'error') AND ts < TIMESTAMP '2100-01-01' ORDER BY ts, 1 LIMIT 10")
def _q(spark, d):
    from ..sources.bronze import pending_ids

    kind = F.col("event_type")
    rows = Tables(spark, d).events.select((F.col("event_id") % 3001).alias("id"), F.col("ts").cast("string").alias("end"), F.when(kind == "view", "good").when(kind == "click", "bad").when(kind == "error", "failed").otherwise(kind).alias("status"), F.struct("ts", "event_id").alias("seen"))
    return pending_ids(rows, F.lit("2100-01-01").cast("timestamp"), order="seen").select("observation_id", X.naive("end_utc").alias("end_utc"), "status")


@query("status_counts", "SELECT event_type AS status, COUNT(*) AS events FROM events GROUP BY 1")
def _q(spark, d):
    from ..streaming.events import status_counts

    return status_counts(Tables(spark, d).events.select(F.col("event_type").alias("status")))


@query("group_population", f"WITH {CURRENT}, g AS (" + sql_fresh("source_group", True) + "), s AS (SELECT source_group, COUNT(DISTINCT norad_catalog_id) AS distinct_objects, COUNT(DISTINCT snapshot_at_utc) AS snapshots FROM o GROUP BY 1) SELECT * FROM g LEFT JOIN s USING (source_group)")
def _q(spark, d):
    o = Tables(spark, d).daily()
    return serve.population(gold.freshness_by_group(gold.element_freshness(o)), o)


@query("table_health", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", COUNT(*) AS rows FROM {t}" for t in ("events", "orders", "lineitem", "labels", "pages")) + " UNION ALL SELECT 'absent', 0")
def _q(spark, d):
    t = Tables(spark, d)
    names = ("events", "orders", "lineitem", "labels", "pages", "absent")
    return serve.health(spark, {n: getattr(t, n) for n in names[:-1]}, names)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A derived table as a run leaves it: written once, read by all that need it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _served_to_sql(t: Tables) -> dict[str, DataFrame]:
    """The tables that the SQL of `metrics` covers."""
    hourly = _stored(_hourly(t), "hourly")
    index = _stored(gold.orbit_reliability_index(t.daily(), hourly), "index")
    return {"orbital_snapshot_history": t.orbital(), "noaa_magnetic_history": t.magnetic(), "noaa_plasma_history": t.plasma(), "orbit_reliability_index": index, "reliability_class_summary": gold.reliability_class_summary(index), "freshness_by_group": gold.freshness_by_group(gold.element_freshness(t.daily())), "space_weather_hourly": hourly, "satnogs_observation_history": t.observations(), "satnogs_activity": gold.satnogs_activity(t.observations())}


_G = lambda n, q, label="''": f"SELECT '{n}' AS name, {label} AS label, CAST(v AS DOUBLE) AS value FROM ({q})"


@query("metrics", f"WITH {INDEX}, g AS (" + sql_fresh("source_group", False) + "), " + ACTIVITY + " " + " UNION ALL ".join([
    _G("database_reachable", "SELECT 1 AS v"), _G("objects_tracked", "SELECT COUNT(DISTINCT user_id) AS v FROM events"), _G("orbital_snapshots", "SELECT COUNT(DISTINCT ts) AS v FROM events"), _G("magnetic_history_rows", "SELECT COUNT(*) AS v FROM m"), _G("plasma_history_rows", "SELECT COUNT(*) AS v FROM p"),
    _G("ori_class_objects", "SELECT reliability_class AS k, COUNT(*) AS v FROM idx GROUP BY 1", "k"), _G("environment_factor", "SELECT environment_factor AS v FROM ctx"), _G("group_objects", "SELECT source_group AS k, object_count AS v FROM g", "k"), _G("freshness_median_age_hours", "SELECT source_group AS k, median_age_hours AS v FROM g", "k"), _G("freshness_stale_percent", "SELECT source_group AS k, stale_percent AS v FROM g", "k"),
    _G("spaceweather_min_bz_nt", "SELECT ROUND(MIN(minimum_bz_gsm), 2) AS v FROM hourly"), _G("spaceweather_max_proton_speed", "SELECT ROUND(MAX(average_proton_speed), 2) AS v FROM hourly"), _G("spaceweather_southward_bz_hours", "SELECT COUNT(*) AS v FROM hourly WHERE disturbance_level = 'southward_bz'"), _G("spaceweather_fast_wind_hours", "SELECT COUNT(*) AS v FROM hourly WHERE disturbance_level = 'fast_wind'"),
    _G("satnogs_days", "SELECT COUNT(*) AS v FROM act"), _G("satnogs_observations", "SELECT SUM(observation_count) AS v FROM act"), _G("satnogs_good_observations", "SELECT SUM(good_count) AS v FROM act"), _G("satnogs_completed_observations", "SELECT SUM(completed_count) AS v FROM act"), _G("satnogs_scheduled_observations", "SELECT SUM(scheduled_count) AS v FROM act"), _G("satnogs_good_percent_of_completed", "SELECT ROUND(100.0::DOUBLE * SUM(good_count) / SUM(completed_count), 1) AS v FROM act"),
    _G("satnogs_distinct_satellites", "SELECT COUNT(DISTINCT norad_catalog_id) AS v FROM obs"), _G("satnogs_distinct_stations", "SELECT COUNT(DISTINCT station_id) AS v FROM obs"),
]))
def _q(spark, d):
    return serve.metrics(_served_to_sql(Tables(spark, d))).select("name", F.concat_ws(",", F.map_values("labels")).alias("label"), "value")


def _served(t: Tables) -> dict[str, DataFrame]:
    """All tables that gauges are made of; disagreement without a propagator, so that SQL can follow."""
    measured = _stored(_proxy(t), "measured")
    pairs = _stored(measure.validation_pairs(measured, t.orbital()), "pairs")
    found = measure.validation_stats(pairs, measured)
    return _served_to_sql(t) | {"propagation_disagreement": measured, "validation_stats": found, "sw_index_daily": gold.sw_index_daily(t.indices()), "debris_population": gold.debris_population(_features(t)), "quality": _gate(t)}


def _of(with_: str, *gauges: str) -> str:
    """Gauges over tables of their own."""
    return f"SELECT * FROM (WITH {with_} {' UNION ALL '.join(gauges)})"


_RANGE = "SELECT COUNT(*) AS days, MAX(kp_sum) AS k, MAX(ap_avg) AS a, MAX(f10_7_observed) AS f, max_by(kp_sum, observation_date) AS lk, max_by(ap_avg, observation_date) AS la, max_by(f10_7_observed, observation_date) AS lf FROM daily"
_COHORT = "SELECT ROUND(mean_altitude_km, 1) AS km, element_age_hours AS h FROM f WHERE source_group = 'iridium-33-debris'"
_ALL_METRICS = " UNION ALL ".join([
    f"SELECT * FROM ({SQL['metrics']})",
    _of(f"x AS ({SQL['disagreement_summary']})", *[_G(n, f"SELECT {c} AS v FROM x") for n, c in (("disagreement_pairs", "pairs"), ("disagreement_median_km", "median_total_km"), ("disagreement_max_km", "maximum_total_km"), ("disagreement_median_span_hours", "median_span_hours"), ("disagreement_excluded_pairs", "excluded_long_span + excluded_extreme"))]),
    _of(f"x AS ({SQL['backtest_stats']})", _G("validation_metric", "SELECT metric AS k, COALESCE(value, 0) AS v FROM x", "k")),
    _of(f"{DAILY}, x AS ({_RANGE})", *[_G(n, f"SELECT {c} AS v FROM x") for n, c in (("sw_index_days", "days"), ("sw_max_kp_sum_5y", "ROUND(k, 2)"), ("sw_max_ap_5y", "ROUND(a, 1)"), ("sw_max_f10_7_5y", "ROUND(f, 1)"), ("sw_latest_kp_sum", "ROUND(lk, 2)"), ("sw_latest_ap_avg", "ROUND(la, 1)"), ("sw_latest_f10_7", "ROUND(lf, 1)"))]),
    _of(f"{FEATURES}, x AS ({_COHORT}), y AS (SELECT COUNT(*) AS n, COALESCE(ROUND(MEDIAN(km), 1), 0) AS km, COALESCE(ROUND(100.0::DOUBLE * {sql_count('h > 24')} / NULLIF(COUNT(*), 0), 1), 0) AS stale FROM x)", _G("debris_objects", "SELECT n AS v FROM y"), _G("debris_median_altitude_km", "SELECT km AS v FROM y"), _G("debris_median_bstar", "SELECT 0 AS v"), _G("debris_stale_percent", "SELECT stale AS v FROM y")),
    _of(f"x AS ({SQL['gate_report']})", _G("quality_checks_total", "SELECT COUNT(*) AS v FROM x"), _G("quality_failures", f"SELECT COALESCE({sql_count('status = ' + repr('fail'))}, 0) AS v FROM x"), _G("quality_warnings", f"SELECT COALESCE({sql_count('status = ' + repr('warn'))}, 0) AS v FROM x")),
])


@query("all_metrics", _ALL_METRICS)
def _q(spark, d):
    return serve.metrics(_served(Tables(spark, d))).select("name", F.concat_ws(",", F.map_values("labels")).alias("label"), "value")


_LABEL_KEYS = "('validation_metric', 'metric'), ('ori_class_objects', 'reliability_class'), ('group_objects', 'source_group'), ('freshness_median_age_hours', 'source_group'), ('freshness_stale_percent', 'source_group')"
_PANELS_SQL = ", ".join(f"('{p}', '{k}', '{n}', {f}::DOUBLE)" for p, k, g in serve.PANELS for n, f in g.items())
_LABELS_SQL = """CASE WHEN m.name IS NULL THEN NULL WHEN k.key IS NULL THEN '{}' ELSE '{"' || k.key || '":"' || m.label || '"}' END"""


@query("dashboard_panels", f"WITH m AS ({_ALL_METRICS}), p(panel, kind, name, factor) AS (VALUES {_PANELS_SQL}), k(name, key) AS (VALUES {_LABEL_KEYS}) SELECT panel, kind, p.name AS name, {_LABELS_SQL} AS labels, m.value * factor AS value FROM p LEFT JOIN m ON m.name = p.name LEFT JOIN k ON k.name = p.name")
def _q(spark, d):
    return serve.panels(serve.metrics(_served(Tables(spark, d)))).withColumn("labels", F.to_json("labels"))


@query("panel_probe", f"WITH m AS ({_ALL_METRICS}), p(panel, kind, name, factor) AS (VALUES {_PANELS_SQL}) SELECT panel, CASE WHEN COUNT(value) > 0 THEN 'ok' ELSE 'empty' END AS status FROM p LEFT JOIN m USING (name) GROUP BY panel")
def _q(spark, d):
    return serve.probe(serve.panels(serve.metrics(_served(Tables(spark, d)))))


def _history(t: Tables) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """History tables that name their files, a registry that misses one of these and has one without rows, and odd files."""
    named = lambda df, f: df.select("*", F.lit(f).alias("source_file"), F.lit("x").alias("source_sha256"))
    tables = {"orbital_snapshot_history": t.orbital(), "noaa_magnetic_history": named(t.magnetic(), "m"), "noaa_plasma_history": named(t.plasma(), "p"), "space_weather_index_history": named(t.indices(), "i"), "satnogs_observation_history": named(t.observations(), "s")}
    listed = [(f"f{i}", 1) for i in range(50)] + [("m", 1), ("p", 1), ("i", 1), ("ghost", 3), ("known", 0)]
    registry = t.spark.createDataFrame(listed, "file_path string, row_count int")
    return tables, registry, t.spark.createDataFrame([("odd.txt",)], "file_path string")


_MOTION = "(11.0::DOUBLE + value / 100.0::DOUBLE)"
_HISTORY_CHECKS = [
    ("orbital_history_has_rows", "error", "SELECT COUNT(*) FROM events", "greater_than", 0.0),
    ("duplicate_orbital_snapshot_objects", "error", "SELECT COUNT(*) FROM (SELECT ts, user_id FROM events GROUP BY ALL HAVING COUNT(*) > 1)", "less_than_or_equal", 0.0),
    ("invalid_mean_motion_rows", "error", f"SELECT COUNT(*) FROM events WHERE COALESCE(NOT ({_MOTION} > 0 AND {_MOTION} <= 20), true)", "less_than_or_equal", 0.0),
    ("invalid_eccentricity_rows", "error", "SELECT COUNT(*) FROM events WHERE NOT (event_id % 40) / 1000.0::DOUBLE BETWEEN 0 AND 0.999999", "less_than_or_equal", 0.0),
    ("invalid_inclination_rows", "error", "SELECT COUNT(*) FROM events WHERE NOT event_id % 180 BETWEEN 0 AND 180", "less_than_or_equal", 0.0),
    ("modified_bronze_paths", "error", "SELECT 0", "less_than_or_equal", 0.0),
    ("orphan_history_rows", "error", "SELECT COUNT(*) FROM events", "less_than_or_equal", 0.0),
    ("registered_files_missing_rows", "error", "SELECT 51 - COUNT(DISTINCT event_id % 50) FROM events", "less_than_or_equal", 0.0),
    ("unloadable_bronze_files", "warning", "SELECT 1", "less_than_or_equal", 0.0),
    ("magnetic_missing_bz_percent", "warning", f"SELECT AVG(CASE WHEN bz_gsm IS NULL THEN 100.0::DOUBLE ELSE 0 END) FROM ({MAGNETIC})", "less_than_or_equal", 10.0),
    ("plasma_missing_speed_percent", "warning", f"SELECT AVG(CASE WHEN proton_speed IS NULL THEN 100.0::DOUBLE ELSE 0 END) FROM ({PLASMA})", "less_than_or_equal", 10.0),
    ("active_magnetic_rows", "warning", f"SELECT COUNT(*) FROM ({MAGNETIC}) WHERE is_active_source", "greater_than", 0.0),
    ("active_plasma_rows", "warning", f"SELECT COUNT(*) FROM ({PLASMA}) WHERE is_active_source", "greater_than", 0.0),
]


@query("gate_history", " UNION ALL ".join(f"SELECT '{n}' AS check_name, CASE WHEN v {_SIGN[o]} {x} THEN 'pass' ELSE '{'fail' if s == 'error' else 'warn'}' END AS status, '{s}' AS severity, ROUND(v, 6) AS observed_value, '{o}' AS operator, {x}::DOUBLE AS threshold FROM (SELECT CAST(({q}) AS DOUBLE) AS v)" for n, s, q, o, x in _HISTORY_CHECKS))
def _q(spark, d):
    return quality.gate(*_history(Tables(spark, d))).drop("description")


#: The extracts behind the charts: SQL, the table that each reads, and how it is made.
_EXTRACTS = {
    "hourly_weather": (f"WITH {HOURLY} SELECT hour_utc, ROUND(average_bz_gsm, 6) AS average_bz_gsm, ROUND(average_proton_speed, 6) AS average_proton_speed, disturbance_level FROM hourly", "space_weather_hourly", _hourly),
    "altitude_by_inclination": (f"WITH {FEATURES} SELECT ROUND(inclination_degrees, 6) AS inclination_degrees, ROUND(mean_altitude_km, 6) AS mean_altitude_km, source_group FROM f WHERE mean_altitude_km IS NOT NULL AND inclination_degrees IS NOT NULL", "orbit_features", _features),
    "largest_changes": (f"WITH {CHANGE} SELECT object_name, norad_catalog_id, ROUND(decay_rate_km_per_day, 6) AS decay_rate_km_per_day, snapshot_at_utc FROM change WHERE decay_rate_km_per_day IS NOT NULL ORDER BY ABS(decay_rate_km_per_day) DESC, norad_catalog_id LIMIT 25", "orbit_change", lambda t: gold.orbit_change(t.orbital())),
    "freshness": (f"WITH {CURRENT} SELECT source_group, ROUND(element_age_hours, 6) AS element_age_hours FROM fresh WHERE element_age_hours IS NOT NULL", "element_freshness", lambda t: gold.element_freshness(t.daily())),
    "index_by_age": (f"WITH {INDEX} SELECT element_age_hours, orbit_reliability_index, reliability_class FROM idx WHERE element_age_hours IS NOT NULL AND orbit_reliability_index IS NOT NULL", "orbit_reliability_index", _index),
    "disagreement": (f"WITH {CHANGE}, {_LABELLED} SELECT ROUND(span, 6) AS propagation_span_hours, ROUND(total, 6) AS total_km FROM ql WHERE q = 'ok'", "propagation_disagreement", _proxy),
    "daily_indices": (f"WITH {DAILY} SELECT observation_date, kp_sum, ap_avg, f10_7_observed FROM daily", "sw_index_daily", lambda t: gold.sw_index_daily(t.indices())),
}


def _extract(name: str, sql: str, table: str, make: Callable[[Tables], DataFrame]) -> None:
    query(f"chart_{name}", sql)(lambda spark, d: rounded(serve.chart_rows(name, {table: make(Tables(spark, d))})))


for _name, _made in _EXTRACTS.items():
    _extract(_name, *_made)


@query("file_stamps", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS snapshot_at_utc FROM events""")
def _q(spark, d):
    """Stamps in the names of files; a name of another shape, or an impossible stamp, has none."""
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    name = F.when(F.col("event_id") % 14 == 0, F.concat(F.lit("/celestrak/stations_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv"))).when(F.col("event_id") % 7 == 0, "/noaa/plasma_20269931T250000Z.json")
    path = F.coalesce(name, F.concat(F.lit("/satnogs/observations_"), stamp, F.lit(".json")))
    return Tables(spark, d).events.select("event_id", X.naive(X.snapshot_of(path)).alias("snapshot_at_utc"))


#: Raw fields as text, blank and wrong ones among them.
_RAW = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'None' WHEN 2 THEN ' x' || event_id || ' ' ELSE CAST(user_id AS VARCHAR) END AS a, CASE event_id % 4 WHEN 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS b, CASE event_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'NO' ELSE 'yes' END AS c FROM events"""
_TYPED = f"""SELECT event_id, NULLIF(NULLIF(TRIM(a), ''), 'None') AS object_name, TRY_CAST(TRIM(a) AS BIGINT) AS norad_catalog_id, CASE WHEN b LIKE 'no%' THEN NULL ELSE strptime(b, '%Y-%m-%dT%H:%M:%SZ') END AS start_utc, c = 'yes' AS is_active FROM ({_RAW})"""


@query("typed_fields", _TYPED)
def _q(spark, d):
    """Text of payloads to values: trimmed, blanks to null, numbers and times that don't parse to null, flags by their words."""
    e, k = Tables(spark, d).events, F.col("event_id")
    a = F.when(k % 5 == 0, "  ").when(k % 5 == 1, "None").when(k % 5 == 2, F.concat(F.lit(" x"), k, F.lit(" "))).otherwise(F.col("user_id").cast("string"))
    b = F.when(k % 4 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = e.select("event_id", a.alias("a"), b.alias("b"), F.when(k % 3 == 0, "false").when(k % 3 == 1, "NO").otherwise("yes").alias("c"))
    return raw.select("event_id", X.text_or_null("a").alias("object_name"), X.number("a", "long").alias("norad_catalog_id"), X.text_or_null("b").try_cast("timestamp_ntz").alias("start_utc"), X.flag("c").alias("is_active"))


#: Unit axes of the orbit at (x, y, z) with velocity (u, v, w), and a difference along them.
_FRAME = """SELECT event_id, 7000.0::DOUBLE + value AS x, (event_id % 97)::DOUBLE * 3 AS y, (event_id % 89)::DOUBLE AS z, (event_id % 13)::DOUBLE / 10 AS u, 7.5::DOUBLE AS v, 1.0::DOUBLE + (event_id % 7) AS w, value / 10 AS a, value / 20 AS b, -value / 30 AS c FROM events"""
_AXES = f"""WITH f AS ({_FRAME}), n AS (SELECT *, SQRT(x*x + y*y + z*z) AS r, y*w - z*v AS nx, z*u - x*w AS ny, x*v - y*u AS nz FROM f), m AS (SELECT *, SQRT(nx*nx + ny*ny + nz*nz) AS nn FROM n),
q AS (SELECT *, x/r AS rx, y/r AS ry, z/r AS rz, nx/nn AS cx, ny/nn AS cy, nz/nn AS cz FROM m)
SELECT event_id, ROUND(a*rx + b*ry + c*rz, 6) AS radial_km, ROUND(a*(cy*rz - cz*ry) + b*(cz*rx - cx*rz) + c*(cx*ry - cy*rx), 6) AS along_track_km, ROUND(a*cx + b*cy + c*cz, 6) AS cross_track_km FROM q"""


@query("orbit_frame", _AXES)
def _q(spark, d):
    """Differences in the frame of an orbit, by the function that measures propagation."""
    from ..functions import sgp4

    e, k = Tables(spark, d).events, F.col("event_id")
    value = F.col("value")
    xyz = [F.lit(7000.0) + value, (k % 97).cast("double") * 3, (k % 89).cast("double"), (k % 13).cast("double") / 10, F.lit(7.5), F.lit(1.0) + (k % 7), value / 10, value / 20, -value / 30]
    return rounded(e.select("event_id", *[c.cast("double").alias(n) for c, n in zip(xyz, "xyzuvwabc", strict=True)]).select("event_id", sgp4.frame(F.struct(*"xyz"), F.struct(*"uvw"), F.struct(*"abc")).alias("d")).select("event_id", "d.*"))


@query("bz_series", f"WITH {MINUTE} SELECT epoch(observation_minute_utc) AS epoch_seconds, ROUND(bz_gsm_nanotesla, 6) AS bz_gsm_nanotesla FROM minutes WHERE bz_gsm_nanotesla IS NOT NULL")
def _q(spark, d):
    rows = serve.chart_rows("bz_series", {"space_weather_minute": _minute(Tables(spark, d))})
    return rounded(rows.select(X.epoch_seconds("observation_minute_utc").alias("epoch_seconds"), "bz_gsm_nanotesla"))


@query("largest_changes", f"WITH {CHANGE} SELECT object_name, ROUND(decay_rate_km_per_day, 4) AS decay_rate_km_per_day, interval_minutes FROM change WHERE NOT same_element_set AND decay_rate_km_per_day IS NOT NULL ORDER BY decay_rate_km_per_day DESC, object_name LIMIT 10")
def _q(spark, d):
    return serve.largest_changes(gold.orbit_change(Tables(spark, d).orbital()))


def _raw_elements(t: Tables) -> DataFrame:
    """Payload columns with the name of the file that they came in."""
    o = t.orbital()
    return o.select(F.col("norad_catalog_id").cast("string").alias("NORAD_CAT_ID"), F.format_string("%.6f", "mean_motion_revolutions_per_day").alias("MEAN_MOTION"), F.concat(F.lit("/celestrak/"), F.when(F.col("source_group") == "view", "cubesat").otherwise(F.col("source_group")), F.lit("_20260830T120000Z.csv")).alias("file_path"))


_RAW = "r AS (SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'cubesat' ELSE event_type END AS g, CAST(printf('%.6f', 11.0::DOUBLE + value / 100.0::DOUBLE) AS DOUBLE) AS n FROM events)"


@query("lakehouse_counts", f"WITH {_RAW} SELECT COUNT(*) AS rows, COUNT(DISTINCT id) AS objects FROM r")
def _q(spark, d):
    return serve.raw_counts(_raw_elements(Tables(spark, d)))


@query("lakehouse_raw_groups", f"WITH {_RAW} SELECT g AS source_group, COUNT(DISTINCT id) AS objects FROM r GROUP BY g")
def _q(spark, d):
    return serve.raw_groups(_raw_elements(Tables(spark, d)))


@query("lakehouse_median_altitude", f"WITH {_RAW} SELECT ROUND(MEDIAN({ALT.format('n')}), 1) AS median_altitude_km FROM r WHERE g = 'cubesat' AND n > 0")
def _q(spark, d):
    return serve.raw_median_altitude(_raw_elements(Tables(spark, d)))


@query("lakehouse_current_rows", "SELECT COUNT(*) AS rows FROM events")
def _q(spark, d):
    return serve.current_rows(Tables(spark, d).silver())


@query("measured_pair_totals", f"WITH {CHANGE}, {PAIRS}, n AS (SELECT {sql_count('element_epoch_utc > pe')} AS forward, {sql_count('element_epoch_utc < pe')} AS retrograde FROM pairs) SELECT forward, retrograde, forward + retrograde AS total FROM n")
def _q(spark, d):
    counts = measure.measurement_counts(Tables(spark, d).orbital())
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("pairs"))), F.lit(0).cast("long"))
    back = F.col("kind") == "retrograde"
    return counts.agg(n(~back).alias("forward"), n(back).alias("retrograde"), n(F.lit(True)).alias("total"))


@query("sgp4_disagreement")
def _q(spark, d):
    return measure.propagation_disagreement(Tables(spark, d).orbital())


@query("sgp4_measurement_counts")
def _q(spark, d):
    return measure.measurement_counts(Tables(spark, d).orbital())


@query("grouped_cv_regression")
def _q(spark, d):
    from . import model

    t = Tables(spark, d)
    return model.scores(model.cross_validated(measure.validation_pairs(_proxy(t), t.orbital())))
