"""The jobs as queries: each is run twice into a new folder, and what then lies there is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarframe.plans import catalogue
from stellarframe.session import new_folder

from . import orbit_weather, text_catalogue


def job1_text_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the catalogue, each with the sums of its language and source."""
    out = new_folder(spark, "job1")
    for _ in range(2):
        text_catalogue.run(spark, f"{sf_dir}/documents.parque[t]", out)  # a pattern, so that one file will do
    entries, summary = text_catalogue.read_entries(spark, out), text_catalogue.read_summary(spark, out)
    sums = summary.select("lang", "source", *[F.col(c).alias(f"group_{c}") for c in text_catalogue.COUNTS])
    return entries.join(sums, text_catalogue.same(entries, sums, ("lang", "source")), "left").select(entries["*"], *[f"group_{c}" for c in text_catalogue.COUNTS])


def job2_orbit_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of all days, each with what its day's weather level shows."""
    out = new_folder(spark, "job2")
    for _ in range(2):
        orbit_weather.run(spark, sf_dir, out)
    changes, effects = orbit_weather.read_output(spark, out)
    return catalogue.rounded(changes.join(effects, ["day", "disturbance_level"], "left"))


QUERIES = {f.__name__: f for f in (job1_text_catalogue, job2_orbit_weather)}

JOB1_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, lang, source, n_chars, CASE WHEN text IS NOT NULL THEN sha256(text) END AS content_sha256, coalesce(strlen(text), 0) AS n_bytes,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_words, coalesce(length(text), 0) AS true_chars, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS part FROM documents),
g AS (SELECT lang, source, COUNT(*) AS entries, COUNT(DISTINCT content_sha256) AS contents, COUNT(*) FILTER (WHERE doc_id IS NULL) AS null_ids, COUNT(*) FILTER (WHERE n_bytes = 0) AS empty_texts,
    COUNT(*) FILTER (WHERE n_chars IS DISTINCT FROM true_chars) AS wrong_lengths, SUM(n_bytes)::BIGINT AS text_bytes, SUM(n_words)::BIGINT AS words FROM d GROUP BY 1, 2)
SELECT d.doc_id, d.lang, d.source, d.n_chars, d.content_sha256, d.n_bytes, d.n_words, d.true_chars, d.part, entries AS group_entries, contents AS group_contents, null_ids AS group_null_ids, empty_texts AS group_empty_texts,
    wrong_lengths AS group_wrong_lengths, text_bytes AS group_text_bytes, words AS group_words FROM d LEFT JOIN g ON d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source
"""

_C = catalogue
JOB2_SQL = f"""
WITH {_C.HOURLY}, {_C.CHANGE}, w AS (SELECT observation_minute_utc AS m, bz_gsm_nanotesla AS bz, proton_speed_km_per_second AS speed FROM minutes),
spans AS (SELECT hour_utc, MIN(minimum_bz_gsm) OVER span AS lowest, MAX(average_proton_speed) OVER span AS highest, COUNT(*) FILTER (WHERE disturbance_level <> 'quiet') OVER span AS disturbed FROM hourly WINDOW span AS (ORDER BY hour_utc RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW)),
a AS (SELECT change.*, CASE WHEN m >= snapshot_at_utc - INTERVAL 6 HOURS THEN m END AS m, bz, speed FROM change ASOF LEFT JOIN w ON snapshot_at_utc >= m),
b AS (SELECT a.*, CASE WHEN hour_utc >= snapshot_at_utc - INTERVAL 24 HOURS THEN hour_utc END AS hour_utc, lowest, highest, disturbed FROM a ASOF LEFT JOIN spans ON snapshot_at_utc >= hour_utc),
c2 AS (SELECT object_name, norad_catalog_id, snapshot_at_utc, interval_minutes, same_element_set, semi_major_axis_change_km, decay_rate_km_per_day, m AS observation_minute_utc, CASE WHEN m IS NOT NULL THEN bz END AS bz_gsm_nanotesla, CASE WHEN m IS NOT NULL THEN speed END AS proton_speed_km_per_second,
    CASE WHEN m IS NULL THEN 'unknown' WHEN bz < -5 THEN 'southward_bz' WHEN speed > 500 THEN 'fast_wind' ELSE 'quiet' END AS disturbance_level, CASE WHEN hour_utc IS NOT NULL THEN lowest END AS lowest_bz_gsm, CASE WHEN hour_utc IS NOT NULL THEN highest END AS highest_proton_speed, CASE WHEN hour_utc IS NOT NULL THEN disturbed END AS disturbed_hours, CAST(snapshot_at_utc AS DATE) AS day FROM b),
e AS (SELECT day, disturbance_level, COUNT(*) AS changes, COUNT(*) FILTER (WHERE NOT same_element_set) AS new_elements, MEDIAN(ABS(decay_rate_km_per_day)) AS median_decay,
    list_sort(list(ABS(decay_rate_km_per_day)) FILTER (WHERE decay_rate_km_per_day IS NOT NULL))[LEAST(COUNT(decay_rate_km_per_day) - 1, CAST(floor(0.9::DOUBLE * COUNT(decay_rate_km_per_day)) AS BIGINT)) + 1] AS p90_decay FROM c2 GROUP BY 1, 2)
SELECT object_name, norad_catalog_id, snapshot_at_utc, interval_minutes, same_element_set, {", ".join(f"ROUND({x}, 6) AS {x}" for x in ("semi_major_axis_change_km", "decay_rate_km_per_day", "bz_gsm_nanotesla", "proton_speed_km_per_second", "lowest_bz_gsm", "highest_proton_speed", "median_decay", "p90_decay"))},
    observation_minute_utc, disturbance_level, disturbed_hours, day, changes, new_elements FROM c2 JOIN e USING (day, disturbance_level)
"""

SQL = {"job1_text_catalogue": JOB1_SQL, "job2_orbit_weather": JOB2_SQL}
