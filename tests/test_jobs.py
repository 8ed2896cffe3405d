"""The jobs: growing input, runs that come again, ranges of days, the command line, and their queries against SQL."""

import hashlib
import logging
import subprocess
import sys
from collections import Counter
from datetime import date
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import orbit_weather, queries, text_catalogue
from stellarframe.plans import catalogue
from stellarframe.session import new_folder

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
AWKWARD = [
    (1, "one two", "en", "a", 7), (1, "one two", "en", "a", 7), (1, "changed", "en", "a", 7), (2, None, "en", "a", None), (3, "", "fr", None, 0), (None, "one two", "en", "a", 7), (None, "one two", "xx", "b", 7),
    (4, "über\tänd", None, "a", 8), (5, "w " * 50_000, "", "a", 100_000), (6, "🙂".encode("utf-16", "surrogatepass").decode("utf-16"), "en/../x", "a=b", 1),
]


def entered(rows):
    """The records of rows (id, text, lang, source, length), each once."""
    out = set()
    for i, text, lang, source, n in rows:
        t = text or ""
        out.add((i, lang, source, n, None if text is None else hashlib.sha256(t.encode()).hexdigest(), len(t.encode()), len(t.split()), len(t), lang if lang in ("de", "en", "es", "fr") else "other"))
    return out


def sums(records):
    out = Counter()
    for lang, source in {r[1:3] for r in records}:
        own = [r for r in records if r[1:3] == (lang, source)]
        out[lang, source] = (len(own), len({r[4] for r in own} - {None}), sum(r[0] is None for r in own), sum(r[5] == 0 for r in own), sum(r[3] != r[7] for r in own), sum(r[5] for r in own), sum(r[6] for r in own))
    return out


def state(spark, out):
    """All that the catalogue says."""
    entries = [tuple(r) for r in text_catalogue.read_entries(spark, out).collect()]
    summary = {(r.lang, r.source): tuple(r[c] for c in text_catalogue.COUNTS) for r in text_catalogue.read_summary(spark, out).collect()}
    return Counter(entries), summary, sorted(map(tuple, spark.read.parquet(f"{out}/checks").collect()))


def test_catalogue_takes_only_what_is_new(spark, tmp_path, caplog):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()] + AWKWARD
    parts, folder, out = [given[:120], given[100:180], given[180:]], tmp_path / "in", str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    caplog.set_level(logging.INFO)
    assert text_catalogue.run(spark, str(folder), out) == {"batches": 0, "entries": 0, "failed_checks": 1}
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, text_catalogue.DOCUMENTS).withColumn("extra", F.lit(k)).coalesce(1).write.mode("append").parquet(str(folder))
        done = text_catalogue.run(spark, str(folder), out)
        so_far = entered(x for p in parts[: k + 1] for x in p)
        assert done["batches"] == 1 and done["entries"] == len(so_far)
        # the twenty rows that came before are read but not entered again
        new = len(so_far) - len(entered(x for p in parts[:k] for x in p))
        assert f"batch {k}: read {len(rows)} rows, entered {new} records" in caplog.text
        entries, summary, _ = state(spark, out)
        assert entries == Counter(so_far) and summary == sums(so_far)
    before = state(spark, out)
    assert text_catalogue.run(spark, str(folder), out)["batches"] == 0 and state(spark, out) == before
    # all at once, and one file to a batch, say the same
    for name, settings in (("once", {}), ("each", {"files_per_batch": 1})):
        other = str(tmp_path / name)
        assert text_catalogue.run(spark, str(folder), other, settings)["batches"] == (3 if settings else 1)
        assert state(spark, other) == before


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    out, settings = str(tmp_path / "out"), {"languages": ["en"]}
    frames = [spark.createDataFrame(rows, text_catalogue.DOCUMENTS) for rows in (AWKWARD[:4], AWKWARD)]
    for _ in range(2):  # a stopped run leaves a batch that the stream has not noted
        text_catalogue.enter(frames[0], 0, out, settings)
    once = Counter(map(tuple, text_catalogue.read_entries(spark, out).collect()))
    for _ in range(2):
        text_catalogue.enter(frames[1], 1, out, settings)
    twice = Counter(map(tuple, text_catalogue.read_entries(spark, out).collect()))
    assert once.keys() <= twice.keys() and set(twice.values()) == {1} and len(twice) == len(entered(AWKWARD))
    assert spark.read.parquet(f"{out}/totals").agg(F.sum("entries")).first()[0] == len(twice)


def test_checks_of_the_catalogue(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(AWKWARD, text_catalogue.DOCUMENTS).write.parquet(folder)
    assert text_catalogue.run(spark, folder, out)["failed_checks"] == 1
    status = {r.check_name: r.status for r in spark.read.parquet(f"{out}/checks").collect()}
    assert status == {"catalogue_has_entries": "pass", "entries_without_id": "fail", "empty_text_percent": "warn", "wrong_length_percent": "warn"}


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_days_do_not_depend_on_the_range(spark, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    orbit_weather.run(spark, SF, whole)
    changes, effects = map(rows_of, orbit_weather.read_output(spark, whole))
    assert len(changes) > 500 and effects
    orbit_weather.run(spark, SF, parts, date(2024, 1, 9), date(2024, 1, 30))
    kept = rows_of(orbit_weather.read_output(spark, parts)[0])
    orbit_weather.run(spark, SF, parts, None, date(2024, 1, 8))
    orbit_weather.run(spark, SF, parts, date(2024, 1, 5), date(2024, 1, 5))  # a day that was written before
    assert kept < rows_of(orbit_weather.read_output(spark, parts)[0])
    assert list(map(rows_of, orbit_weather.read_output(spark, parts))) == [changes, effects]
    days = {p.name for p in Path(parts, "changes").glob("day=*")}
    assert days == {f"day={r.day}" for r in spark.createDataFrame([(x[-1],) for x in changes], "day date").distinct().collect()}


def test_late_rows_take_a_second_run(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.where("event_id % 5 <> 0").write.parquet(f"{tables}/events.parquet")
    first = orbit_weather.run(spark, tables, out)
    assert orbit_weather.run(spark, tables, out) == first
    events.where("event_id % 5 = 0").write.mode("append").parquet(f"{tables}/events.parquet")
    assert orbit_weather.run(spark, tables, out)["changes"] > first["changes"]
    whole = str(tmp_path / "whole")
    orbit_weather.run(spark, SF, whole)
    assert [rows_of(x) for x in orbit_weather.read_output(spark, out)] == [rows_of(x) for x in orbit_weather.read_output(spark, whole)]


def test_no_rows(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tables}/events.parquet")
    assert orbit_weather.run(spark, tables, out) == {"changes": 0, "effects": 0}
    assert [x.count() for x in orbit_weather.read_output(spark, out)] == [0, 0]


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, name):
    from .test_catalogue import plain

    engine = duckdb.connect()
    for t in ("documents", "events"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    done = engine.execute(queries.SQL[name])
    at = {c[0]: i for i, c in enumerate(done.description)}
    assert sorted(at) == columns
    assert got == Counter(tuple(plain(r[at[c]]) for c in columns) for r in done.fetchall())
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_folders_are_new_each_time(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert "job1_text_catalogue" not in catalogue.QUERIES


@pytest.mark.parametrize("job, given", [("text_catalogue", ["--documents", f"{SF}/documents.parque[t]"]), ("orbit_weather", ["--tables", SF, "--first", "2024-01-03", "--last", "2024-01-03"])])
def test_command_line(job, given, tmp_path):
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--out", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert f"jobs.{job} read " in done.stderr and list(tmp_path.glob("out/*/**/*.parquet"))
