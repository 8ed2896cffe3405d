"""Streams against the plans over the same rows, in shuffled batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stellarframe.plans import gold
from stellarframe.sources import bronze
from stellarframe.streaming import pending, replay, weather

from .helpers import magnetic, plasma, rows, seen

START = datetime(2026, 8, 29)
FAR = "2100-01-01 00:00:00"


def feed(spark, make, table, seed, n=300):
    """Several rows a minute, of several spacecraft, versions and qualities, some without a value or time."""
    rng = random.Random(seed)
    made = [
        make(observed_at_utc=rng.choice([None, *[START + timedelta(seconds=rng.randrange(4000))] * 30]), snapshot_at_utc=seen(rng.randrange(20, 25)), spacecraft=rng.choice(["A", "B", None]), is_active_source=rng.choice([True, False, None]), quality_code=rng.choice([None, 0, 1]))
        for _ in range(n)
    ]
    return rows(spark, table, *made)


@pytest.mark.parametrize("batches", [1, 4])
def test_minutes_of_two_streams(spark, batches):
    m, p = feed(spark, magnetic, "noaa_magnetic_history", 1), feed(spark, plasma, "noaa_plasma_history", 2, 60)

    def made(out):
        close = lambda f: f.limit(1).withColumn("observed_at_utc", F.lit(FAR).cast("timestamp_ntz"))
        return weather.joined_minutes(*[replay.arrive(f, f"{out}/{n}", batches, close(f)) for n, f in (("m", m), ("p", p))], "2 hours")

    got, want = replay.played(spark, "minutes", made), gold.space_weather_minute(m, p)
    assert want.where("plasma_observed_at_utc IS NULL").count() and want.where("plasma_observed_at_utc IS NOT NULL").count()
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_minute_waits_for_its_watermark(spark, tmp_path):
    """What is not yet final is not there; a row that is too late is dropped, and what is final is forgotten."""
    early = rows(spark, "noaa_magnetic_history", *[magnetic(observed_at_utc=START + timedelta(minutes=i)) for i in range(10)])
    later = rows(spark, "noaa_magnetic_history", magnetic(observed_at_utc=START + timedelta(minutes=20)), magnetic(observed_at_utc=START + timedelta(minutes=21)))
    late = rows(spark, "noaa_magnetic_history", magnetic(observed_at_utc=START + timedelta(minutes=1), bz_gsm=-50.0, is_active_source=True), magnetic(observed_at_utc=START + timedelta(minutes=40)))
    other = lambda i: rows(spark, "noaa_plasma_history", plasma(observed_at_utc=START + timedelta(minutes=i)))
    out = str(tmp_path)
    other(2).coalesce(1).write.parquet(f"{out}/p")
    early.limit(0).write.parquet(f"{out}/m")
    streams = [spark.readStream.schema(f.schema).parquet(f"{out}/{n}") for f, n in ((early, "m"), (other(0), "p"))]
    seen_minutes, states = [], []
    for f, last in ((early, 9), (later, 22), (late, 41)):
        f.coalesce(1).write.mode("append").parquet(f"{out}/m")
        other(last).coalesce(1).write.mode("append").parquet(f"{out}/p")
        query = weather.joined_minutes(*streams, "5 minutes").writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.parquet(f"{out}/out")
        seen_minutes.append(found.count())
        states.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    assert seen_minutes[0] < 10 <= seen_minutes[1] <= seen_minutes[2] and found.where("bz_gsm_nanotesla = -50").count() == 0
    assert found.where("plasma_observed_at_utc IS NOT NULL").count() == 2 and states[-1] < 10


OBSERVATIONS = "observation_id long, snapshot_at_utc timestamp, end_utc timestamp_ntz, status string"


def versions(rng, n):
    out = []
    for k in range(n):
        at, end = START + timedelta(minutes=7 * k), START + timedelta(minutes=rng.randrange(3000))
        out.append((rng.choice([None, *range(60)]), at, rng.choice([end, end, end, None]), rng.choice(["good", " Bad ", "future", "unknown", None, "failed"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_open_observations_in_any_order(spark, seed):
    """What the timers say is what the plan over all rows finds."""
    given = versions(random.Random(seed), 250)
    df = spark.createDataFrame(given, OBSERVATIONS)
    closing = spark.createDataFrame([(-1, datetime(2100, 1, 1), None, "good")], OBSERVATIONS)
    got = replay.played(spark, "open", lambda out: pending.still_open(replay.arrive(df, f"{out}/o", 5, closing), "3 days"))
    raw = df.select(F.date_format("snapshot_at_utc", "yyyyMMddHHmmss").alias("file_path"), F.col("observation_id").cast("string").alias("id"), F.date_format("end_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("end"), "status")
    want = bronze.pending_ids(raw, F.lit("2099-01-01").cast("timestamp"), limit=1000)
    assert sorted((r.observation_id, r.end_utc) for r in got.collect()) == sorted((r.observation_id, r.end_utc) for r in want.collect()) and got.count() > 5


def test_a_timer_fires_once_its_pass_is_over(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    steps = [
        ([(1, at(0), at(5), "future"), (2, at(0), at(5), "future"), (3, at(0), None, "future"), (4, at(0), at(-1), "future")], []),
        ([(9, at(3), at(90), "future")], [4]), ([(2, at(4), at(5), "good"), (9, at(7), at(90), "future")], [1, 4]), ([(1, at(8), at(5), "unknown"), (9, at(10), at(90), "good")], [1, 1, 4]),
    ]
    out = str(tmp_path)
    for given, want in steps:
        df = spark.createDataFrame(given, OBSERVATIONS)
        df.coalesce(1).write.mode("append").parquet(f"{out}/o")
        stream = spark.readStream.schema(df.schema).parquet(f"{out}/o")
        query = pending.still_open(stream, "1 hour").writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.observation_id for r in spark.read.schema(pending.OUT).parquet(f"{out}/out").collect()) == want
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
