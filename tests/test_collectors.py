"""The collectors as a data source, mirrors by tasks, and sketches of distinct values."""

import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stellarframe.functions import sketches
from stellarframe.operators import history
from stellarframe.plans import serve
from stellarframe.sources import bronze, collectors, ingest, sinks

from .helpers import orbit, rows, seen

AT = "2026-08-30T12:00:00+00:00"
HEAD = "OBJECT_NAME,NORAD_CAT_ID,EPOCH,INCLINATION,ECCENTRICITY,MEAN_MOTION,BSTAR"


def answer(url):
    """What the network would say."""
    if "GROUP=" in url:
        group = url.split("GROUP=")[1].split("&")[0]
        return f"{HEAD}\n{group.upper()},7,2026-08-30T10:00:00,51.64,0.0004,15.5,\nB,8,2026-08-30T10:00:00,1,0,15,\n".encode()
    if url == ingest.INDICES_URL:
        return b"DATE,KP1,KP_SUM,AP_AVG,F10.7_OBS\n2026-08-29,20,160,8,150\n2026-08-31,,,,140\n"
    if url in ingest.SOLAR_WIND_URLS.values():
        value = {"bt": 5.1, "bz_gsm": None} if "mag" in url else {"proton_speed": 420, "proton_density": 3.2}
        return json.dumps([{"time_tag": "2026-08-30T11:00:00", "source": "DSCOVR", "active": True} | value]).encode()
    one = {"start": "2026-08-30T09:00:00Z", "end": "2026-08-30T09:10:00Z", "norad_cat_id": 1}
    status = url.split("status=")[1] if "status=" in url else "unknown"
    return json.dumps([one | {"id": {"good": 1, "bad": 2, "failed": 3, "unknown": 1}[status], "status": status}]).encode()


def test_records_are_those_that_are_landed(spark, tmp_path):
    collectors.register(spark, answer)
    df = spark.read.format("orbit_feeds").option("at", AT).option("spacing_s", "0").load()
    assert df.rdd.getNumPartitions() == len(bronze.GROUPS) + 4  # one for each group and feed
    got = df.collect()
    root, current, at = str(tmp_path / "bronze"), str(tmp_path / "silver"), datetime.fromisoformat(AT)
    ingest.elements(answer, root, current, at)
    ingest.solar_wind(answer, root, current, at)
    ingest.indices(answer, root, current, at)
    ingest.observations(answer, root, current, at, wait=lambda s: None)
    for r in bronze.found(spark, root).collect():
        raw = bronze.read_raw(spark, r.source, [r.file_path]).drop("file_path")
        name = r.file_path.rsplit("/", 1)[1].rsplit("_", 1)[0]
        own = [x for x in got if (x.source, x.name) == (r.source, name)]
        landed = [x.asDict() for x in raw.collect() if r.source != "spaceweather" or x.KP1]
        blank = lambda v: v if v not in ("", "null") else None
        assert sorted(str({c: blank(x.record.get(c)) for c in raw.columns}) for x in own) == sorted(str({c: blank(v) for c, v in x.items()}) for x in landed) and landed
        assert {x.snapshot_at_utc.replace(tzinfo=timezone.utc) for x in own} == {at}


def test_what_is_asked_for(spark):
    collectors.register(spark, answer, name="some_feeds")
    read = lambda **o: spark.read.format("some_feeds").options(at=AT, **o).load()
    assert {(r.source, r.name) for r in read(sources="celestrak,plasma", groups="science").collect()} == {("celestrak", "science"), ("plasma", "plasma")}
    with pytest.raises(Exception, match="unknown sources"):
        read(sources="tides").collect()

    def broken(url):
        return b"[]"

    collectors.register(spark, broken, name="broken_feeds")
    with pytest.raises(Exception, match="no rows"):
        spark.read.format("broken_feeds").options(at=AT, sources="plasma").load().collect()


def test_a_stream_takes_a_snapshot_each_interval(spark, tmp_path):
    """The clock is a file, so that the stream's reader sees it move wherever it runs."""
    clock = tmp_path / "clock"

    def clock_at() -> str:
        return clock.read_text()

    collectors.register(spark, answer, clock_at, name="timed_feeds")
    counts = []
    for at in (AT, "2026-08-30T12:20:00+00:00", "2026-08-30T13:00:00+00:00"):
        clock.write_text(at)
        stream = spark.readStream.format("timed_feeds").options(sources="plasma,celestrak", groups="stations", interval_s="3600").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination()
        counts.append(spark.read.schema(collectors.SCHEMA).parquet(str(tmp_path / "out")).groupBy("snapshot_at_utc").count().count())
    assert counts[0] == 1 and counts[-1] >= 2


def test_mirror_goes_on_past_a_file_that_cannot_be_copied(spark, tmp_path):
    root, to = tmp_path / "from", tmp_path / "to"
    for name, data in (("a/x.csv", b"1"), ("b/y.csv", b"2" * 100_000)):
        (root / name).parent.mkdir(parents=True)
        (root / name).write_bytes(data)
    (to / "b/y.csv").mkdir(parents=True)  # a folder is in the way
    (to / "b/y.csv/in").write_text("")
    files = bronze.found(spark, str(root)).select(F.col("file_path").alias("path"))
    files = files.unionByName(spark.createDataFrame([(str(root / "gone"),), ("/etc/hostname",)], "path string"))
    report = {r.path.rsplit("/", 1)[1]: r for r in sinks.mirror(files, str(root), str(to), str(tmp_path / "report"), block=1000).collect()}
    assert {n for n, r in report.items() if r.error} == {"y.csv", "gone", "hostname"} and "not below" in report["hostname"].error
    assert (report["x.csv"].bytes, report["x.csv"].sha256) == (1, hashlib.sha256(b"1").hexdigest()) and (to / "a/x.csv").read_bytes() == b"1"
    assert not list(to.rglob("*.part"))
    # what is left to do is what failed
    there = bronze.listing(spark, str(to)).select(F.regexp_replace("file_path", "^file:" + str(to), "file:" + str(root)).alias("path"), "sha256")
    left = sinks.to_mirror(bronze.listing(spark, str(root)).select(F.col("file_path").alias("path"), "sha256"), there)
    assert [r.path.rsplit("/", 1)[1] for r in left.collect()] == ["y.csv"]


def test_sketches_merge_within_their_error(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") % 40).alias("load"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("few"))
    overlapping = df.unionByName(df.where("load < 20").withColumn("load", F.col("load") + 100))
    kept = sketches.sketched(overlapping, ("v", "few"), ["load"])
    got = {r.column: r for r in sketches.merged(kept).withColumn("n", sketches.estimate()).collect()}
    assert abs(got["v"].n - n) <= sketches.tolerance() * n and got["few"].n == 25 and got["v"].rows == n * 3 // 2
    assert sketches.merged(kept.limit(0)).count() == 0


def test_gauges_read_sketches_not_history(spark, tmp_path):
    root, home = tmp_path / "bronze/celestrak", str(tmp_path / "history")
    root.mkdir(parents=True)
    for hour in range(3):
        (root / f"stations_20260830T{hour:02d}0000Z.csv").write_text(f"{HEAD}\n" + "".join(f"O,{i},2026-08-30T10:00:00,1,0,15,\n" for i in range(hour, hour + 5)))
        history.load(spark, str(tmp_path / "bronze"), home)
    assert len(list((tmp_path / "history/distinct_sketches").glob("load=*"))) == 3
    gauges = lambda t: {r.name: r.value for r in serve.metrics(t).collect()}
    exact = gauges({"orbital_snapshot_history": history.read_history(spark, home, "orbital_snapshot_history")})
    kept = history.read_sketches(spark, home)
    found = gauges({"distinct_sketches": kept, "orbital_snapshot_history": rows(spark, "orbital_snapshot_history", orbit(snapshot_at_utc=seen(1)))})
    assert {n: found[n] for n in exact} == exact == {"database_reachable": 1, "objects_tracked": 7, "orbital_snapshots": 3} and found["satnogs_distinct_stations"] == 0
    # sketches of a load that was not finished are not seen; those of an older history are made up for
    spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/distinct_sketches").withColumn("source_sha256", F.lit("?")).write.parquet(f"{home}/distinct_sketches/load=crashed")
    assert gauges({"distinct_sketches": history.read_sketches(spark, home)}) == found
    history._delete(spark, f"{home}/distinct_sketches")
    (root / "stations_20260830T090000Z.csv").write_text(f"{HEAD}\nO,99,2026-08-30T10:00:00,1,0,15,\n")
    history.load(spark, str(tmp_path / "bronze"), home)
    again = gauges({"distinct_sketches": history.read_sketches(spark, home)})
    assert (again["objects_tracked"], again["orbital_snapshots"]) == (8, 4)
