"""Operators along time against plain Python, with ranges of several lengths."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stellarframe.operators import timeline
from stellarframe.plans import gold, measure

from .helpers import orbit, rows

START = datetime(2026, 8, 1)


def times(rng, n, hours=200):
    return [START + timedelta(minutes=rng.randrange(hours * 60)) for _ in range(n)]


@pytest.mark.parametrize("range_s", [3600, 86_400, 10**8])
@pytest.mark.parametrize("within_s", [None, 7200])
def test_as_of(spark, range_s, within_s):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), t) for i, t in enumerate(times(rng, 300))] + [(900, "a", None), (901, None, START), (902, "c", START), (903, "a", START - timedelta(days=9))]
    right = [(rng.choice("ab"), t, rng.choice([None, 1.5, 2.5, 3.5])) for t in times(rng, 60)] * 2 + [("a", None, 9.0), (None, START, 9.0)]
    l_df, r_df = spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, at timestamp_ntz, v double")
    got = {r.id: (r["at"], r.v) for r in timeline.as_of(l_df, r_df, "t", "at", ["v"], by=["k"], within_s=within_s, range_s=range_s).collect()}
    want = {}
    for i, k, t in left:
        known = [(at, v is not None, v) for kk, at, v in right if None not in (k, kk, t, at) and kk == k and at <= t and (within_s is None or t - at <= timedelta(seconds=within_s))]
        best = max(known, key=lambda x: x[:2] + (x[2] or 0,), default=(None, None, None))
        want[i] = (best[0], best[2])
    assert got == want
    everyone = timeline.as_of(l_df.drop("k"), r_df.drop("k"), "t", "at", ["v"], range_s=range_s)
    assert everyone.count() == len(left) and timeline.as_of(l_df.limit(0), r_df, "t", "at", ["v"]).count() == 0
    assert timeline.as_of(l_df, r_df.limit(0), "t", "at", ["v"]).where("at IS NULL").count() == len(left)


def test_rolling(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["a", None]), t, rng.choice([None, float(rng.randrange(50))])) for i, t in enumerate(times(rng, 400))] + [(900, "a", None, 1.0)]
    df = spark.createDataFrame(data, "id int, k string, t timestamp_ntz, v double")
    got = timeline.rolling(df, "t", 10 * 3600, {"low": F.min("v"), "n": F.count(F.lit(1))}, by=["k"]).collect()
    assert len(got) == len(data)
    for r in got:
        own = [v for _, k, t, v in data if r.t is not None and t is not None and k == r.k and r.t - timedelta(hours=10) < t <= r.t]
        assert (r.low, r.n) == ((min((v for v in own if v is not None), default=None), len(own)) if r.t is not None else (None, None))


@pytest.mark.parametrize("range_s", [1800, 86_400, 10**8])
def test_previous(spark, range_s):
    rng = random.Random(7)
    data = [(rng.choice([1, 1, 1, 2, None]), t, rng.choice([None, 1, 2, 3])) for t in times(rng, 300, 90)] + [(1, None, 5), (3, START, 1)]
    df = spark.createDataFrame(data, "k int, t timestamp_ntz, v int")
    got = timeline.previous(df, "k", ["t"], ["t", "v"], range_s=range_s).collect()
    place = lambda t, v: (t is not None, t or START, v is not None, v or 0)
    want = []
    for k in (1, 2, 3, None):
        own = sorted(((t, v) for kk, t, v in data if kk == k), key=lambda x: place(*x))
        want += [(k, *now, before) for now, before in zip(own, [None, *own[:-1]], strict=True)]
    assert sorted(((r.k, r.t, r.v, tuple(r.previous) if r.previous else None) for r in got), key=str) == sorted(want, key=str)


def test_an_object_with_most_rows_is_no_task_of_its_own(spark):
    """One object has nine tenths of the rows: the largest task of the window has few of them, the result is that of one window."""
    rng = random.Random(9)
    data = [orbit(norad_catalog_id=1 if i % 10 else i, snapshot_at_utc=START + timedelta(minutes=7 * i), element_epoch_utc=START + timedelta(hours=i // 5), mean_motion_revolutions_per_day=14 + rng.random()) for i in range(4000)]
    orbital = rows(spark, "orbital_snapshot_history", *data).repartition(8)
    change = {(r.norad_catalog_id, r.snapshot_at_utc): r.previous_mean_motion for r in gold.orbit_change(orbital).collect()}
    last, want = {}, {}
    for r in sorted(data, key=lambda r: r["snapshot_at_utc"]):
        if (k := r["norad_catalog_id"]) in last:
            want[k, r["snapshot_at_utc"]] = last[k]
        last[k] = r["mean_motion_revolutions_per_day"]
    assert change == want
    assert measure.element_pairs(orbital).count() == sum(r.n for r in orbital.groupBy("norad_catalog_id").agg((F.countDistinct("element_epoch_utc") - 1).alias("n")).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        per_task = sorted(r["count"] for r in timeline.previous(orbital, "norad_catalog_id", ["snapshot_at_utc"], ["snapshot_at_utc"], range_s=3 * 3600).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert sum(per_task) == 4000 and per_task[-1] < 10 * per_task[len(per_task) // 2]
