"""Propagation, pairs, labels, statistics and the backtest."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellarframe.functions import sgp4, stats
from stellarframe.plans import boosting, measure, model

from .helpers import at, orbit, rows, seen

LOW = dict(inclination=97.4, eccentricity=0.0021, mean_motion=15.1, bstar=4e-5, raan=17.0, arg_perigee=250.0, mean_anomaly=131.0)


def days(year, day):
    """Days since 1949-12-31 of a day of a year, counted from 1."""
    return (datetime(year, 1, 1) - datetime(1949, 12, 31)).days + day - 1


def state(minutes=0.0, epoch=27_000.0, **more):
    args = LOW | more
    return sgp4.propagate(*[np.array([args[k]], float) for k in ("inclination", "eccentricity", "mean_motion", "bstar", "raan", "arg_perigee", "mean_anomaly")], np.array([minutes]), np.array([epoch]))


def test_low_orbit_has_its_radius_speed_and_period():
    p, v, e = state()
    assert e[0] == 0 and 6500 < np.linalg.norm(p) < 7200 and 7 < np.linalg.norm(v) < 8
    later, _, _ = state(1440 / 15.1, bstar=0.0)
    assert np.linalg.norm(later - p) < 120  # the node and perigee move, little else
    ahead, _, _ = state(0.001)
    assert np.allclose((ahead - p) / 0.06, v, atol=0.01)


def test_published_vector():
    """Satellite 00005 of the 2006 verification set (Vallado et al.), at its epoch and after 360 minutes."""
    given = dict(inclination=34.2682, eccentricity=0.1859667, mean_motion=10.82419157, bstar=0.28098e-4, raan=348.7242, arg_perigee=331.7664, mean_anomaly=19.3264)
    p, v, e = state(0.0, **given)
    assert e[0] == 0 and np.allclose(p[0], [7022.46529266, -1400.08296755, 0.03995155], atol=1e-5) and np.allclose(v[0], [1.893841015, 6.405893759, 4.534807250], atol=1e-8)
    p, _, _ = state(360.0, **given)
    assert np.allclose(p[0], [-7154.03120202, -3783.17682504, -3536.19412294], atol=1e-4)


#: Each field just beyond its bounds, far beyond them, and absent.
BEYOND = [("eccentricity", x) for x in (-1e-9, 1.0, 7.5, np.nan)] + [("mean_motion", x) for x in (0.0, -15.1, np.nan)] + [("inclination", x) for x in (-0.5, 180.5, 360.0)]


@pytest.mark.parametrize(("field", "value"), BEYOND)
def test_bad_elements_are_refused(field, value):
    p, _, e = state(**{field: value})
    assert e[0] == sgp4.BAD_ELEMENT and np.isnan(p).all()


def test_null_drag_counts_as_none():
    assert state(bstar=np.nan)[2][0] == 0


def test_published_deep_space_vector():
    """Satellite 11801 of the same set, a long ellipse, at its epoch and after 360 minutes."""
    given = dict(inclination=46.7916, eccentricity=0.7318036, mean_motion=2.28537848, bstar=0.14311e-1, raan=230.4354, arg_perigee=47.4722, mean_anomaly=10.4117, epoch=days(1980, 230.29629788))
    p, v, e = state(0.0, **given)
    assert e[0] == 0 and np.allclose(p[0], [7473.37102491, 428.94748312, 5828.74846783], atol=1e-2) and np.allclose(v[0], [5.107155391, 6.444680305, -0.186133297], atol=1e-5)
    p, _, _ = state(360.0, **given)
    assert np.allclose(p[0], [-3305.22, 32410.86, -24697.18], atol=0.1)


@pytest.mark.parametrize("orbit", [dict(mean_motion=1.00272, eccentricity=0.0003, inclination=0.05), dict(mean_motion=1.00272, eccentricity=0.0003, inclination=6.0), dict(mean_motion=2.00613, eccentricity=0.69, inclination=63.4)])
def test_resonant_orbits_move_smoothly_and_keep_their_energy(orbit):
    times = np.arange(-3000.0, 3001.0, 60.0)
    got = [state(t, bstar=0.0, **orbit) for t in times]
    assert all(e[0] == 0 for _, _, e in got)
    axis = np.array([1 / (2 / np.linalg.norm(p) - np.sum(v**2) / sgp4.MU) for p, v, _ in got])
    assert np.ptp(axis) / axis.mean() < 2e-3
    for t in (-1500.0, 719.9, 1440.0, 2999.0):  # velocity is the slope of position, also where an integration step ends
        (a, _, _), (b, v, _), (c, _, _) = (state(t + d, bstar=0.0, **orbit) for d in (-0.01, 0.0, 0.01))
        assert np.allclose((c - a) / 1.2, v, atol=2e-3)


def test_frame_axes():
    r, v = np.array([[7000.0, 0, 0]]), np.array([[0, 7.5, 0.0]])
    for k in range(3):
        d = np.zeros((1, 3))
        d[0, k] = 1
        assert [float(x[0]) for x in sgp4.radial_along_cross(r, v, d)] == [1.0 if i == k else 0.0 for i in range(3)]


def test_labels(spark):
    given = [(9.6, 0.29), (73.0, 10.0), (10.0, 501.0), (200.0, 5079.0), (72.0, 500.0)]
    got = spark.createDataFrame(given, "s double, t double").select(measure.quality_label("s", "t").alias("q")).collect()
    assert [r.q for r in got] == ["ok", "long_span", "extreme", "extreme", "ok"]


def history(spark, *given):
    return rows(spark, "orbital_snapshot_history", *given)


def test_pairs(spark):
    a, b = at(30, 0), at(30, 6)
    h = history(spark, *[orbit(snapshot_at_utc=seen(30, t), element_epoch_utc=e) for t, e in ((10, a), (12, a), (14, b))], orbit(norad_catalog_id=2), orbit(norad_catalog_id=None), orbit(norad_catalog_id=None, element_epoch_utc=b))
    (p,) = measure.element_pairs(h).collect()
    assert p.earlier_snapshot_at_utc.hour == 12 and p.earlier.epoch == a and p.later.epoch == b
    back = history(spark, orbit(snapshot_at_utc=seen(30, 10), element_epoch_utc=b), orbit(snapshot_at_utc=seen(30, 12), element_epoch_utc=a))
    assert {r.kind: r.pairs for r in measure.measurement_counts(back).collect()} == {"retrograde": 1}


def test_disagreement_grows_with_a_wrong_motion(spark):
    p0, _, _ = state()
    h = history(spark, orbit(element_epoch_utc=at(30, 0), snapshot_at_utc=seen(30, 1)), orbit(element_epoch_utc=at(30, 12), snapshot_at_utc=seen(30, 13), mean_motion_revolutions_per_day=14.2001), orbit(norad_catalog_id=2, element_epoch_utc=at(30, 0), snapshot_at_utc=seen(30, 1), mean_motion_revolutions_per_day=-1.0), orbit(norad_catalog_id=2, element_epoch_utc=at(30, 12), snapshot_at_utc=seen(30, 13), mean_motion_revolutions_per_day=1.0), orbit(norad_catalog_id=3, element_epoch_utc=at(30, 0), snapshot_at_utc=seen(30, 1), mean_motion_revolutions_per_day=1.0), orbit(norad_catalog_id=3, element_epoch_utc=at(30, 12), snapshot_at_utc=seen(30, 13), mean_motion_revolutions_per_day=1.0001))
    r, far = measure.propagation_disagreement(h).orderBy("norad_catalog_id").collect()
    assert far.norad_catalog_id == 3 and far.total_km > 0
    assert r.propagation_span_hours == 12.0 and abs(r.total_km**2 - r.radial_km**2 - r.along_track_km**2 - r.cross_track_km**2) < 1
    assert {x.kind: x.pairs for x in measure.measurement_counts(h).collect()}["skipped"] == 1


def test_ranks_and_correlations(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (5.0,), (9.0,), (None,)], "x double")
    assert sorted((r.x, r.k) for r in stats.average_ranks(df, "x", "k").collect() if r.x) == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5), (9.0, 4.0)]
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (4.0, 4.0), (5.0, 5.0), (6.0, None)], "x double, y double")
    assert abs(xy.agg(stats.pearson("x", "y").alias("r")).first().r - 0.7745966) < 1e-6
    assert xy.agg(stats.pearson("x", F.lit(1.0)).alias("r")).first().r == 0.0
    assert xy.limit(1).agg(stats.pearson("x", "y").alias("r")).first().r == 0.0
    hole = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, 3.0), (4.0, 2.0), (5.0, 1.0)], "x double, y double")
    assert abs(stats.spearman(hole, "x", "y").first().rho + 1) < 1e-12 and stats.spearman(hole.limit(0), "x", "y").first().rho == 0.0


def test_nearest_p90(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0), ("c", None)], "g string, v double")
    assert {r.g: r.p for r in stats.nearest_p90_by(df, ["g"], "v", "p").collect()} == {"a": 9.0, "b": 1.0}


def spread(n):
    """Values that crowd at one place, at both ends and over many orders of magnitude, with ties."""
    import random

    rng = random.Random(n)
    kinds = [lambda: 7.0, lambda: rng.gauss(1e6, 1e-3), lambda: 10 ** rng.uniform(-12, 12), lambda: -(10 ** rng.uniform(-9, 3)), lambda: float(rng.randrange(5)), lambda: -1e300, lambda: 1e300, lambda: 0.0]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_do_not_depend_on_shared_exchanges(spark, reuse):
    from bisect import bisect_left, bisect_right

    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        values = spread(4000)
        order = sorted(values)
        df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g int")
        for r in stats.average_ranks(df, "v", "k").collect():
            assert r.k == (None if r.v is None else (bisect_left(order, r.v) + 1 + bisect_right(order, r.v)) / 2)
        by = {g: sorted(values[g::3]) for g in range(3)}
        for r in stats.average_ranks(df, "v", "k", "g").where("v IS NOT NULL").collect():
            assert r.k == (bisect_left(by[r.g], r.v) + 1 + bisect_right(by[r.g], r.v)) / 2
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_quantiles_against_sorted_values(spark):
    values = spread(2000)
    names = ["a", "b", None]
    df = spark.createDataFrame([(names[i % 3], v, float(i)) for i, v in enumerate(values)] + [("none", None, 1.0), ("a", None, 2.0)], "g string, v double, w double")
    wanted = {"m": ("v", 0.5), "p": ("v", 0.9), "n": ("v", 0.9, stats.NEAREST), "w": ("w", 0.25)}
    got = {r.g: r for r in stats.quantiles(df, ["g"], wanted).collect()}
    assert set(got) == {*names, "none"} and (got["none"].m, got["none"].n, got["none"].w) == (None, None, 1.0)
    for k, g in enumerate(names):
        own = np.sort(values[k::3])
        assert np.allclose([got[g].m, got[g].p], np.percentile(own, [50, 90]), rtol=1e-9) and got[g].n == own[min(len(own) - 1, int(0.9 * len(own)))]
    assert [tuple(r) for r in stats.quantiles(df.limit(0), [], {"m": ("v", 0.5)}).collect()] == [(None,)]
    assert np.isclose(stats.quantiles(df, [], {"m": ("v", 0.5)}).first().m, np.median(values))


def test_no_group_is_kept_in_one_aggregate(spark):
    from stellarframe.plans import catalogue, serve

    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    plans = [catalogue.gold.freshness_by_group(catalogue.gold.element_freshness(t.daily())), serve.disagreement(catalogue._proxy(t)), measure.validation_bins(pairs(spark, 40)), serve.metrics(catalogue._served(t))]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in text and "median(" not in text and "collect_list" not in text


def test_a_group_of_many_equal_values(spark):
    """Sixty million rows of one group; equal values are counted before anything is moved."""
    rows = spark.range(60_000_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 < 3, 2.0).otherwise(5.0).alias("v"))
    assert [tuple(r) for r in stats.quantiles(rows, ["g"], {"a": ("v", 0.25), "b": ("v", 0.9, stats.NEAREST)}).collect()] == [("g", 2.0, 5.0)]


def pairs(spark, n):
    rate = lambda i: (i % 10) / 5 + 0.1
    data = [(i // 2, f"O{i}", "g" if i % 2 else "h", 90.0 - (i % 10) * 5, float(i % 10), 500.0 - (i % 10), 50.0, 0.001, 1e-4, 10.0, 1.0, 3.0 if i % 3 else 0.1, 0.5, rate(i) * 10, rate(i), i % 3 > 0) for i in range(n)]
    names = "norad_catalog_id long, object_name string, source_group string, base_score double, element_age_hours_at_prediction double, mean_altitude_km_at_prediction double, inclination_degrees_at_prediction double, eccentricity_at_prediction double, bstar_at_prediction double, propagation_span_hours double, radial_km double, along_track_km double, cross_track_km double, total_km double, km_per_hour double, is_along_track_dominant boolean"
    return spark.createDataFrame(data, names).withColumn("reliability_class", F.when(F.col("base_score") >= 80, "high").when(F.col("base_score") >= 60, "moderate").otherwise("reduced"))


def test_backtest_tables(spark):
    p = pairs(spark, 40)
    bins = measure.validation_bins(p).collect()
    assert [b.reliability_class for b in bins] == ["high", "moderate", "reduced"] and sum(b.pair_count for b in bins) == 40
    none = spark.createDataFrame([], "measurement_quality string")
    got = {r.metric: r.value for r in measure.validation_stats(p, none).collect()}
    assert got["pairs"] == 40 and got["spearman_score_vs_total_km"] == -1.0 and got["drag_like_pairs"] == 26
    few = {r.metric for r in measure.validation_stats(p.where("NOT is_along_track_dominant"), none).collect()}
    assert "drag_like_pairs" not in few and "pairs" in few


def test_regression_beats_the_median_on_objects_it_has_not_seen(spark):
    p = pairs(spark, 120)
    r = model.scores(model.cross_validated(p, maxIter=10)).first()
    assert r.pairs == 120 and r.mae_log < r.mae_log_baseline and r.pooled_spearman > 0.8
    with pytest.raises(model.TooFewRows):
        model.cross_validated(pairs(spark, 10))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def drawn_pairs(spark, n):
    """Pairs whose features have some ten values each, and whose rates have no ties."""
    v = lambda i, k: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(k))
    columns = {c: v(i, 9 + i % 3).cast("double") for i, c in enumerate(model.FEATURES)}
    rows = spark.range(n).withColumns(columns | {"norad_catalog_id": v(20, n // 3), "source_group": F.concat(F.lit("g"), v(21, 3)), "base_score": v(22, 100).cast("double")})
    a, b, c = (F.col(x) for x in model.FEATURES[:3])
    return rows.withColumn("km_per_hour", a * b / 10 + F.when(F.col("source_group") == "g1", 2.0).otherwise(c / 5) + v(23, 100_003) / 200_000)


def test_boosting_of_all_folds_grows_the_trees_of_spark(spark):
    from pyspark.ml.regression import GBTRegressor

    rows = model.targets(drawn_pairs(spark, 1200)).repartition(3).localCheckpoint()
    settings = model.SETTINGS | {"maxIter": 12, "subsamplingRate": 1.0}
    made = boosting.predictions(rows, model.FEATURES, model.FOLDS, 2, **settings)
    got = {r.id: r.prediction for r in made.collect()}
    assert len(got) == 1200
    for fold in range(model.FOLDS):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        encode = model.encoder(train)
        want = GBTRegressor(labelCol="target", **settings).fit(encode.transform(train)).transform(encode.transform(test)).collect()
        assert want and max(abs(got[r.id] - r.prediction) for r in want) < 1e-9


def test_a_round_of_boosting_is_a_few_jobs_for_all_folds(spark):
    pairs, context = drawn_pairs(spark, 300).localCheckpoint(), spark.sparkContext

    def jobs(rounds):
        context.setJobGroup(f"rounds-{rounds}", "")
        model.cross_validated(pairs, maxIter=rounds)
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    assert jobs(7) - jobs(3) <= 4 * (1 + model.SETTINGS["maxDepth"])


def test_a_group_that_training_has_not_seen_is_encoded(spark):
    rows = model.targets(pairs(spark, 60))
    vectors = model.encoder(rows.where("source_group = 'g'")).transform(rows)
    assert {len(r.features) for r in vectors.select("features").collect()} == {len(model.FEATURES) + 2}


def test_training_summary(spark, tmp_path):
    import json

    score = spark.createDataFrame([(3, 0.5)], "pairs long, pooled_spearman double")
    model.write_summary(score, [("a", 0.75), ("b", 0.25)], str(tmp_path / "s.json"), str(tmp_path / "log"), maxIter=3)
    made = json.loads((tmp_path / "s.json").read_text())
    assert made["scores"] == {"pairs": 3, "pooled_spearman": 0.5} and made["settings"]["maxIter"] == 3 and made["importance"][0] == {"feature": "a", "importance": 0.75}
    assert json.loads((tmp_path / "log").read_text())["scores"] == made["scores"]
