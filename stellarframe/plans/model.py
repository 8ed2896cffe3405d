"""The regression of disagreement rate on what was known at prediction time, checked on objects it has not seen."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import stats
from ..session import new_folder
from ..sources import sinks
from . import boosting

FEATURES = ("element_age_hours_at_prediction", "mean_altitude_km_at_prediction", "inclination_degrees_at_prediction", "eccentricity_at_prediction", "bstar_at_prediction", "propagation_span_hours")
FOLDS = 5
MIN_ROWS = 30
PARTITION_ROWS = 100_000
SETTINGS = {"maxIter": 150, "maxDepth": 3, "minInstancesPerNode": 8, "stepSize": 0.05, "subsamplingRate": 0.9, "seed": 42}


class TooFewRows(ValueError):
    """Not enough pairs to train on; callers skip the step."""


def targets(pairs: DataFrame) -> DataFrame:
    """The log of the rate and a fold by object; a null feature is 0, a null group is empty."""
    rows = pairs.where("km_per_hour IS NOT NULL").withColumn("target", F.log1p("km_per_hour"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("norad_catalog_id"), F.lit(FOLDS)).cast("int")).fillna(0.0, list(FEATURES)).fillna("", ["source_group"])


def encoder(train: DataFrame) -> PipelineModel:
    """Vectors of the features and of the groups that `train` has; another group has none of them."""
    index = StringIndexer(inputCol="source_group", outputCol="group_index", handleInvalid="keep")
    group = OneHotEncoder(inputCol="group_index", outputCol="group_vector", handleInvalid="keep")
    return Pipeline(stages=[index, group, VectorAssembler(inputCols=[*FEATURES, "group_vector"], outputCol="features")]).fit(train)


def cross_validated(pairs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Each pair with the prediction of a model, and the median, of the other objects' pairs; folds are trained side by side.

    The pairs and the predictions are written once, below `folder` (a new one unless given), and read from there. A task has
    about PARTITION_ROWS pairs, of some 85 bytes each for all folds, so that what boosting keeps of them is some MB a task.
    """
    spark, folder = pairs.sparkSession, folder or new_folder(pairs.sparkSession, "regression")
    targets(pairs).write.mode("overwrite").parquet(f"{folder}/pairs")
    rows = spark.read.parquet(f"{folder}/pairs")
    n = rows.count()
    if n < MIN_ROWS:
        raise TooFewRows(f"{n} pairs; {MIN_ROWS} are needed")
    others = F.explode(F.array(*map(F.lit, range(FOLDS)))).alias("other")
    medians = stats.quantiles(rows.select("fold", "target", others).where("other <> fold"), ["other"], {"baseline": ("target", 0.5)})
    made = boosting.predictions(rows, FEATURES, FOLDS, -(-n // PARTITION_ROWS), **(SETTINGS | settings))
    # a fold without pairs of other objects has no median, and no model
    made = made.join(F.broadcast(medians.withColumnRenamed("other", "fold")), "fold")  # FOLDS rows
    made.select("norad_catalog_id", "fold", "base_score", "km_per_hour", "target", "prediction", "baseline").write.mode("overwrite").parquet(f"{folder}/predicted")
    return spark.read.parquet(f"{folder}/predicted")


def scores(predicted: DataFrame) -> DataFrame:
    """One row: pooled and mean rank correlations, errors of the model and of the median, in logs and in km/h."""
    e = lambda c: F.col("target") - F.col(c)
    r = X.round_half_up
    errors = predicted.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("norad_catalog_id").alias("objects"), r(F.avg(F.abs(e("prediction"))), 4).alias("mae_log"), r(F.avg(F.abs(e("baseline"))), 4).alias("mae_log_baseline"), r(F.sqrt(F.avg(e("prediction") ** 2)), 4).alias("rmse_log"), r(F.sqrt(F.avg(e("baseline") ** 2)), 4).alias("rmse_log_baseline"), r(F.avg(F.abs(F.col("km_per_hour") - F.expm1("prediction"))), 4).alias("mae_km_per_hour"))
    # all correlations are ranked in one pass; a fold without two pairs has one of 0
    series = {"pooled": ("prediction", "target", "true"), "index": ("base_score", "target", "true"), **{f"fold{k}": ("prediction", "target", f"fold = {k}") for k in range(FOLDS)}}
    one = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("rho"))), F.lit(0.0))
    rho = stats.spearman_many(predicted, series).agg(
        r(one("pooled"), 4).alias("pooled_spearman"), r(sum((one(f"fold{k}") for k in range(FOLDS)), F.lit(0.0)) / FOLDS, 4).alias("mean_fold_spearman"), r(one("index"), 4).alias("index_spearman"),
    )
    return errors.crossJoin(F.broadcast(rho))  # one row each


def train(pairs: DataFrame, path: str | None = None, **settings):
    """A model of all pairs, saved below `path`, and the importance of each feature."""
    rows = targets(pairs)
    encode = encoder(rows)
    model = GBTRegressor(labelCol="target", **(SETTINGS | settings)).fit(encode.transform(rows))
    if path:
        model.write().overwrite().save(path)
    names = [*FEATURES, *[f"group_{i}" for i in range(len(model.featureImportances) - len(FEATURES))]]
    return model, sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def write_summary(score: DataFrame, importance: list[tuple[str, float]], path: str, run_log: str | None = None, **settings) -> dict:
    """The training's figures as JSON, and a line in a log of training runs."""
    (row,) = score.collect()  # one row
    summary = {"trained_at_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "settings": SETTINGS | settings, "folds": FOLDS, "features": list(FEATURES), "scores": row.asDict(), "importance": [{"feature": n, "importance": round(v, 6)} for n, v in importance]}
    Path(path).write_text(json.dumps(summary, indent=1, sort_keys=True), encoding="utf-8")
    if run_log:
        sinks.append_json_line(run_log, {"run_id": uuid.uuid4().hex, "summary": path, **summary})
    return summary
