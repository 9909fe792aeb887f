"""Training and scoring of the tasks' linear models, with support checks before and metrics after (ML2-ML8)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.scores import forward_target, inverse_target
from retort.ml import calibration, prefit
from retort.ml.features import FEATURES, hash_features
from retort.operators import aggregates

SPLITS = ("train", "val", "test")


@dataclass
class Trained:
    task: str
    trained: bool
    classes: list[str] = field(default_factory=list)
    models: list = field(default_factory=list)
    temperature: float = 1.0
    metrics: dict = field(default_factory=dict)
    reason: str | None = None
    size: int = FEATURES
    intervals: DataFrame | None = None


def _as_dict(frame: DataFrame) -> dict:
    row = frame.first()
    return row.asDict() if row else {}


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows over classes times the class's rows. The table of classes is as small as the label set."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_rows") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return train.join(F.broadcast(weights), label)


def train_classifier(rows: DataFrame, task: str, target: str, text: str, split: str = "split", minimum: int = 1, size: int = FEATURES, iterations: int = 20) -> Trained:
    """An elastic-net logistic model over hashed n-grams with class weights, its temperature from val and metrics of test.

    Labels with fewer than ``minimum`` training rows are left out. Without support nothing is fitted and the reason is given.
    """
    known = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label"), F.col(text).alias("text"), F.col(split).alias("split"))
    support = aggregates.label_support(known, "label", "split").where(F.col("train") >= minimum)
    verdict = _as_dict(prefit.classification_support(support, "label", minimum))
    if not verdict["trainable"]:
        return Trained(task, False, reason=verdict["reason"], size=size)
    classes = sorted(r["label"] for r in support.select("label").collect())
    index = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    data = hash_features(known.where(F.col("label").isin(classes)), "text", size=size).withColumn("y", F.element_at(index, F.col("label")))
    train = balanced_weights(data.where("split = 'train'"), "y")
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1e-5, elasticNetParam=0.05, maxIter=iterations, family="multinomial").fit(train)
    scored = model.transform(data.where("split <> 'train'")).select("split", F.col("y").cast("int").alias("truth"), vector_to_array("probability").alias("probabilities")).persist()
    try:
        temperature = calibration.fit_temperature(scored.where("split = 'val'"))
        metrics = {}
        for name in ("val", "test"):
            part = scored.where(F.col("split") == name).withColumn("probabilities", calibration.scaled(F.col("probabilities"), temperature))
            part = part.withColumn("confidence", F.array_max("probabilities")).withColumn("said", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
            found = _as_dict(aggregates.classification_metrics(part, "truth", "said"))
            found |= _as_dict(aggregates.expected_calibration_error(aggregates.reliability_bins(part, "confidence", F.col("said") == F.col("truth"))))
            found["log_loss"] = calibration.log_loss(part, "probabilities", "truth", [1.0])[0]
            metrics[name] = found
    finally:
        scored.unpersist()
    return Trained(task, True, classes, [model], temperature, metrics, size=size)


def predict_classes(trained: Trained, rows: DataFrame, text: str, top: int = 5) -> DataFrame:
    """Adds ``predictions``: the best classes with calibrated probabilities, best first (SL6)."""
    scored = trained.models[0].transform(hash_features(rows, text, size=trained.size))
    p = calibration.scaled(vector_to_array("probability"), trained.temperature)
    names = F.array(*[F.lit(c) for c in trained.classes])
    pairs = F.zip_with(p, names, lambda x, n: F.struct(x.alias("probability"), n.alias("label")))
    best = F.slice(F.reverse(F.array_sort(pairs)), 1, top)
    return scored.withColumn("predictions", best).drop("features", "rawPrediction", "probability", "prediction")


def train_multilabel(rows: DataFrame, task: str, target: str, text: str, split: str = "split", minimum: int = 50, most: int = 48, top: int = 5, size: int = FEATURES, iterations: int = 20) -> Trained:
    """One binary model for each supported label over shared features, with ranking and label metrics of test (ML3, ML5, ML7)."""
    known = rows.where(F.size(target) > 0).select(F.monotonically_increasing_id().alias("id"), F.col(target).alias("labels"), F.col(text).alias("text"), F.col(split).alias("split"))
    totals = known.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_total") for s in SPLITS])
    counts = aggregates.label_support(known.select(F.explode(F.array_distinct("labels")).alias("label"), "split"), "label", "split").drop("total").crossJoin(F.broadcast(totals))
    kept = [r["label"] for r in prefit.multilabel_support(counts, "label", minimum).where("retained").orderBy(F.desc("train"), "label").limit(most).collect()]
    if not kept:
        return Trained(task, False, reason="multilabel_no_valid_binary_targets", size=size)
    data = hash_features(known, "text", size=size).persist()
    models, scored = [], data.where("split = 'test'").select("id", "labels", "features")
    try:
        for i, label in enumerate(kept):
            binary = data.withColumn("y", F.array_contains("labels", label).cast("double")).where("split = 'train'")
            models.append(LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1e-5, elasticNetParam=0.05, maxIter=iterations, probabilityCol=f"_p{i}", rawPredictionCol=f"_r{i}", predictionCol=f"_c{i}").fit(balanced_weights(binary, "y")))
            scored = models[-1].transform(scored).withColumn(f"s{i}", vector_to_array(f"_p{i}")[1]).drop(f"_p{i}", f"_r{i}", f"_c{i}")
        long = scored.select("id", "labels", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"s{i}").alias("score")) for i, c in enumerate(kept)])).alias("x")).select("id", "labels", "x.*")
        long = long.withColumn("relevant", F.array_contains("labels", F.col("label"))).persist()
        said = long.groupBy("id").agg(F.collect_list(F.when(F.col("relevant"), F.col("label"))).alias("t"), F.collect_list(F.when(F.col("score") >= 0.5, F.col("label"))).alias("p"))
        metrics = _as_dict(aggregates.multilabel_metrics(said, "t", "p")) | _as_dict(aggregates.label_ranking_precision(long, "id", "label", "score", "relevant"))
        long.unpersist()
    finally:
        data.unpersist()
    gate = (metrics.get("rows") or 0) >= 500 and (metrics.get("micro_f1") or 0) >= 0.40 and (metrics.get("lrap") or 0) >= 0.45
    return Trained(task, True, kept, models, metrics={"test": metrics, "gate": gate, "top": top}, size=size)


def train_regression(rows: DataFrame, task: str, target: str, text: str, transform: str = "identity", family: str = "reaction_family", split: str = "split", size: int = FEATURES, iterations: int = 30) -> Trained:
    """A Huber regression with residual intervals for all and for families with enough rows (ML4, A23, A24)."""
    known = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("value"), F.col(text).alias("text"), F.col(split).alias("split"), F.coalesce(F.col(family), F.lit("unknown")).alias("family"))
    data = hash_features(known, "text", size=size).withColumn("y", forward_target(F.col("value"), transform))
    counts = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    if any(not counts.get(s) for s in SPLITS):
        return Trained(task, False, reason="empty_split", size=size)
    model = LinearRegression(featuresCol="features", labelCol="y", loss="huber", regParam=1e-3, maxIter=iterations).fit(data.where("split = 'train'"))
    scored = model.transform(data.where("split <> 'train'")).select("split", "family", "value", inverse_target(F.col("prediction"), transform).alias("predicted")).persist()
    try:
        intervals = aggregates.residual_intervals(scored.where("split = 'val'").withColumn("residual", F.col("value") - F.col("predicted")), "family", "residual")
        bounded = with_intervals(scored.where("split = 'test'"), intervals, "family", "predicted", transform)
        metrics = _as_dict(aggregates.regression_metrics(bounded, "value", "predicted", "low", "high"))
        spark = rows.sparkSession
        fixed = spark.createDataFrame(intervals.collect(), intervals.schema)
    finally:
        scored.unpersist()
    gate = (metrics.get("rows") or 0) >= 500 and (metrics.get("coverage") or 0) >= 0.70
    return Trained(task, True, models=[model], metrics={"test": metrics, "gate": gate}, size=size, intervals=fixed)


def with_intervals(rows: DataFrame, intervals: DataFrame, family: str, predicted: str, transform: str = "identity") -> DataFrame:
    """Adds low and high from the family's residual interval, else the global one; low is at least 0 for log targets (ML14)."""
    own = F.broadcast(intervals.select(F.col("family").alias(family), F.col("low").alias("_l"), F.col("high").alias("_h")))
    everywhere = F.broadcast(intervals.where("family = '__global__'").select(F.col("low").alias("_gl"), F.col("high").alias("_gh")))
    joined = rows.join(own, family, "left").crossJoin(everywhere)
    low = F.col(predicted) + F.coalesce("_l", "_gl")
    return joined.withColumn("low", F.greatest(low, F.lit(0.0)) if transform == "log1p" else low).withColumn("high", F.col(predicted) + F.coalesce("_h", "_gh")).drop("_l", "_h", "_gl", "_gh")


def save(trained: Trained, folder: str) -> None:
    """Writes the models under a folder and a card with everything else as one row of JSON (SC16)."""
    for i, model in enumerate(trained.models):
        model.write().overwrite().save(f"{folder}/model-{i:03d}")
    if trained.intervals is not None:
        trained.intervals.write.mode("overwrite").parquet(f"{folder}/intervals")
    card = {k: getattr(trained, k) for k in ("task", "trained", "classes", "temperature", "metrics", "reason", "size")}
    card["parts"] = {"models": len(trained.models)} | ({"intervals": True} if trained.intervals is not None else {})
    SparkSession.active().createDataFrame([(json.dumps(card, sort_keys=True, default=str),)], "card string").coalesce(1).write.mode("overwrite").text(f"{folder}/card")


def load(spark: SparkSession, folder: str) -> Trained:
    """What ``save`` wrote."""
    card = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/card").collect()))
    parts = card.pop("parts")
    trained = Trained(**card)
    kind = LinearRegressionModel if "intervals" in parts else LogisticRegressionModel
    trained.models = [kind.load(f"{folder}/model-{i:03d}") for i in range(parts["models"])]
    if "intervals" in parts:
        trained.intervals = spark.read.parquet(f"{folder}/intervals")
    return trained


def label_probabilities(trained: Trained, rows: DataFrame, text: str, key: str = "query_id") -> DataFrame:
    """(key, label, probability) of each row and label: calibrated class probabilities, or each label's own for several labels."""
    hashed = hash_features(rows.select(key, text), text, size=trained.size)
    if len(trained.models) == 1 and len(trained.classes) > 1:
        values = calibration.scaled(vector_to_array("probability"), trained.temperature)
        scored = trained.models[0].transform(hashed).select(key, values.alias("p"))
    else:
        scored, parts = hashed, []
        for i, model in enumerate(trained.models):  # each names its columns by its number
            scored = model.transform(scored)
            parts.append(vector_to_array(f"_p{i}")[1])
        scored = scored.select(key, F.array(*parts).alias("p"))
    pairs = F.zip_with("p", F.array(*[F.lit(c) for c in trained.classes]), lambda x, n: F.struct(n.alias("label"), x.alias("probability")))
    return scored.select(key, F.inline(pairs))


def predict_value(trained: Trained, rows: DataFrame, text: str, family: str, transform: str = "identity") -> DataFrame:
    """Adds predicted, low and high to rows with a text and a family (ML14)."""
    scored = trained.models[0].transform(hash_features(rows, text, size=trained.size))
    scored = scored.withColumn("predicted", inverse_target(F.col("prediction"), transform)).drop("features", "prediction")
    return with_intervals(scored, trained.intervals, family, "predicted", transform)
