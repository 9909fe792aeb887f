"""Support checks before a fit (ML6, ML7): rules over the label-by-split counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_support(support: DataFrame, label: str, minimum: int = 1) -> DataFrame:
    """One row (classes, trainable, reason) from (label, train, val, test) counts.

    At least two labels with ``minimum`` training rows, rows in val and test, and for two labels both in every split.
    """
    kept = support.where(F.col("train") >= minimum)
    found = kept.agg(
        F.count("*").alias("classes"),
        F.coalesce(F.sum("val"), F.lit(0)).alias("val"),
        F.coalesce(F.sum("test"), F.lit(0)).alias("test"),
        F.count_if((F.col("val") > 0) & (F.col("test") > 0)).alias("complete"),
    )
    reason = (
        F.when(F.col("classes") < 2, "fewer_than_two_train_classes")
        .when((F.col("val") == 0) | (F.col("test") == 0), "empty_evaluation_split")
        .when((F.col("classes") == 2) & (F.col("complete") < 2), "binary_class_missing_in_split")
    )
    return found.select("classes", reason.isNull().alias("trainable"), reason.alias("reason"))


def multilabel_support(support: DataFrame, label: str, minimum: int) -> DataFrame:
    """Adds retained and reason to (label, train, val, test) counts of positives, given that each row has one label or that
    totals train_total, val_total and test_total are columns.
    """
    splits = ("train", "val", "test")
    if "train_total" not in support.columns:
        totals = support.agg(*[F.sum(s).alias(f"{s}_total") for s in splits])
        support = support.crossJoin(F.broadcast(totals))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("train") < minimum, F.lit("train_positives_below_minimum")),
            F.when(F.col("train_total") - F.col("train") < minimum, F.lit("train_negatives_below_minimum")),
            *[F.when(F.col(s) < 1, F.lit(f"{s}_without_positive")) for s in ("val", "test")],
            *[F.when(F.col(f"{s}_total") - F.col(s) < 1, F.lit(f"{s}_without_negative")) for s in ("val", "test")],
        )
    )
    return support.select(label, *splits, (F.size(reasons) == 0).alias("retained"), reasons.alias("reasons"))
