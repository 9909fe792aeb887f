"""Promotion of trained models by rules over their test metrics (ML10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Task, least macro-F1, least balanced accuracy, greatest calibration error, least accuracy over majority, stage.
RULES = (
    ("parse_validity", 0.90, 0.90, 0.08, 0.95, "production"),
    ("parse_failure_class", 0.70, 0.70, 0.10, 0.90, "production"),
    ("repairability", 0.72, 0.72, 0.10, 0.90, "production"),
    ("primary_solvent", 0.40, 0.40, 0.12, 0.90, "staging"),
    ("solvent_multilabel", 0.40, 0.40, 0.12, 0.90, "staging"),
    ("agent_presence", 0.60, 0.65, 0.12, 0.75, "screening"),
    ("agent_multilabel", 0.35, 0.35, 0.15, 0.75, "screening"),
    ("time_bucket", 0.35, 0.35, 0.12, 0.90, "experimental"),
    ("temperature_bucket", 0.45, 0.50, 0.12, 0.90, "experimental"),
    ("time_regression", 0.0, 0.0, 0.15, 0.0, "staging"),
    ("temperature_regression", 0.0, 0.0, 0.15, 0.0, "staging"),
    ("reaction_family", 0.70, 0.70, 0.10, 0.90, "production"),
)
#: Any other task.
DEFAULT_RULE = (0.60, 0.60, 0.10, 0.90, "validated")
MINIMUM_ROWS = 500


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "task string, min_macro_f1 double, min_balanced double, max_calibration double, min_ratio double, stage string")


def decide(metrics: DataFrame, rule: DataFrame) -> DataFrame:
    """Adds approved, final_stage and reasons to rows (task, rows, macro_f1, balanced_accuracy, accuracy, majority_accuracy, calibration).

    A null calibration isn't held against a model; a task without a rule gets DEFAULT_RULE.
    """
    names = ("min_macro_f1", "min_balanced", "max_calibration", "min_ratio", "stage")
    joined = metrics.join(F.broadcast(rule), "task", "left")
    joined = joined.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in zip(names, DEFAULT_RULE, strict=True)})
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rows") < MINIMUM_ROWS, F.lit("too_few_rows")),
            F.when(F.col("macro_f1") < F.col("min_macro_f1"), F.lit("macro_f1_below_rule")),
            F.when(F.col("balanced_accuracy") < F.col("min_balanced"), F.lit("balanced_accuracy_below_rule")),
            F.when((F.col("majority_accuracy") > 0) & (F.col("accuracy") / F.col("majority_accuracy") < F.col("min_ratio")), F.lit("no_gain_over_majority")),
            F.when(F.col("calibration") > F.col("max_calibration"), F.lit("calibration_above_rule")),
        )
    )
    fallback = F.when(F.col("stage").isin("production", "staging", "screening"), "candidate").otherwise("experimental")
    approved = F.size(reasons) == 0
    return joined.select(*metrics.columns, approved.alias("approved"), F.when(approved, F.col("stage")).otherwise(fallback).alias("final_stage"), reasons.alias("reasons"))
