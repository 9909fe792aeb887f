"""The condition anomaly model: robust statistics of families from training rows, and scores against them (A16, ML15, B8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators import aggregates

FIELDS = ("temperature_c", "time_h")
HIGH_Z = 6.0


def fit(steps: DataFrame, family: str = "reaction_family", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, family, n, median, mad, q01, q99) of eligible training rows; ``__global__`` is for all."""
    rows = steps.where("split = 'train'")
    out = None
    for f in fields:
        one = aggregates.robust_stats(rows, family, f).select(F.lit(f).alias("field"), F.col(family).alias("family"), "n", "median", "mad", "q01", "q99")
        out = one if out is None else out.unionByName(one)
    return out


def score(steps: DataFrame, model: DataFrame, family: str = "reaction_family", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Adds anomaly_score (the worst field's) and anomaly_reasons. A family that the model doesn't know is held against all."""
    parts, reasons, rows = [], [], steps.withColumn("_family", F.coalesce(F.col(family), F.lit("unknown")))
    for f in fields:
        mine = model.where(F.col("field") == f)
        own = mine.select(F.col("family").alias("_family"), F.struct("median", "mad", "q01", "q99").alias(f"_own_{f}"))
        everywhere = mine.where("family = '__global__'").select(F.struct("median", "mad", "q01", "q99").alias(f"_all_{f}"))
        rows = rows.join(F.broadcast(own), "_family", "left").join(F.broadcast(everywhere), how="left")
        s = F.coalesce(f"_own_{f}", f"_all_{f}")
        value = F.col(f)
        parts.append(aggregates.anomaly_score(value, s["median"], s["mad"], s["q01"], s["q99"]))
        z = F.abs(value - s["median"]) / (F.lit(1.4826) * s["mad"])
        reasons.append(F.when((value < s["q01"]) | (value > s["q99"]), F.lit(f"{f}_outside_family_quantiles")))
        reasons.append(F.when(z > HIGH_Z, F.lit(f"{f}_high_robust_z")))
    worst = F.coalesce(F.array_max(F.array(*parts)), F.lit(0.0))
    drop = ["_family"] + [f"{p}_{f}" for f in fields for p in ("_own", "_all")]
    return rows.withColumn("anomaly_score", worst).withColumn("anomaly_reasons", F.array_compact(F.array(*reasons))).drop(*drop)
