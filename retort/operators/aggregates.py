"""Aggregation operators: counters, distributions, robust statistics, leakage membership and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(frame: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the count of rows for which each condition holds, in one pass."""
    return frame.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def histogram_with_total(frame: DataFrame, key: str) -> DataFrame:
    """(key, rows) with a row ``__total__`` (A5)."""
    return frame.rollup(key).agg(F.count("*").alias("rows"), F.grouping(key).alias("_g")).select(F.when(F.col("_g") == 1, "__total__").otherwise(F.col(key)).alias(key), "rows")


def distribution_map(frame: DataFrame, group: str, label: str) -> DataFrame:
    """(group, distribution, total): a map of label to count for each group (A11). Null labels aren't counted."""
    counted = frame.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), F.col("n")))))
    return counted.groupBy(group).agg(entries.alias("distribution"), F.sum("n").alias("total"))


def membership(frame: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): the sorted set of splits that each key occurs in; a set has three members at most."""
    pairs = frame.where(F.col(key).isNotNull()).select(key, split).distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits"))


def overlap_counts(members: DataFrame, pairs: tuple[tuple[str, str], ...] = (("train", "val"), ("train", "test"), ("val", "test"))) -> DataFrame:
    """One row: keys, keys in more than one split, and for each pair of splits the keys in both."""
    both = [F.count_if(F.array_contains("splits", a) & F.array_contains("splits", b)).alias(f"{a}_{b}") for a, b in pairs]
    return members.agg(F.count("*").alias("keys"), F.count_if(F.size("splits") > 1).alias("overlapping"), *both)


def robust_stats(frame: DataFrame, group: str, value: str, floor: float = 1e-6) -> DataFrame:
    """(group, n, median, mad, q01, q99) for each group and for all as ``__global__``.

    Exact percentiles with linear interpolation. A null group counts as ``unknown``. The second pass takes each value's distance from
    its group's median, which is joined as a small table.
    """
    rows = frame.where(F.col(value).isNotNull()).select(F.coalesce(F.col(group), F.lit("unknown")).alias("g"), F.col(value).cast("double").alias("v"))
    both = rows.select(F.explode(F.array("g", F.lit("__global__"))).alias("g"), "v")
    centre = both.groupBy("g").agg(F.count("*").alias("n"), F.expr("percentile(v, array(0.5, 0.01, 0.99))").alias("p"))
    spread = both.join(F.broadcast(centre.select("g", F.col("p")[0].alias("m"))), "g").groupBy("g").agg(F.expr("percentile(abs(v - m), 0.5)").alias("d"))
    return centre.join(spread, "g").select(
        F.col("g").alias(group), "n", F.col("p")[0].alias("median"), F.greatest(F.col("d"), F.lit(floor)).alias("mad"), F.col("p")[1].alias("q01"), F.col("p")[2].alias("q99")
    )


def anomaly_score(value: Column, median: Column, mad: Column, q01: Column, q99: Column) -> Column:
    """min(1, robust z / 8 + .25 outside the quantiles) (ML15); null for a null value."""
    z = F.abs(value - median) / (F.lit(1.4826) * mad)
    return F.when(z.isNotNull(), F.least(F.lit(1.0), z / 8 + F.when((value < q01) | (value > q99), 0.25).otherwise(0.0)))


def label_support(frame: DataFrame, label: str, split: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(label, train, val, test, total): rows of each label in each split."""
    counts = [F.count_if(F.col(split) == s).alias(s) for s in splits]
    return frame.where(F.col(label).isNotNull()).groupBy(label).agg(*counts, F.count("*").alias("total"))


def neighbour_distribution(evidence: DataFrame, query: str, label: str, score: str) -> DataFrame:
    """(query, label, share) of score-weighted neighbour labels (A18); missing labels aren't counted."""
    text = F.trim(F.col(label).cast("string"))
    rows = evidence.where(text.isNotNull() & ~F.lower(text).isin("", "nan")).select(query, F.col(label), F.greatest(F.col(score), F.lit(1e-6)).alias("w"))
    summed = rows.groupBy(query, label).agg(F.sum("w").alias("w"))
    return summed.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(query))).drop("w")


def mean_vectors(frame: DataFrame, group: str, vector: str, normalise: bool = True) -> DataFrame:
    """(group, n, vector): the mean of the group's vectors, of unit length if asked.

    Components are summed with partial aggregation, so a group of any size moves one row a task and component.
    """
    long = frame.select(group, F.posexplode(vector).alias("i", "x"))
    sums = long.groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    packed = sums.groupBy(group).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("m")))).alias("p"))
    means = F.transform("p", lambda x: x["m"])
    size = F.sqrt(F.aggregate(means, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(means, lambda x: F.when(size > 0, x / size).otherwise(0.0))
    return packed.select(group, "n", (unit if normalise else means).alias("vector"))


def classification_metrics(frame: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: rows, accuracy, balanced_accuracy, macro_f1, weighted_f1, majority_accuracy.

    From the confusion counts, which are as many as pairs of labels.
    """
    cells = frame.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    label = cells.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said")).union(
        cells.select(F.col("p"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("n"))
    )
    each = label.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("is").alias("is"), F.sum("said").alias("said"))
    f1 = F.when(F.col("is") + F.col("said") > 0, 2 * F.col("hit") / (F.col("is") + F.col("said"))).otherwise(0.0)
    return each.agg(
        F.sum("is").alias("rows"),
        (F.sum("hit") / F.sum("is")).alias("accuracy"),
        F.avg(F.when(F.col("is") > 0, F.col("hit") / F.col("is"))).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("is")) / F.sum("is")).alias("weighted_f1"),
        (F.max("is") / F.sum("is")).alias("majority_accuracy"),
    )


def reliability_bins(frame: DataFrame, confidence: str, correct: Column, bins: int = 15) -> DataFrame:
    """(bin, rows, accuracy, confidence) over equal bins of the confidence, the last closed."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return frame.groupBy(at.alias("bin")).agg(F.count("*").alias("rows"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))


def expected_calibration_error(binned: DataFrame) -> DataFrame:
    return binned.agg((F.sum(F.col("rows") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("rows")).alias("ece"))


def brier_and_log_loss(frame: DataFrame, probability: str, truth: str) -> DataFrame:
    """One row (rows, brier, log_loss) of a binary probability; clipped to [1e-12, 1 - 1e-12]."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col(truth).cast("double")
    return frame.agg(F.count("*").alias("rows"), F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def regression_metrics(frame: DataFrame, truth: str, predicted: str, low: str, high: str) -> DataFrame:
    """One row: rows, mae, median_ae, r2, coverage, mean_width."""
    error = F.abs(F.col(truth) - F.col(predicted))
    n, s, ss = F.count("*"), F.sum(truth), F.sum(F.col(truth) * F.col(truth))
    return frame.agg(
        n.alias("rows"),
        F.avg(error).alias("mae"),
        F.expr(f"percentile(abs({truth} - {predicted}), 0.5)").alias("median_ae"),
        (1 - F.sum(error * error) / (ss - s * s / n)).alias("r2"),
        F.avg(F.col(truth).between(F.col(low), F.col(high)).cast("double")).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("mean_width"),
    )


def residual_intervals(frame: DataFrame, family: str, residual: str, minimum: int = 30) -> DataFrame:
    """(family, rows, low, high): the .10 and .90 quantiles of the residual for all and for each family with enough rows."""
    both = frame.select(F.explode(F.array(F.lit("__global__"), F.coalesce(F.col(family), F.lit("unknown")))).alias(family), residual)
    found = both.groupBy(family).agg(F.count("*").alias("rows"), F.expr(f"percentile({residual}, array(0.1, 0.9))").alias("q"))
    return found.where((F.col("rows") >= minimum) | (F.col(family) == "__global__")).select(family, "rows", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def multilabel_metrics(frame: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row from arrays of true and predicted labels: micro precision, recall and F1, and macro F1."""
    shared = F.size(F.array_intersect(truth, predicted))
    micro = frame.agg(F.sum(shared).alias("tp"), F.sum(F.size(predicted)).alias("said"), F.sum(F.size(truth)).alias("are"))
    labels = frame.select(F.explode(F.transform(F.array_union(truth, predicted), lambda x: F.struct(x.alias("label"), F.array_contains(F.col(truth), x).alias("t"), F.array_contains(F.col(predicted), x).alias("p")))).alias("x")).select("x.*")
    each = labels.groupBy("label").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if("t").alias("are"), F.count_if("p").alias("said"))
    macro = each.agg(F.avg(2 * F.col("tp") / (F.col("are") + F.col("said"))).alias("macro_f1"), F.count("*").alias("labels"))
    return micro.crossJoin(macro).select(
        "labels", (F.col("tp") / F.nullif(F.col("said"), F.lit(0))).alias("micro_precision"), (F.col("tp") / F.nullif(F.col("are"), F.lit(0))).alias("micro_recall"), (2 * F.col("tp") / F.nullif(F.col("said") + F.col("are"), F.lit(0))).alias("micro_f1"), "macro_f1"
    )


def label_ranking_precision(frame: DataFrame, row: str, label: str, score: str, relevant: str) -> DataFrame:
    """One row (rows, lrap): label-ranking average precision over rows with a relevant label (A21). Ties rank together."""
    within = Window.partitionBy(row)
    up_to = within.orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    ranked = frame.withColumn("_rank", F.count("*").over(up_to)).withColumn("_hits", F.sum(F.col(relevant).cast("int")).over(up_to))
    each = ranked.where(F.col(relevant)).groupBy(row).agg(F.avg(F.col("_hits") / F.col("_rank")).alias("ap"))
    return each.agg(F.count("*").alias("rows"), F.avg("ap").alias("lrap"))
