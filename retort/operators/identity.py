"""Identity operators: duplicate keys, first-seen contents, instance numbers and one-to-one assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_instances(frame: DataFrame, key: str, order: list[Column], uid: str = "route_instance_id") -> DataFrame:
    """Adds instance_no from 1 per key and an id: the key, suffixed from the second instance on."""
    ranked = frame.withColumn("instance_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    suffixed = F.format_string("%s::instance::%03d", F.col(key).cast("string"), F.col("instance_no"))
    return ranked.withColumn(uid, F.when(F.col("instance_no") == 1, F.col(key).cast("string")).otherwise(suffixed))


def suffix_repeated_keys(frame: DataFrame, key: Column, content: Column, order: list[Column], name: str = "step_id") -> DataFrame:
    """Adds a unique text key: the first row of a key has it plain, later ones with a content hash, then a count.

    Rows of one key with equal content get the same hash, so the second such row on also bears its number.
    """
    keyed = frame.withColumn("_key", key).withColumn("_hash", F.substring(F.sha2(content, 256), 1, 8))
    within, same = Window.partitionBy("_key").orderBy(*order), Window.partitionBy("_key", "_hash").orderBy(*order)
    numbered = keyed.withColumn("_n", F.row_number().over(within)).withColumn("_m", F.row_number().over(same))
    suffix = F.concat(F.col("_key"), F.lit("::v"), F.col("_hash"))
    made = F.when(F.col("_n") == 1, F.col("_key")).when(F.col("_m") == 1, suffix).otherwise(F.concat(suffix, F.lit("::"), F.col("_m").cast("string")))
    return numbered.withColumn(name, made).drop("_key", "_hash", "_n", "_m")


def first_seen(frame: DataFrame, key: str, content: Column, order: list[Column]) -> DataFrame:
    """Adds content_status per row of a key: first, exact_duplicate of the first, or conflict with it."""
    window = Window.partitionBy(key).orderBy(*order)
    marked = frame.withColumn("_hash", content).withColumn("_first", F.first("_hash").over(window)).withColumn("_n", F.row_number().over(window))
    status = F.when(F.col("_n") == 1, "first").when(F.col("_hash") == F.col("_first"), "exact_duplicate").otherwise("conflict")
    return marked.withColumn("content_status", status).drop("_hash", "_first", "_n")


def unique_keys(frame: DataFrame, key: str) -> DataFrame:
    """Keys with one row (A2)."""
    return frame.groupBy(key).agg(F.count("*").alias("rows")).where("rows = 1").select(key)


def repeated_keys(frame: DataFrame, key: str) -> DataFrame:
    """Keys with more rows, and how many (A2, A4)."""
    return frame.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def rank_pairs(left: DataFrame, right: DataFrame, on: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """One-to-one matches of equal keys: the n-th left row of a key with the n-th right row (J5, exact tier).

    Skewed keys only lengthen their own window; no pair is made that isn't returned.
    """
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*right_order)))
    return a.join(b, [*on, "_n"]).drop("_n")


ASSIGNED = "source_route_id string, route_instance_id string, step_row long, step_index int, method string, confidence double"


def _assign_group(key: tuple, steps: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    """Greedy assignment of a duplicate group: instances in order; of each line exact, then index, then text."""
    free = {int(r.step_row): (int(r.step_index), r.step_text) for r in steps.sort_values(["step_index", "step_row"]).itertuples()}
    out = []
    for line in lines.sort_values(["route_order", "line_no"]).itertuples():
        exact = [row for row, (at, text) in free.items() if at == line.line_no and text == line.line]
        at_index = [row for row, (at, _) in free.items() if at == line.line_no]
        same_text = [row for row, (_, text) in free.items() if text == line.line]
        if exact:
            row, method, confidence = exact[0], "exact_route_text_match", 1.0
        elif len(at_index) == 1:
            row, method, confidence = at_index[0], "unique_step_index_match", 0.90
        elif same_text:
            row, method, confidence = same_text[0], "exact_step_text_match", 0.85
        else:
            row, method, confidence = None, "unassigned_line", 0.0
        if row is not None:
            del free[row]
        out.append((key[0], line.route_instance_id, row, int(line.line_no), method, confidence))
    columns = ["source_route_id", "route_instance_id", "step_row", "step_index", "method", "confidence"]
    frame = pd.DataFrame(out, columns=columns)
    frame["step_row"] = frame["step_row"].astype("Int64")
    return frame


def assign_steps(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """Steps of source routes to route instances, by two paths.

    steps: source_route_id, step_row, step_index, step_text. instances: source_route_id, route_instance_id, route_order,
    text, step_count. A source route with one instance takes its steps by an equi-join; only the others go
    through the greedy match, one group (a route's few instances) at a time. Lines whose number differs from
    step_count are reported as ``line_count_mismatch`` with a null step.
    """
    from retort.functions.parsing import text_lines

    counted = instances.groupBy("source_route_id").agg(F.count("*").alias("_instances"))
    tagged = instances.join(counted, "source_route_id")
    single = tagged.where("_instances = 1").select("source_route_id", "route_instance_id")
    plain = steps.join(single, "source_route_id").select(
        "source_route_id", "route_instance_id", "step_row", F.col("step_index").cast("int").alias("step_index"), F.lit("unique_source_route").alias("method"), F.lit(1.0).alias("confidence")
    )
    several = tagged.where("_instances > 1").withColumn("_lines", text_lines(F.col("text")))
    wrong = several.where(F.size("_lines") != F.col("step_count")).select(
        "source_route_id", "route_instance_id", F.lit(None).cast("long").alias("step_row"), F.lit(None).cast("int").alias("step_index"), F.lit("line_count_mismatch").alias("method"), F.lit(0.0).alias("confidence")
    )
    lines = several.where(F.size("_lines") == F.col("step_count")).select("source_route_id", "route_instance_id", "route_order", F.posexplode("_lines").alias("line_no", "line"))
    mine = steps.join(lines.select("source_route_id").distinct(), "source_route_id", "left_semi").select("source_route_id", "step_row", "step_index", "step_text")
    matched = mine.groupBy("source_route_id").cogroup(lines.groupBy("source_route_id")).applyInPandas(_assign_group, ASSIGNED)
    return plain.unionByName(matched).unionByName(wrong)


def assignment_audit(steps: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of counts: assigned steps, unassigned steps, lines without a step, steps assigned twice, by anti-join."""
    done = assigned.where("step_row is not null")
    left = steps.join(done.select("source_route_id", "step_row"), ["source_route_id", "step_row"], "left_anti").agg(F.count("*").alias("unassigned_steps"))
    twice = done.groupBy("source_route_id", "step_row").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_assignments"))
    totals = assigned.agg(F.count("step_row").alias("assigned_steps"), F.count_if(F.col("step_row").isNull()).alias("failed_lines"), F.countDistinct("route_instance_id").alias("route_instances"))
    return totals.crossJoin(left).crossJoin(twice)
