"""Reshaping operators: long evidence, molecules of steps, lines of route texts, and the set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition_evidence(steps: DataFrame, key: str, numeric: dict[str, str], listed: dict[str, str]) -> DataFrame:
    """One row for each present number and for each item of each list of a step (UN1).

    ``numeric`` and ``listed`` map evidence types to columns. value_text holds any value; value_double only numbers.
    """
    item = "struct<evidence_type:string,position:int,value_text:string,value_double:double>"
    numbers = [F.struct(F.lit(kind).alias("evidence_type"), F.lit(0).alias("position"), F.col(c).cast("string").alias("value_text"), F.col(c).cast("double").alias("value_double")) for kind, c in numeric.items()]
    present = F.filter(F.array(*numbers).cast(f"array<{item}>"), lambda x: x["value_double"].isNotNull()) if numbers else F.array().cast(f"array<{item}>")

    def items(kind: str, c: str) -> Column:
        rows = F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("evidence_type"), i.alias("position"), x.alias("value_text"), F.lit(None).cast("double").alias("value_double"))).cast(f"array<{item}>")

    lists = [items(kind, c) for kind, c in listed.items()]
    return steps.select(key, F.explode(F.concat(present, *lists)).alias("e")).select(key, "e.*")


def role_positions(steps: DataFrame, key: str, roles: dict[str, str], known: Column | None = None) -> DataFrame:
    """(key, role, position, molecule): the molecules of each role's list, numbered among those that are in the array ``known``, if given (UN2, WN5)."""

    def numbered(role: str, column: str) -> Column:
        kept = F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: (x != "") if known is None else F.array_contains(known, x))
        return F.transform(kept, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("position"), x.alias("molecule")))

    parts = [numbered(role, column) for role, column in roles.items()]
    return steps.select(key, F.explode(F.concat(*parts)).alias("m")).select(key, "m.*")


def insert_missing(state: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``state`` and those fresh rows whose key it doesn't have, one for each key (ST2, Q1)."""
    new = fresh.dropDuplicates(key).join(state.select(*key), key, "left_anti")
    return state.unionByName(new, allowMissingColumns=True)


def latest_wins(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key (ST3, GV7)."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_catalogue(steps: DataFrame, lists: list[str], name: str = "molecule") -> DataFrame:
    """Each distinct non-empty item of the list columns once, so that costly functions run once an item (ST6)."""
    return steps.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])).alias(name)).where(F.col(name) != "").distinct()


def bond_difference(before: Column, after: Column) -> Column:
    """Struct (formed, broken, changed) of maps from bond to order (ST4)."""
    gained, lost = F.array_except(F.map_keys(after), F.map_keys(before)), F.array_except(F.map_keys(before), F.map_keys(after))
    both = F.array_intersect(F.map_keys(before), F.map_keys(after))
    changed = F.filter(both, lambda k: F.element_at(before, k) != F.element_at(after, k))
    return F.struct(F.sort_array(gained).alias("formed"), F.sort_array(lost).alias("broken"), F.sort_array(changed).alias("changed"))
