"""Reaction strings as columns: sides, parse classes and atom-map checks that need no chemistry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.functions.parsing import PLACEHOLDER


def split_side(c: Column) -> Column:
    """The trimmed, non-empty molecules of one side (PR20)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.]"), lambda x: F.trim(x)), lambda x: x != "")


def is_placeholder(c: Column) -> Column:
    return c.rlike(PLACEHOLDER)


def reaction_sides(reaction: Column) -> Column:
    """Struct (well_delimited, reactants, products) (PR18, the part without molecules)."""
    text = F.trim(F.coalesce(reaction, F.lit("")))
    doubles = (F.length(text) - F.length(F.replace(text, F.lit(">>"), F.lit("")))) / 2
    one = doubles == 1
    three = (doubles == 0) & (F.length(text) - F.length(F.replace(text, F.lit(">"), F.lit(""))) >= 2)
    fields = F.split(text, ">", 3)
    left = F.when(one, F.substring_index(text, ">>", 1)).when(three, F.get(fields, F.lit(0)))
    right = F.when(one, F.substring(text, F.instr(text, ">>") + 2, F.length(text))).when(three, F.get(fields, F.lit(2)))
    return F.struct((one | three).alias("well_delimited"), split_side(left).alias("reactants"), split_side(right).alias("products"))


def parse_class(sides: Column, reactants_valid: Column, products_valid: Column) -> Column:
    """One of the eight classes, from the sides and whether their molecules are valid; placeholders count as valid."""
    symbolic = F.exists(F.concat(sides["reactants"], sides["products"]), is_placeholder)
    return (
        F.when(~sides["well_delimited"], "malformed_delimiter")
        .when((F.size(sides["reactants"]) == 0) | (F.size(sides["products"]) == 0), "empty_reaction_side")
        .when(reactants_valid & products_valid & ~symbolic, "valid")
        .when(reactants_valid & products_valid, "symbolic_intermediate")
        .when(~reactants_valid & ~products_valid, "invalid_both_sides")
        .when(~reactants_valid, "invalid_reactant")
        .when(~products_valid, "invalid_product")
        .otherwise("unknown")
    )


def map_numbers(side: Column) -> Column:
    return F.transform(F.regexp_extract_all(side, F.lit(":([0-9]+)\\]"), 1), lambda x: x.cast("int"))


def mapping_check(mapped: Column) -> Column:
    """Struct (valid, coverage, issues) of a mapped reaction: shared map numbers over all of them (CH9)."""
    left = map_numbers(F.substring_index(mapped, ">", 1))
    right = map_numbers(F.substring_index(mapped, ">", -1))
    shared, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    issues = F.array_compact(
        F.array(
            F.when(F.size(left) != F.size(F.array_distinct(left)), F.lit("duplicate_reactant_map_numbers")),
            F.when(F.size(right) != F.size(F.array_distinct(right)), F.lit("duplicate_product_map_numbers")),
            F.when(shared == 0, F.lit("no_overlapping_map_numbers")),
        )
    )
    coverage = F.when(either > 0, shared / either).otherwise(0.0)
    return F.struct((F.size(issues) == 0).alias("valid"), coverage.alias("coverage"), issues.alias("issues"))
