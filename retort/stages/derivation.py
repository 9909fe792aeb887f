"""Reaction centres and families of mapped reactions, and the final tables that they enrich."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.chem import reaction
from retort.functions import scores
from retort.operators import aggregates
from retort.schemas import CENTRE

STRICT = ("rxnmapper", "existing")
IDS = ["dataset_version", "step_id", "route_id"]


def eligible(least_confidence: float = 0.5) -> Column:
    """Passed mappings of enough confidence with a text (PR28)."""
    return F.col("mapping_status").isin("mapped", "existing") & (F.col("validation_status") == "passed") & (F.col("confidence") >= least_confidence) & (F.coalesce("mapped_reaction_smiles", F.lit("")) != "")


def _derive(texts: list[str]) -> pd.DataFrame:
    names = [x.split()[0] for x in _columns(CENTRE)]
    rows = []
    for text in texts:
        try:
            rows.append({**reaction.reaction_centre(text), "derivation_status": "derived", "error_message": None})
        except ValueError as problem:
            rows.append({"derivation_status": "failed", "error_message": f"{type(problem).__name__}: {problem}"})
    return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)


def _columns(schema: str) -> list[str]:
    """A schema text cut at its outer commas."""
    out, depth, last = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(last.strip())
            last = ""
        else:
            last += c
    return [*out, last.strip()]


def derive(mappings: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Eligible mappings with the columns of CENTRE (CH12, CH13, Q12); each distinct mapped text is worked on once."""
    chosen = mappings.where(eligible(least_confidence))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = _derive(batch["mapped_reaction_smiles"].tolist())
            frame.insert(0, "mapped_reaction_smiles", batch["mapped_reaction_smiles"].to_numpy())
            yield frame

    centres = chosen.select("mapped_reaction_smiles").distinct().mapInPandas(run, f"mapped_reaction_smiles string, {CENTRE}")
    return chosen.join(centres, "mapped_reaction_smiles").withColumn("scientific_eligibility", F.col("backend").isin(*STRICT))


@dataclass(frozen=True)
class Derivation:
    reaction_mappings: DataFrame
    reaction_centres: DataFrame
    reaction_families: DataFrame
    reaction_templates: DataFrame
    rejected_derivations: DataFrame


def tables(derived: DataFrame) -> Derivation:
    """The four tables of derived rows, and the rejected ones (UN4)."""
    good = derived.where("derivation_status = 'derived'")
    return Derivation(
        good.select(*IDS, "mapped_reaction_smiles", "backend", "confidence", F.lit("mapped").alias("mapping_status"), "validation_status", "scientific_eligibility"),
        good.select(*IDS, "formed_bonds", "broken_bonds", "changed_bonds", "changed_atom_maps", "atom_environment_changes", "reaction_centre_fingerprint", "reaction_template"),
        good.select(*IDS, "reaction_family", F.lit("mapped_bond_change_rules_v2").alias("family_method"), F.col("confidence").alias("family_confidence"), "reaction_centre_fingerprint", "family_cluster_id"),
        good.select(*IDS, "reaction_template", "reaction_family", "reaction_centre_fingerprint"),
        derived.where("derivation_status <> 'derived'").select(*IDS, "mapped_reaction_smiles", "backend", "error_message"),
    )


def final_steps(steps: DataFrame, derived: DataFrame, version: str = "v2") -> DataFrame:
    """Contextual steps with mapping, family and final quality (J6, PR23). A step without a derivation keeps its status."""
    mine = derived.where("derivation_status = 'derived'").select(
        "step_id", F.col("confidence").alias("mapping_confidence"), F.col("backend").alias("mapping_backend"), "reaction_family", "reaction_centre_fingerprint", F.col("scientific_eligibility").alias("_strict")
    )
    kept = [c for c in steps.columns if c not in mine.columns or c == "step_id"]
    joined = steps.select(*kept).join(mine.dropDuplicates(["step_id"]), "step_id", "left")
    worth = F.when(F.col("_strict"), 1.0).when(F.col("mapping_backend").isNotNull(), 0.4).otherwise(0.0)
    components = F.map_concat(F.map_filter("quality_components", lambda k, v: k != "mapping"), F.create_map(F.lit("mapping"), worth))
    return joined.withColumns(
        {
            "dataset_version": F.lit(version),
            "mapping_status": F.when(F.col("mapping_backend").isNotNull(), "mapped").otherwise(F.col("mapping_status")),
            "quality_components": components,
            "contextual_quality_score": scores.final_quality(F.coalesce("contextual_quality_score", F.lit(0.0)), worth),
            "eligible_mapping_models": F.coalesce("_strict", F.lit(False)),
        }
    ).drop("_strict")


def final_routes(routes: DataFrame, steps: DataFrame) -> DataFrame:
    """Contextual routes with their mapped steps and families."""
    strict = steps.where("eligible_mapping_models")
    mapped = strict.groupBy("route_id").agg(F.count("*").alias("mapped_steps"))
    families = aggregates.distribution_map(strict, "route_id", "reaction_family").select("route_id", F.col("distribution").alias("family_distribution"))
    joined = routes.join(mapped, "route_id", "left").join(families, "route_id", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return joined.withColumn("mapped_steps", F.coalesce("mapped_steps", F.lit(0).cast("long"))).withColumn("family_distribution", F.coalesce("family_distribution", empty)).withColumn("reaction_families", F.map_keys("family_distribution"))
