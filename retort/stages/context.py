"""The contextual stage: each route's steps in order, with intermediates resolved from observed structures.

The fold over a route is the only part in Python (one pass over its few steps); evidence, molecules, scores and
the other tables are column expressions over its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retort.chem import reaction
from retort.chem.columns import describe_molecules
from retort.functions import conditions, parsing, scores, taxonomy
from retort.operators import reshape
from retort.schemas import EDGE, REPAIR, RESOLUTION, struct

#: How an edge's evidence is named and worth: status, confidence, evidence type, structural, label, structure, metadata.
EDGES = {
    "bound": ("resolved", 1.0, "explicit_structural_identity", True, 1.0, 1.0, 1.0),
    "named": ("label_only", 0.45, "exact_symbolic_label", False, 1.0, 0.0, 1.0),
    "mismatch": ("metadata_mismatch", 0.0, "ambiguous_metadata", False, 0.0, 0.0, 0.0),
    "plain": ("adjacent_without_label", 0.25, "adjacent_sequence", False, 0.0, 0.0, 0.25),
}
_EDGE_FIELDS = [x.split()[0] for x in EDGE.split(", ")]
_RESOLUTION_FIELDS = [x.split()[0] for x in RESOLUTION.split(", ")]


def _label(value) -> str | None:
    return None if value is None or value != value or str(value) in ("", "nan") else str(value).upper()


@dataclass
class RouteFold:
    """What is known of a route up to a step: structures bound to labels, and the last step."""

    bound: dict[str, tuple[tuple[str, ...], str]]
    products: tuple[str, ...] = ()
    last_id: str | None = None
    last_index: int = 0
    last_out: str | None = None

    def step(self, row: dict) -> dict:
        notes: list[tuple] = []
        entering, leaving = _label(row["input_intermediate"]), _label(row["output_intermediate"])
        text = row["canonical_reaction_smiles"] or row["reaction_smiles"] or ""
        edge = self._edge(row, entering, notes) if self.last_id is not None else None
        sides = reaction.sides_of(text)
        reactants = list(sides.reactants)
        if entering in self.bound:
            found, source = self.bound[entering]
            reactants = [*found, *reactants]
            notes.append((entering, "reactant", "resolved", list(found), source, 1.0, "explicit_adjacent_output_input_anchor", "resolved_observed_structure", "observed_step_structure"))
            reactants = list(dict.fromkeys(reactants))
        reactants, products = self._fill(reactants, "reactant", notes), self._fill(list(sides.products), "product", notes)
        candidate = ".".join(reactants) + ">>" + ".".join(products) if reactants and products else None
        parsed = reaction.sides_of(candidate)
        states = {n[2] for n in notes}
        if not notes:
            status, sure = "not_required", 1.0 if parsed.ok else 0.0
        elif "unresolved" in states or "ambiguous" in states:
            partly = parsed.ok and "resolved" in states
            status, sure = ("partially_resolved", 0.6) if partly else ("unresolved", 0.0)
        elif parsed.ok:
            status, sure = "resolved", 1.0
        else:
            status, sure = "invalid_after_resolution", 0.0
        real = tuple(p for p in products if not reaction.PLACEHOLDER.fullmatch(p)) if parsed.products_valid else ()
        if leaving and real and parsed.ok and self.bound.get(leaving, (real,))[0] == real:
            self.bound[leaving] = (real, row["step_id"])
        self.products, self.last_id, self.last_index, self.last_out = real, row["step_id"], int(row["step_index"]), leaving
        return {
            "route_id": row["route_id"],
            "step_id": row["step_id"],
            "original_reaction_smiles": text,
            "resolved_reaction_smiles": candidate,
            "canonical_resolved_reaction_smiles": reaction.canonical_reaction(candidate) if parsed.ok else None,
            "resolution_status": status,
            "resolution_confidence": sure,
            "candidate_ok": parsed.ok,
            "resolutions": [dict(zip(_RESOLUTION_FIELDS, n, strict=True)) for n in notes],
            "edge": edge,
        }

    def _edge(self, row: dict, entering: str | None, notes: list[tuple]) -> dict:
        named = entering is not None and entering == self.last_out
        if named and self.products:
            if self.bound.get(entering, (self.products,))[0] == self.products:
                self.bound[entering] = (self.products, self.last_id)
            else:
                del self.bound[entering]
                notes.append((entering, "reactant", "ambiguous", [], self.last_id, 0.0, "conflicting_explicit_route_anchors", "ambiguous_multiple_anchors", "symbolic_only"))
        label = entering or self.last_out
        between = self.bound.get(label, ((),))[0]
        kind = ("bound" if between else "named") if named else ("mismatch" if label else "plain")
        values = (self.last_id, row["step_id"], self.last_index, int(row["step_index"]), label, list(between), *EDGES[kind])
        return dict(zip(_EDGE_FIELDS, values, strict=True))

    def _fill(self, molecules: list[str], side: str, notes: list[tuple]) -> list[str]:
        out: list[str] = []
        for m in molecules:
            label = m.upper() if reaction.PLACEHOLDER.fullmatch(m) else None
            out.extend(self.bound[label][0] if label in self.bound else [m])
            if label and label not in self.bound:
                how = ("no_unique_structural_anchor", "unresolved_label_only") if side == "reactant" else ("unsupported_product_placeholder", "unsupported_product_placeholder")
                notes.append((label, side, "unresolved", [], None, 0.0, *how, "symbolic_only"))
        return list(dict.fromkeys(out))


def _nested(text: str) -> str:
    return ",".join(":".join(f.split(" ", 1)) for f in text.split(", "))


FOLDED_SCHEMA = (
    "route_id string, step_id string, original_reaction_smiles string, resolved_reaction_smiles string, canonical_resolved_reaction_smiles string, resolution_status string, "
    f"resolution_confidence double, candidate_ok boolean, resolutions array<struct<{_nested(RESOLUTION)}>>, edge struct<{_nested(EDGE)}>"
)


def resolve_routes(steps: DataFrame) -> DataFrame:
    """One row a step with its resolution, records and the edge from the step before it (WN3, J12).

    A route's steps are gathered in order as one array, so an Arrow batch holds many routes.
    """
    columns = ["step_index", "step_id", "route_id", "canonical_reaction_smiles", "reaction_smiles", "input_intermediate", "output_intermediate"]
    gathered = steps.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("steps"))
    schema = to_arrow_schema(struct(FOLDED_SCHEMA))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for route in batch.column("steps").to_pylist():
                state = RouteFold({})
                rows.extend(state.step(step) for step in route)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return gathered.select("steps").mapInArrow(fold, FOLDED_SCHEMA)


def _repairs(texts: pd.Series, contexts: pd.Series, continuity: pd.Series) -> pd.Series:
    return pd.Series([reaction.repair_candidates(t, c, float(k)) for t, c, k in zip(texts, contexts, continuity, strict=True)])


@dataclass(frozen=True)
class Context:
    steps: DataFrame
    routes: DataFrame
    route_edges: DataFrame
    intermediate_resolution: DataFrame
    condition_evidence: DataFrame
    molecules: DataFrame
    step_molecules: DataFrame
    repair_candidates: DataFrame
    mapping_candidates: DataFrame
    quarantine: DataFrame


def build(steps: DataFrame, version: str = "v2") -> Context:
    """All contextual tables of canonical steps whose route_id and step_id are instance ids."""
    folded = resolve_routes(steps)
    edges = folded.where("edge is not null").select("route_id", "edge.*")
    continuity = edges.groupBy("route_id").agg(F.avg("continuity_confidence").alias("route_continuity_score"))
    rows = steps.drop("dataset_version").join(folded.drop("original_reaction_smiles", "edge"), ["route_id", "step_id"]).join(continuity, "route_id", "left")
    rows = rows.withColumn("route_continuity_score", F.coalesce("route_continuity_score", F.lit(1.0)))
    effective = F.coalesce("canonical_resolved_reaction_smiles", F.when(F.col("parse_ok"), F.col("canonical_reaction_smiles")))
    rows = rows.withColumn("effective", effective).withColumn("effective_ok", F.col("effective").isNotNull())
    rows = rows.withColumn("repairs", F.pandas_udf(_repairs, f"array<struct<{_nested(REPAIR)}>>")("reaction_smiles", "resolved_reaction_smiles", "route_continuity_score"))

    catalogue = describe_molecules(reshape.distinct_catalogue(steps, ["solvents", "agents", "reactants", "products"])).where("info.valid")
    families = catalogue.select("molecule", taxonomy.solvent_family(F.col("molecule"), F.col("info")).alias("solvent_family"), taxonomy.agent_family(F.col("info")).alias("agent_family"), taxonomy.catalyst_family(F.col("molecule"), F.col("info")).alias("catalyst_family"))
    roles = reshape.role_positions(steps, "step_id", {"reactant": "reactants", "product": "products", "solvent": "solvents", "agent": "agents"})
    with_family = roles.join(families, "molecule", "left")
    solvent = F.when(F.col("role") == "solvent", F.coalesce("solvent_family", F.lit("unknown_solvent")))
    agent = F.when(F.col("role") == "agent", F.coalesce("agent_family", F.lit("unknown_agent")))
    per_step = with_family.groupBy("step_id").agg(
        F.sort_array(F.collect_set(solvent)).alias("solvent_families"), F.sort_array(F.collect_set(agent)).alias("agent_families"), F.sort_array(F.collect_set(F.when(F.col("role") == "agent", F.col("catalyst_family")))).alias("catalyst_families")
    )
    empty = F.array().cast("array<string>")
    rows = rows.join(per_step, "step_id", "left").withColumns({c: F.coalesce(c, empty) for c in ("solvent_families", "agent_families", "catalyst_families")})

    symbolic = F.size("resolutions") > 0
    resolved = F.col("resolution_status").isin("resolved", "partially_resolved")
    evidence = F.when(F.col("parse_ok"), "observed_step_structure").when(resolved, "observed_route_metadata").when(symbolic, "symbolic_only").otherwise("unavailable")
    complete = ((F.size("solvents") > 0).cast("int") + F.col("temperature_c").isNotNull().cast("int") + F.col("time_h").isNotNull().cast("int")) / 3.0
    plausible = F.when(F.col("condition_status") == "suspicious", 0.0).otherwise(1.0)
    parse = F.when(F.col("effective_ok"), 1.0).otherwise(0.0)
    quality = scores.context_quality(parse, F.col("resolution_status"), F.col("route_continuity_score"), complete, plausible)
    components = F.create_map(
        F.lit("parse"), parse, F.lit("resolution"), scores.resolution_worth(F.col("resolution_status")), F.lit("route_continuity"), F.col("route_continuity_score"),
        F.lit("condition_completeness"), complete, F.lit("condition_plausibility"), plausible, F.lit("mapping"), F.lit(None).cast("double"),
    )
    source = F.when(F.col("effective_ok") & F.col("parse_ok"), "original_parse_valid").when(F.col("effective_ok") & resolved, "resolved_observed_intermediate").otherwise("not_eligible")
    rows = rows.withColumns(
        {
            "dataset_version": F.lit(version),
            "structure_evidence_type": evidence,
            "contextual_parse_ok": F.col("effective_ok"),
            "repairable": F.exists("repairs", lambda r: r["accepted"]),
            "mapping_status": F.when(F.col("effective_ok"), "pending").otherwise("not_eligible"),
            "eligibility_source": source,
            "quality_components": components,
            "contextual_quality_score": quality,
            "eligible_retrieval_v2": F.col("effective_ok"),
            "reaction_signature": parsing.stable_hash(F.coalesce("effective", "reaction_smiles", F.lit("")), 40),
        }
    )
    final = rows.withColumn("canonical_resolved_reaction_smiles", F.col("effective"))
    ids = ["dataset_version", "step_id", "route_id"]
    inferred = ~F.col("condition_extraction_method").isin("legacy", "source", "not_three_field")
    long = reshape.condition_evidence(steps, "step_id", {"temperature": "temperature_observed_c", "time": "time_observed_h"}, {"solvent": "solvents", "agent": "agents"})
    facts = steps.select("step_id", "route_id", conditions.condition_confidence(F.col("condition_extraction_confidence")).alias("confidence"), F.when(inferred, "inferred").otherwise("directly_observed").alias("evidence_origin"), "temperature_valid", "time_valid")
    valid = F.when(F.col("evidence_type") == "temperature", F.col("temperature_valid")).when(F.col("evidence_type") == "time", F.col("time_valid")).otherwise(F.lit(True))
    evidence_rows = long.join(facts, "step_id").withColumn("plausibility_status", F.when(F.coalesce(valid, F.lit(False)), "valid").otherwise("suspicious")).drop("temperature_valid", "time_valid")
    reason = F.when(symbolic & F.col("resolution_status").isin("unresolved", "ambiguous"), "unresolved_symbolic_intermediate").when(~F.col("effective_ok"), F.col("parse_failure_class"))
    routes = final.groupBy("route_id").agg(
        F.first("dataset_version").alias("dataset_version"), F.first("patent_document_id").alias("patent_document_id"), F.first("split").alias("split"), F.count("*").alias("step_count"),
        F.count_if("contextual_parse_ok").alias("contextual_parse_valid_steps"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved_intermediate_steps"),
        F.count_if("effective_ok").alias("mapping_eligible_steps"), F.first("route_continuity_score").alias("route_continuity_score"), F.round(F.avg("contextual_quality_score"), 6).alias("route_quality_score"),
    )
    return Context(
        steps=final.drop("effective", "effective_ok", "repairs", "resolutions", "candidate_ok"),
        routes=routes,
        route_edges=edges,
        intermediate_resolution=folded.select("route_id", "step_id", F.explode("resolutions").alias("r")).select("route_id", "step_id", "r.*"),
        condition_evidence=evidence_rows,
        molecules=catalogue.select("info.*").drop("valid").dropDuplicates(["molecule_id"]),
        step_molecules=roles.join(catalogue.select("molecule", "info.molecule_id"), "molecule"),
        repair_candidates=final.select(*ids, F.posexplode("repairs").alias("rank", "c")).select(*ids, (F.col("rank") + 1).alias("rank"), "c.*"),
        mapping_candidates=final.select(*ids, "patent_document_id", "split", F.coalesce("effective", F.lit("")).alias("reaction_smiles"), "reaction_signature", F.when(F.col("effective_ok"), "eligible").otherwise("not_eligible").alias("eligibility_status"), "eligibility_source", "structure_evidence_type", "mapping_status"),
        quarantine=final.withColumn("reason", reason).where("reason is not null").select(*ids, "reason", "structure_evidence_type", F.col("reaction_smiles").alias("original_reaction_smiles"), F.col("resolved_reaction_smiles").alias("candidate_reaction_smiles")),
    )
