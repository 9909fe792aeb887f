"""Schemas of the tables that stages read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


SOURCE_STEPS = (
    "route_id string, step_index string, step_reaction_smiles string, step_working_reaction_smiles string, step_parse_ok string, step_canonical_reaction_demapped string, "
    "step_solvent_list_norm string, step_agent_or_spectator_list_norm string, temperature_c_primary string, time_h_primary string, step_input_intermediate string, step_output_intermediate string"
)
SOURCE_ROUTES = (
    "route_id string, multistep_reaction_text string, route_step_count string, route_parsed_step_count string, route_parse_ok string, route_is_atom_mapped string, "
    "route_reactants_demapped string, route_products_demapped string, final_products_demapped string"
)
RESOLUTION = "intermediate_label string, side string, status string, resolved_molecules array<string>, evidence_step_id string, confidence double, method string, evidence_status string, structure_evidence_type string"
EDGE = (
    "source_step_id string, target_step_id string, source_step_index int, target_step_index int, intermediate_label string, connecting_molecules array<string>, continuity_status string, "
    "continuity_confidence double, edge_evidence_type string, structural_identity_available boolean, label_continuity_score double, structural_continuity_score double, metadata_consistency_score double"
)
REPAIR = (
    "candidate_reaction_smiles string, repair_type string, parse_valid boolean, canonical_reaction_smiles string, edit_similarity double, route_continuity_score double, rank_score double, accepted boolean"
)
MAPPING = "mapping_status string, mapped_reaction_smiles string, backend string, confidence double, atom_coverage double, error_code string, token_count int, fallback_attempted boolean"
CENTRE = (
    "derivation_status string, formed_bonds array<struct<atoms:array<int>,bond_type:string,bond_order:double>>, broken_bonds array<struct<atoms:array<int>,bond_type:string,bond_order:double>>, "
    "changed_bonds array<struct<atoms:array<int>,before_type:string,before_order:double,after_type:string,after_order:double>>, changed_atom_maps array<int>, "
    "atom_environment_changes array<struct<atom_map:int,before:struct<element:string,charge:int,aromatic:boolean,degree:int,neighbours:array<string>>,after:struct<element:string,charge:int,aromatic:boolean,degree:int,neighbours:array<string>>>>, "
    "reaction_centre_fingerprint string, reaction_template string, reaction_family string, family_cluster_id string, error_message string"
)


def align(frame: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in order, cast to its types; missing ones are null, others are dropped."""

    def one(f: T.StructField) -> Column:
        return (F.col(f"`{f.name}`") if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return frame.select(*[one(f) for f in struct(schema).fields])
