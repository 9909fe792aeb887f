"""The learning tasks: targets, inputs, eligible rows and limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _confident(c: str) -> Column:
    return F.col(c).isNotNull() & F.col("condition_extraction_confidence").isin("high", "medium")


@dataclass(frozen=True)
class Task:
    name: str
    target: str
    text: str
    eligible: Callable[[], Column]
    minimum: int = 1
    labels: int | None = None
    top: int = 5


#: The tasks' targets, input columns and limits.
CLASSIFIERS = {
    t.name: t
    for t in (
        Task("parse_validity", "parse_ok", "reaction_smiles", lambda: F.col("reaction_smiles").isNotNull(), 1),
        Task("parse_failure_class", "contextual_parse_failure_class", "original_reaction_smiles", lambda: F.col("original_reaction_smiles").isNotNull(), 20),
        Task("reaction_family", "reaction_family", "canonical_resolved_reaction_smiles", lambda: F.col("eligible_mapping_models") & F.col("reaction_family").isNotNull(), 100),
        Task("primary_solvent", "solvent_primary", "canonical_reaction_smiles", lambda: F.col("eligible_condition_models") & F.col("solvent_primary").isNotNull(), 100),
        Task("time_bucket", "time_bucket", "canonical_reaction_smiles", lambda: F.col("eligible_condition_models") & _confident("time_bucket"), 20),
        Task("temperature_bucket", "temperature_bucket", "canonical_reaction_smiles", lambda: F.col("eligible_condition_models") & _confident("temperature_bucket"), 20),
        Task("agent_presence", "agent_present", "canonical_reaction_smiles", lambda: F.col("eligible_condition_models"), 1),
    )
}
MULTILABEL = {
    t.name: t
    for t in (
        Task("solvent_multilabel", "solvents", "canonical_resolved_reaction_smiles", lambda: F.size("solvents") > 0, 100, 48, 5),
        Task("solvent_family_multilabel", "solvent_families", "canonical_resolved_reaction_smiles", lambda: F.size("solvent_families") > 0, 50, 24, 3),
        Task("agent_multilabel", "agents", "canonical_resolved_reaction_smiles", lambda: F.size("agents") > 0, 200, 64, 5),
        Task("agent_family_multilabel", "agent_families", "canonical_resolved_reaction_smiles", lambda: F.size("agent_families") > 0, 50, 24, 3),
        Task("catalyst_family_multilabel", "catalyst_families", "canonical_resolved_reaction_smiles", lambda: F.size("catalyst_families") > 0, 20, 16, 3),
    )
}
#: target, transform, unit
REGRESSIONS = {"time_regression": ("time_h", "log1p", "h"), "temperature_regression": ("temperature_c", "identity", "degC")}
#: Reported but not learned: its target follows from a rule.
AUDIT_ONLY = {"repairability": "deterministic_audit_not_trainable"}
#: Stages of the first release's models when it is frozen; any other is ``baseline``.
BASELINE_STAGES = {"parse_validity": "baseline", "primary_solvent": "staging", "agent_presence": "screening", "time_bucket": "experimental", "temperature_bucket": "experimental"}
