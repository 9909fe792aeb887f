"""Leakage: which keys occur in more than one split, with examples (A12, GV2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.parsing import clean_text, stable_hash
from retort.operators import aggregates

EXAMPLES = 50


def reaction_signature(resolved: Column, canonical: Column, original: Column | None = None) -> Column:
    """One signature for splitting and auditing: a hash of the resolved, else the canonical, else the original reaction; null without any."""
    parts = [clean_text(c) for c in (resolved, canonical, original) if c is not None]
    return stable_hash(F.coalesce(*parts), 40)


@dataclass(frozen=True)
class LeakageReport:
    counts: DataFrame  # one row a key kind
    examples: DataFrame  # at most EXAMPLES keys a kind
    strict: bool  # no patent or signature in two splits


def audit(steps: DataFrame, keys: dict[str, Column] | None = None, split: str = "split", diagnostic: tuple[str, ...] = ("scaffold",)) -> LeakageReport:
    """Overlaps of each kind of key. Kinds in ``diagnostic`` are reported but don't make a report unstrict."""
    keys = keys or {"patent": F.col("patent_document_id"), "signature": reaction_signature(F.col("canonical_resolved_reaction_smiles"), F.col("canonical_reaction_smiles"))}
    counts = examples = None
    for kind, key in keys.items():
        members = aggregates.membership(steps.select(clean_text(key).alias("key"), split), "key", split)
        one = aggregates.overlap_counts(members).select(F.lit(kind).alias("kind"), "*")
        few = members.where(F.size("splits") > 1).orderBy("key").limit(EXAMPLES).select(F.lit(kind).alias("kind"), "key", "splits")
        counts = one if counts is None else counts.unionByName(one)
        examples = few if examples is None else examples.unionByName(few)
    bad = counts.where((F.col("overlapping") > 0) & ~F.col("kind").isin(*diagnostic)).count()
    return LeakageReport(counts, examples, bad == 0)
