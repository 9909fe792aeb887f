"""Leakage-safe splits: connected components over patents and signatures, packed into train, val and test (GV1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions.parsing import clean_text
from retort.governance.leakage import reaction_signature
from retort.operators.components import connected_components
from retort.operators.packing import FRACTIONS, pack_components

ALGORITHM = "connected_components_patent_signature"


def leakage_edges(steps: DataFrame) -> DataFrame:
    """(src, dst): each route with its patents and its steps' signatures, and with itself so that none is lost."""
    signature = reaction_signature(F.col("canonical_resolved_reaction_smiles"), F.col("canonical_reaction_smiles"), F.col("reaction_smiles") if "reaction_smiles" in steps.columns else None)
    route, patent = F.concat(F.lit("r:"), F.col("route_id").cast("string")), F.concat(F.lit("p:"), clean_text(F.col("patent_document_id")))
    keys = F.array_compact(F.array(route, patent, F.concat(F.lit("s:"), signature)))
    return steps.select(route.alias("src"), F.explode(keys).alias("dst")).distinct()


def component_ids(labels: DataFrame) -> DataFrame:
    """(route_id, split_component_id): the id is a SHA-256 over the sorted routes (A14), 24 digits of it.

    The digest is over sums of the members' hashes, so a component of any size is digested with partial aggregation.
    """
    routes = labels.where("node like 'r:%'").select(F.substring("node", 3, 1 << 20).alias("route_id"), "component")
    part = [F.conv(F.substring(F.sha2("route_id", 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    ids = routes.groupBy("component").agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(part)])
    ids = ids.select("component", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256), 1, 24).alias("split_component_id"))
    return routes.join(ids, "component").select("route_id", "split_component_id")


def rebuild_splits(steps: DataFrame, seed: int = 42, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """``steps`` with split, split_component_id, _rows and _routes, _algorithm, _seed and reaction_signature.

    Fails if a step's route has no component.
    """
    assigned = component_ids(connected_components(leakage_edges(steps)))
    members = steps.select("route_id").join(assigned, "route_id")
    packed = pack_components(members, "split_component_id", seed, fractions).withColumnRenamed("rows", "split_component_rows")
    routes = assigned.groupBy("split_component_id").agg(F.count("*").alias("split_component_routes"))
    plan = assigned.join(packed, "split_component_id").join(routes, "split_component_id")
    signature = reaction_signature(F.col("canonical_resolved_reaction_smiles"), F.col("canonical_reaction_smiles"), F.col("reaction_smiles") if "reaction_smiles" in steps.columns else None)
    base = steps.withColumn("reaction_signature", signature).drop("split", "split_component_id", "split_component_rows", "split_component_routes")
    out = base.join(plan, "route_id", "left")
    checked = F.when(F.col("split").isNull(), F.raise_error(F.concat(F.lit("no split for route "), F.col("route_id").cast("string")))).otherwise(F.col("split"))
    return out.withColumn("split", checked).withColumn("split_algorithm", F.lit(ALGORITHM)).withColumn("split_seed", F.lit(seed))


def split_digest(steps: DataFrame) -> str:
    """A digest of (route, split) that doesn't depend on row order; one row reaches the driver."""
    from retort.functions.parsing import dataset_digest

    row = dataset_digest(steps.select("route_id", "split").distinct(), ["route_id", "split"]).first()
    return f"{row['rows']}-{row['digest_low']:x}-{row['digest_high']:x}"
