"""Search indexes: fingerprints of steps and mean embeddings of routes, as Parquet-ready frames (ML16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.chem.columns import reaction_fingerprint
from retort.functions.scores import centre_bits
from retort.operators import fingerprints
from retort.session import cut_lineage

LANES = 32


def reaction_index(steps: DataFrame) -> DataFrame:
    """One row for each retrievable step: fingerprint words of both sides and of the reaction centre (null without one)."""
    rows = steps.where("eligible_retrieval_v2").withColumn("_text", F.coalesce("canonical_resolved_reaction_smiles", "canonical_reaction_smiles"))
    prints = rows.select("_text").distinct().withColumn("f", reaction_fingerprint("_text"))
    centre = F.when(F.col("reaction_centre_fingerprint").isNotNull(), fingerprints.words_of_bits(centre_bits(F.col("reaction_centre_fingerprint"))))
    joined = rows.join(prints, "_text").where("f.reactant is not null")
    kept = [c for c in ("step_id", "route_id", "patent_document_id", "split", "reaction_family", "solvents", "agents", "solvent_families", "agent_families", "temperature_c", "time_h", "contextual_quality_score") if c in steps.columns]
    return joined.select(*kept, F.col("_text").alias("reaction_smiles"), F.col("f.reactant").alias("reactant"), F.col("f.product").alias("product"), centre.alias("centre"))


def route_index(index: DataFrame) -> DataFrame:
    """(route_id, n, positions, weights): each route's unit-length mean of its steps' bits, 4,096 wide and stored sparsely."""

    def set_bits(words: str, shift: int):
        at = F.flatten(F.transform(words, lambda w, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.bit_get(w, b) == 1, i * 64 + b + shift)), lambda x: x.isNotNull())))
        return at

    bits = index.select("route_id", "step_id", F.concat(set_bits("reactant", 0), set_bits("product", 2048)).alias("bits"))
    sums = bits.select("route_id", F.explode("bits").alias("i")).groupBy("route_id", "i").agg(F.count("*").alias("s"))
    steps = index.groupBy("route_id").agg(F.count("*").alias("n"))
    packed = sums.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("p"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"))
    return cut_lineage(packed.join(steps, "route_id").select("route_id", "n", F.transform("p", lambda x: x["i"]).alias("positions"), F.expr("transform(p, x -> x.s / size)").alias("weights")))


def benchmark(index: DataFrame, queries: int = 50, k: int = 10) -> DataFrame:
    """One row (queries, self_recall, family_recall) of the first rows by id as queries against all (A25, GV5)."""
    from retort.functions.scores import reaction_similarity, tanimoto

    chosen = index.orderBy("step_id").limit(queries).select(F.concat(F.lit("q:"), "step_id").alias("query_id"), F.col("reactant").alias("_qr"), F.col("product").alias("_qp"))
    score = reaction_similarity(tanimoto(F.col("_qr"), F.col("reactant")), tanimoto(F.col("_qp"), F.col("product")))
    found = fingerprints.search_blocked(index.select("step_id", "reactant", "product"), chosen, score, "query_id", "step_id", k)
    family = index.select("step_id", "reaction_family")
    own = family.select(F.concat(F.lit("q:"), "step_id").alias("query_id"), F.col("reaction_family").alias("query_family"))
    each = found.join(family, "step_id").join(own, "query_id").groupBy("query_id").agg(F.max((F.col("query_id") == F.concat(F.lit("q:"), "step_id")).cast("double")).alias("self"), F.max(F.col("reaction_family").eqNullSafe(F.col("query_family")).cast("double")).alias("family"))
    return each.agg(F.count("*").alias("queries"), F.avg("self").alias("self_recall"), F.avg("family").alias("family_recall"))
