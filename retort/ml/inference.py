"""Batch contextual inference: evidence, applicability, neighbour distributions, blending and abstention (ML11-ML14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.functions.scores import reaction_similarity, tanimoto
from retort.operators import aggregates, fingerprints

#: Thresholds and weights of the blend.
IN_DOMAIN, NEAR_DOMAIN, LEAST_BEST, LEAST_QUALITY = 0.65, 0.35, 0.35, 0.35
BLEND = {"model": 0.55, "neighbour": 0.25, "family": 0.15, "applicability": 0.05}
APPLICABILITY_WORTH = {"in_domain": 1.0, "near_domain": 0.6, "out_of_domain": 0.15, "invalid": 0.0}


def applicability(best: Column) -> Column:
    """ML13."""
    return F.when(best >= IN_DOMAIN, "in_domain").when(best >= NEAR_DOMAIN, "near_domain").otherwise("out_of_domain")


def applicability_of(best: float) -> str:
    """ML13 for one number."""
    return "in_domain" if best >= IN_DOMAIN else "near_domain" if best >= NEAR_DOMAIN else "out_of_domain"


def evidence(queries: DataFrame, index: DataFrame, k: int = 10, least_quality: float = LEAST_QUALITY, version: int = 2) -> DataFrame:
    """The k nearest indexed steps of every query, after the quality filter (SL4, CH18).

    Both have reactant and product fingerprint words; queries also query_id, the index step_id and contextual_quality_score.
    """
    good = index.where(F.col("contextual_quality_score") >= least_quality)
    q = queries.select("query_id", F.col("reactant").alias("_qr"), F.col("product").alias("_qp"))
    score = F.round(reaction_similarity(tanimoto(F.col("_qr"), F.col("reactant")), tanimoto(F.col("_qp"), F.col("product")), version=version), 6)
    return fingerprints.search_blocked(good.select("step_id", "reactant", "product"), q, score, "query_id", "step_id", k)


def blend(model: DataFrame, found: DataFrame, target: str, family: str = "reaction_family", top: int = 5) -> DataFrame:
    """(query_id, predictions, abstained, applicability) from model probabilities and labelled evidence.

    model: query_id, label, probability, and query_family. found: query_id, score, the target and family of each neighbour.
    The family part is the distribution over neighbours of the query's family, or that of all where there are none.
    """
    long = found.select("query_id", "score", family, F.explode_outer(F.col(target)).alias("label")) if dict(found.dtypes)[target].startswith("array") else found.select("query_id", "score", family, F.col(target).alias("label"))
    near = aggregates.neighbour_distribution(long, "query_id", "label", "score").withColumnRenamed("share", "neighbour")
    families = model.select("query_id", "query_family").distinct()
    same = long.join(families, "query_id").where(F.col(family) == F.col("query_family"))
    of_family = aggregates.neighbour_distribution(same, "query_id", "label", "score").withColumnRenamed("share", "family_share")
    best = found.groupBy("query_id").agg(F.max("score").alias("best_evidence"))
    has_family = of_family.select("query_id").distinct().withColumn("_has", F.lit(True))
    rows = model.select("query_id", "label", "probability").join(near, ["query_id", "label"], "full_outer").join(of_family, ["query_id", "label"], "left").join(has_family, "query_id", "left").join(best, "query_id", "left")
    domain = applicability(F.coalesce("best_evidence", F.lit(0.0)))
    worth = F.create_map(*[F.lit(x) for p in APPLICABILITY_WORTH.items() for x in p])
    zero = F.lit(0.0)
    prior = F.when(F.col("_has"), F.coalesce("family_share", zero)).otherwise(F.coalesce("neighbour", zero))
    combined = (
        F.coalesce("probability", zero) * BLEND["model"] + F.coalesce("neighbour", zero) * BLEND["neighbour"] + prior * BLEND["family"] + F.element_at(worth, domain) * BLEND["applicability"]
    )
    scored = rows.withColumn("applicability", domain).withColumn("combined", F.round(combined, 6))
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "label"))).where(F.col("_n") <= top)
    out = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_n", "label", "combined"))).alias("p"), F.first("applicability").alias("applicability"))
    least = F.get("p", F.lit(0))["combined"] < LEAST_BEST
    return out.select("query_id", F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["combined"].alias("score"))).alias("predictions"), (least | (F.col("applicability") == "out_of_domain")).alias("abstained"), "applicability")
