"""Answers to single reactions and small batches from the stages' tables and registered models (ML11, ML12, PR24, CH15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.chem import reaction
from retort.chem.columns import reaction_fingerprint
from retort.governance.registry import Registry
from retort.ml import anomaly, inference, tasks, train
from retort.sources.datasets import read_dataset

#: Reactions of one request.
MOST_REACTIONS = 1000
# Weights of the quality components that a caller gives.
QUALITY_WEIGHTS = {"parse": 0.30, "resolution": 0.20, "route_continuity": 0.15, "condition_completeness": 0.15, "condition_plausibility": 0.10, "mapping": 0.10}


class NotReady(LookupError):
    """A table or model that the answer needs hasn't been made."""


class Answers:
    def __init__(self, spark: SparkSession, root: str, registry: Registry):
        self.spark, self.root, self.registry = spark, root, registry

    def _table(self, name: str) -> DataFrame:
        try:
            return read_dataset(self.spark, self.root, name)
        except FileNotFoundError as problem:
            raise NotReady(f"{name} has not been built") from problem

    def repair(self, reaction_smiles: str, contextual_candidate: str | None = None, route_continuity_score: float = 0.0) -> dict:
        return {"input_reaction": reaction_smiles, "candidates": reaction.repair_candidates(reaction_smiles, contextual_candidate, route_continuity_score)}

    def route_quality(self, **components: float) -> dict:
        score = sum(w * min(1.0, max(0.0, components.get(k) or 0.0)) for k, w in QUALITY_WEIGHTS.items())
        return {"route_quality_score": round(score, 6), "components": {k: components.get(k) for k in QUALITY_WEIGHTS}}

    def anomaly(self, reaction_smiles: str, temperature_c: float | None = None, time_h: float | None = None) -> dict:
        """Conditions held against those of the nearest indexed step's family, or of all without one."""
        model = self._table("index/anomaly")
        found = self._neighbours([reaction_smiles], 1).collect()
        family = found[0]["reaction_family"] if found else None
        row = self.spark.createDataFrame([(family, temperature_c, time_h)], "reaction_family string, temperature_c double, time_h double")
        scored = anomaly.score(row, model).first()
        return {"reaction_family": family, "anomaly_score": scored["anomaly_score"], "reasons": scored["anomaly_reasons"]}

    def _neighbours(self, reactions: list[str], k: int) -> DataFrame:
        """(query_id, step_id, score, rank and the step's columns) of the k nearest indexed steps of each reaction that parses."""
        index = self._table("index/reactions")
        asked = [(i, text) for i, text in enumerate(reactions) if reaction.sides_of(text).ok]
        rows = self.spark.createDataFrame(asked, "query_id int, reaction_smiles string").withColumn("f", reaction_fingerprint("reaction_smiles"))
        queries = rows.where("f.reactant is not null").select("query_id", F.col("f.reactant").alias("reactant"), F.col("f.product").alias("product"))
        found = inference.evidence(queries.withColumn("query_id", F.concat(F.lit("q:"), F.col("query_id").cast("string"))), index, k)
        return found.join(index.drop("reactant", "product", "centre"), "step_id").withColumn("query_id", F.substring("query_id", 3, 12).cast("int"))

    def _model(self, name: str, experimental: bool) -> tuple[dict | None, train.Trained | None]:
        card = self.registry.resolve(name, experimental)
        return card, train.load(self.spark, f"{self.root}/models/{name}") if card else None

    def predict(self, reactions: list[str], names: list[str], evidence_k: int = 5, include_evidence: bool = True, allow_experimental: bool = False) -> list[dict]:
        """One answer for each reaction, in order. A task abstains if the reaction doesn't parse, has no model, or its blend says so."""
        if len(reactions) > MOST_REACTIONS:
            raise ValueError(f"more than {MOST_REACTIONS} reactions")
        parsed = [reaction.sides_of(text) for text in reactions]
        near = self._neighbours(reactions, max(evidence_k, 1)).cache()
        try:
            evidence: dict[int, list[dict]] = {}
            for r in near.orderBy("query_id", "rank").collect():
                evidence.setdefault(r["query_id"], []).append({k: v for k, v in r.asDict(True).items() if k not in ("query_id", "rank")})
            out = [
                {
                    "input_reaction": text,
                    "canonical_reaction": reaction.canonical_reaction(text) if p.ok else None,
                    "parse_ok": p.ok,
                    "parse_failure_class": None if p.ok else p.parse_class,
                    "applicability": inference.applicability_of(evidence[i][0]["score"]) if i in evidence else ("out_of_domain" if p.ok else "invalid"),
                    "tasks": [],
                    "evidence": evidence.get(i, [])[:evidence_k] if include_evidence else [],
                }
                for i, (text, p) in enumerate(zip(reactions, parsed, strict=True))
            ]
            for name in names:
                for i, answer in self._task(name, reactions, near, allow_experimental).items():
                    if not parsed[i].ok and name not in ("parse_validity", "parse_failure_class"):
                        answer = {"predictions": [], "abstained": True, "reason": "input_does_not_parse"}
                    out[i]["tasks"].append({"task": name} | answer)
        finally:
            near.unpersist()
        return out

    def _task(self, name: str, reactions: list[str], near: DataFrame, experimental: bool) -> dict[int, dict]:
        card, model = self._model(name, experimental)
        if model is None:
            return {i: {"predictions": [], "abstained": True, "reason": "no_served_model"} for i in range(len(reactions))}
        about = {"model_id": card["id"], "model_stage": card["stage"]}
        asked = self.spark.createDataFrame(list(enumerate(reactions)), "query_id int, text string")
        if name in tasks.REGRESSIONS:
            target, transform, unit = tasks.REGRESSIONS[name]
            family = near.where("rank = 1").select("query_id", F.coalesce("reaction_family", F.lit("unknown")).alias("family"))
            rows = train.predict_value(model, asked.join(family, "query_id", "left").fillna("unknown", ["family"]), "text", "family", transform).collect()
            return {r["query_id"]: about | {"predictions": [], "point_estimate": r["predicted"], "interval": [r["low"], r["high"]], "units": unit, "abstained": False} for r in rows}
        task = tasks.CLASSIFIERS.get(name) or tasks.MULTILABEL[name]
        own = near.where("rank = 1").select("query_id", F.coalesce("reaction_family", F.lit("unknown")).alias("query_family"))
        scores = train.label_probabilities(model, asked, "text").join(own, "query_id", "left").fillna("unknown", ["query_family"])
        labelled = near if task.target in near.columns else near.withColumn(task.target, F.lit(None).cast("string"))
        blended = inference.blend(scores, labelled, task.target, top=task.top)
        return {r["query_id"]: about | {"predictions": [p.asDict() for p in r["predictions"]], "abstained": r["abstained"], "reason": "weak_or_distant_evidence" if r["abstained"] else None} for r in blended.collect()}
