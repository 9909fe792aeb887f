"""The stages end to end: each reads datasets by name and writes its own, so a failed run resumes at a stage."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from retort.governance import acceptance, splits
from retort.governance.registry import Registry
from retort.ml import anomaly, tasks, train
from retort.schemas import SOURCE_ROUTES, SOURCE_STEPS
from retort.sources.datasets import Artifact, read_dataset, tree_digest, write_dataset
from retort.stages import canonical, context, derivation, index, mapping

STAGES = ("canonical", "context", "mapping", "derivation", "splits", "indexes", "training", "validation")


class Workflow:
    def __init__(self, spark: SparkSession, root: str, version: str = "v2"):
        self.spark, self.root, self.version = spark, root, version

    def _read(self, name: str):
        return read_dataset(self.spark, self.root, name)

    def _write(self, name: str, frame) -> int:
        return write_dataset(frame, self.root, name)

    def canonical(self, artifact: str, steps: str = "steps.csv", routes: str = "routes.csv") -> dict:
        source = Artifact(self.spark, artifact)
        built = canonical.build(source.read_csv(steps, SOURCE_STEPS), source.read_csv(routes, SOURCE_ROUTES), self.version)
        return {n: self._write(f"canonical/{n}", getattr(built, n)) for n in ("steps", "routes", "quality_events")}

    def context(self) -> dict:
        built = context.build(self._read("canonical/steps"), self.version)
        return {n: self._write(f"context/{n}", getattr(built, n)) for n in built.__dataclass_fields__}

    def mapping(self, config: mapping.MappingConfig | None = None) -> dict:
        config = config or mapping.MappingConfig()
        mapping.preflight(config)
        mapped = mapping.map_candidates(self._read("context/mapping_candidates"), config)
        count = self._write("mapping/all", mapped)
        return {"all": count} | {n: self._write(f"mapping/{n}", f) for n, f in mapping.outputs(self._read("mapping/all")).items()}

    def derivation(self) -> dict:
        self._write("derivation/all", derivation.derive(self._read("mapping/all")))
        derived = self._read("derivation/all")
        out = {n: self._write(f"derivation/{n}", getattr(derivation.tables(derived), n)) for n in derivation.Derivation.__dataclass_fields__}
        out["steps"] = self._write("enriched/steps", derivation.final_steps(self._read("context/steps"), derived, self.version))
        out["routes"] = self._write("enriched/routes", derivation.final_routes(self._read("context/routes"), self._read("enriched/steps")))
        return out

    def splits(self, seed: int = 42) -> dict:
        rows = self._write("final/steps", splits.rebuild_splits(self._read("enriched/steps"), seed))
        final = self._read("final/steps")
        routes = self._read("enriched/routes").drop("split").join(final.select("route_id", "split").distinct(), "route_id")
        return {"steps": rows, "routes": self._write("final/routes", routes), "digest": splits.split_digest(final)}

    def indexes(self) -> dict:
        final = self._read("final/steps")
        reactions = self._write("index/reactions", index.reaction_index(final))
        return {"reactions": reactions, "routes": self._write("index/routes", index.route_index(self._read("index/reactions"))), "anomaly": self._write("index/anomaly", anomaly.fit(final))}

    def training(self, names: tuple[str, ...] = tuple(tasks.CLASSIFIERS), size: int = train.FEATURES) -> dict:
        final, registry, out = self._read("final/steps"), Registry(self.spark, f"{self.root}/registry"), {}
        digest = splits.split_digest(final)
        for name in names:
            task = tasks.CLASSIFIERS[name]
            if task.target not in final.columns:
                out[name] = registry.register_audit(name, self.version, {}, "target_missing")
                continue
            rows = final.where(task.eligible())
            found = train.train_classifier(rows, name, task.target, task.text, minimum=task.minimum, size=size)
            if found.trained:
                train.save(found, f"{self.root}/models/{name}")
                out[name] = registry.register_model(name, self.version, {"metrics": found.metrics, "split_digest": digest})
            else:
                out[name] = registry.register_audit(name, self.version, {"reason": found.reason}, found.reason)
        return out

    def specialist(self, names: tuple[str, ...], size: int = train.FEATURES) -> dict:
        """Trains tasks with several labels and regressions."""
        final, registry, out = self._read("final/steps"), Registry(self.spark, f"{self.root}/registry"), {}
        digest = splits.split_digest(final)
        for name in names:
            if name in tasks.REGRESSIONS:
                target, transform, _ = tasks.REGRESSIONS[name]
                rows = final.where(F.col("canonical_resolved_reaction_smiles").isNotNull())
                found = train.train_regression(rows, name, target, "canonical_resolved_reaction_smiles", transform, size=size)
            else:
                task = tasks.MULTILABEL[name]
                found = train.train_multilabel(final.where(task.eligible()), name, task.target, task.text, minimum=task.minimum, most=task.labels, top=task.top, size=size)
            if found.trained:
                train.save(found, f"{self.root}/models/{name}")
                out[name] = registry.register_model(name, self.version, {"metrics": found.metrics, "split_digest": digest})
            else:
                out[name] = registry.register_audit(name, self.version, {"reason": found.reason}, found.reason)
        return out

    def anomaly(self) -> dict:
        return {"anomaly": self._write("index/anomaly", anomaly.fit(self._read("final/steps")))}

    def freeze(self, release: str = "v1.0.0-baseline") -> dict:
        """Freezes the canonical tables as a baseline, once: their digests, and the models moved to their baseline stages (GV8)."""
        registry = Registry(self.spark, f"{self.root}/registry")
        held = registry.release(release)
        if held is not None:
            return held
        models = []
        for row in registry.models().where("status = 'active'").collect():
            stage = tasks.BASELINE_STAGES.get(row["task"], "baseline")
            registry.promote(row["id"], stage, approved=True)
            models.append({"model_id": row["id"], "task": row["task"], "stage": stage})
        digests = {n: tree_digest(self.spark, f"{self.root}/canonical/{n}") for n in ("steps", "routes", "quality_events")}
        return registry.register_release(release, {"release": release, "kind": "baseline", "digests": digests, "models": models})

    def lock(self, release: str) -> dict:
        """Locks a release of the final tables if every gate holds (GV8)."""
        registry = Registry(self.spark, f"{self.root}/registry")
        digests = {n: tree_digest(self.spark, f"{self.root}/{n}") for n in ("final/steps", "final/routes", "index/reactions")}
        return registry.register_release(release, acceptance.lock(self.validation(), digests, release))

    def check_release(self) -> dict:
        """Counts of the canonical tables, and whether they can be released (GV14)."""
        steps, routes = self._read("canonical/steps"), self._read("canonical/routes")
        counts = steps.agg(F.count("*").alias("steps"), F.countDistinct("step_id").alias("step_ids"), F.count_if("parse_ok").alias("parsed"), F.count_if(F.col("split").isNull()).alias("without_split")).first().asDict()
        counts |= routes.agg(F.count("*").alias("routes"), F.countDistinct("route_uid").alias("route_uids")).first().asDict()
        return counts | {"passed": bool(counts["steps"]) and counts["steps"] == counts["step_ids"] and not counts["without_split"]}

    def validation(self) -> dict:
        registry = Registry(self.spark, f"{self.root}/registry", read_only=True)
        return acceptance.accept(self._read("final/steps"), self._read("final/routes"), self._read("context/route_edges"), self._read("index/reactions"), registry)

    def run(self, artifact: str, first: str = "canonical", last: str = "validation") -> dict:
        chosen = STAGES[STAGES.index(first) : STAGES.index(last) + 1]
        return {s: self.canonical(artifact) if s == "canonical" else getattr(self, s)() for s in chosen}
