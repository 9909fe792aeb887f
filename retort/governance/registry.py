"""The registry as an append-only log of JSON facts; its tables are the latest fact of each key (GV6, GV7, ST3).

Registry rows are few and written by one driver, so a table is a folder of small Parquet files with a version column.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.operators.reshape import latest_wins

FACT = "kind string, id string, task string, dataset_version string, stage string, status string, payload string, created double, sequence long"
#: Stages that a model may be served from, and those that need consent.
SERVED = ("production", "staging", "screening", "baseline")
WITH_CONSENT = ("validated", "experimental", "candidate")
GUARDED = ("production", "staging")


class ReadOnly(PermissionError):
    pass


class Registry:
    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False):
        self.spark, self.folder, self.read_only = spark, folder, read_only

    def _append(self, kind: str, ident: str, **values) -> str:
        if self.read_only:
            raise ReadOnly(f"{kind} {ident}")
        payload = json.dumps(values.pop("payload", {}), sort_keys=True, default=str)
        row = (kind, ident, values.get("task"), values.get("dataset_version"), values.get("stage"), values.get("status"), payload, time.time(), time.time_ns())
        self.spark.createDataFrame([row], FACT).coalesce(1).write.mode("append").parquet(f"{self.folder}/facts")
        return ident

    def facts(self) -> DataFrame:
        """All facts; empty before the first."""
        try:
            return self.spark.read.schema(FACT).parquet(f"{self.folder}/facts")
        except Exception as problem:
            if "PATH_NOT_FOUND" in str(problem):
                return self.spark.createDataFrame([], FACT)
            raise

    def current(self, kind: str) -> DataFrame:
        return latest_wins(self.facts().where(F.col("kind") == kind), ["id"], [F.desc("sequence")])

    def register_dataset(self, version: str, manifest: dict) -> str:
        return self._append("dataset", version, dataset_version=version, status="active", payload=manifest)

    def register_run(self, name: str, result: dict, status: str = "completed") -> str:
        return self._append("run", f"{name}-{uuid.uuid4().hex[:12]}", status=status, payload=result)

    def register_audit(self, task: str, version: str, result: dict, reason: str) -> str:
        """A record of a task that isn't trained (ML8)."""
        return self._append("audit", f"{task}-{version}", task=task, dataset_version=version, status=reason, payload=result)

    def register_model(self, task: str, version: str, card: dict, stage: str = "candidate") -> str:
        """A new active model; those of the same task and dataset before it are superseded."""
        ident = f"{task}-{uuid.uuid4().hex[:12]}"
        for row in self.models().where((F.col("task") == task) & (F.col("dataset_version") == version) & (F.col("status") == "active")).collect():
            self._append("model", row["id"], task=task, dataset_version=version, stage=row["stage"], status="superseded", payload=json.loads(row["payload"]))
        return self._append("model", ident, task=task, dataset_version=version, stage=stage, status="active", payload=card)

    def register_release(self, name: str, manifest: dict) -> dict:
        """A release's manifest; one name is registered once."""
        if self.release(name) is not None:
            raise PermissionError(f"{name} is locked")
        self._append("release", name, status="locked", payload=manifest)
        return manifest

    def release(self, name: str) -> dict | None:
        row = self.current("release").where(F.col("id") == name).first()
        return json.loads(row["payload"]) if row else None

    def models(self) -> DataFrame:
        return self.current("model")

    def promote(self, ident: str, stage: str, approved: bool = False) -> None:
        """Moves a model to a stage; production and staging need an approved decision."""
        if stage in GUARDED and not approved:
            raise PermissionError(f"{stage} needs an approved decision")
        row = self._one(ident)
        self._append("model", ident, task=row["task"], dataset_version=row["dataset_version"], stage=stage, status=row["status"], payload=json.loads(row["payload"]))

    def invalidate_other_splits(self, version: str, digest: str) -> int:
        """Active models of a dataset that were trained on another split are invalid; how many."""
        rows = self.models().where((F.col("dataset_version") == version) & (F.col("status") == "active")).collect()
        stale = [r for r in rows if json.loads(r["payload"]).get("split_digest") != digest]
        for r in stale:
            self._append("model", r["id"], task=r["task"], dataset_version=version, stage=r["stage"], status="invalidated", payload=json.loads(r["payload"]))
        return len(stale)

    def resolve(self, task: str, experimental: bool = False) -> dict | None:
        """The newest active model of the best served stage."""
        allowed = [*SERVED, *(WITH_CONSENT if experimental else ())]
        rows = self.models().where((F.col("task") == task) & (F.col("status") == "active") & F.col("stage").isin(allowed)).collect()
        return max(rows, key=lambda r: (-allowed.index(r["stage"]), r["sequence"])).asDict() if rows else None

    def normalise(self) -> int:
        """Only the newest model of each task and dataset stays active; older ones are archived; how many."""
        active = self.models().where("status = 'active'")
        newest = latest_wins(active, ["task", "dataset_version"], [F.desc("created"), F.desc("sequence")]).select("id")
        old = active.join(newest, "id", "left_anti").collect()
        for r in old:
            self._append("model", r["id"], task=r["task"], dataset_version=r["dataset_version"], stage=r["stage"], status="archived", payload=json.loads(r["payload"]))
        return len(old)

    def _one(self, ident: str) -> dict:
        row = self.models().where(F.col("id") == ident).first()
        if row is None:
            raise KeyError(ident)
        return row.asDict()
