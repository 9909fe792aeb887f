"""Route lookup and search, and background jobs: what a service front would call (J11, SL3, GV9, GV11)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.operators.windows import search


class Routes:
    """Lookups over the final tables; filters reach the Parquet scans."""

    def __init__(self, routes: DataFrame, steps: DataFrame, edges: DataFrame):
        self.routes, self.steps, self.edges = routes, steps, edges

    def get(self, route_id: str) -> dict | None:
        """A route with its ordered steps and edges as one document."""
        found = self.routes.where(F.col("route_id") == route_id).first()
        if found is None:
            return None
        steps = self.steps.where(F.col("route_id") == route_id).orderBy("step_index", "step_id").collect()
        edges = self.edges.where(F.col("route_id") == route_id).orderBy("source_step_index").collect()
        return found.asDict(True) | {"steps": [s.asDict(True) for s in steps], "edges": [e.asDict(True) for e in edges]}

    def find(self, text: str = "", split: str | None = None, least_quality: float = 0.0, limit: int = 20, after: str | None = None) -> list[dict]:
        """Routes whose id or patent holds the text, in order of id, after one if given."""
        hit = F.lit(True) if not text else (F.contains(F.lower("route_id"), F.lit(text.lower())) | F.contains(F.lower("patent_document_id"), F.lit(text.lower())))
        if split:
            hit = hit & (F.col("split") == split)
        hit = hit & (F.coalesce("route_quality_score", F.lit(0.0)) >= least_quality)
        return [r.asDict(True) for r in search(self.routes, hit, ["route_id"], limit, F.col("route_id") > after if after is not None else None).collect()]


class Jobs:
    """Two jobs at a time; each runs under its id as Spark job group, so it can be cancelled."""

    def __init__(self, spark: SparkSession, threads: int = 2):
        self.spark, self.pool, self.jobs = spark, ThreadPoolExecutor(threads), {}

    def submit(self, work: Callable[[], object]) -> str:
        ident = uuid.uuid4().hex

        def run():
            self.spark.sparkContext.setJobGroup(ident, ident, interruptOnCancel=True)
            return work()

        self.jobs[ident] = self.pool.submit(run)
        return ident

    def state(self, ident: str) -> dict:
        job: Future = self.jobs[ident]
        if not job.done():
            return {"status": "running" if job.running() else "queued"}
        problem = job.exception()
        return {"status": "failed", "error": str(problem)} if problem else {"status": "completed", "result": job.result()}

    def cancel(self, ident: str) -> None:
        self.jobs[ident].cancel()
        self.spark.sparkContext.cancelJobGroup(ident)
