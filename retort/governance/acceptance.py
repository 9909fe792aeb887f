"""Integrity counters, acceptance gates, release locks and the identity audit (GV3-GV5, GV8, GV13, GV14, J9, J10, A27)."""

from __future__ import annotations

import hashlib
import json
import platform
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.governance import leakage
from retort.operators import aggregates, identity

LEAST_RECALL, MOST_SECONDS, QUERIES = 0.95, 10.0, 50


def integrity(steps: DataFrame, routes: DataFrame, edges: DataFrame) -> dict[str, int]:
    """Counters that must be 0 for a sound dataset, and sizes."""
    ids = steps.agg(F.count("*").alias("steps"), F.countDistinct("step_id").alias("ids"), F.countDistinct("route_id").alias("routes")).first()
    of_steps = steps.groupBy("route_id").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.count("*").alias("n"))
    of_routes = routes.select("route_id", F.col("split").alias("route_split"), F.col("step_count"))
    compared = of_steps.join(of_routes, "route_id", "full_outer")
    rows = aggregates.counters(
        compared,
        {
            "routes_without_steps": F.col("n").isNull(),
            "steps_without_route": F.col("route_split").isNull() & F.col("n").isNotNull(),
            "routes_in_two_splits": F.col("low") != F.col("high"),
            "route_split_mismatch": F.col("route_split") != F.col("low"),
            "step_count_mismatch": F.col("step_count") != F.col("n"),
        },
    ).first()
    ends = steps.select("step_id", F.col("route_id").alias("r"))
    joined = edges.join(ends.select(F.col("step_id").alias("source_step_id"), F.col("r").alias("source_route")), "source_step_id", "left").join(
        ends.select(F.col("step_id").alias("target_step_id"), F.col("r").alias("target_route")), "target_step_id", "left"
    )
    on_edges = aggregates.counters(
        joined,
        {
            "edges_without_step": F.col("source_route").isNull() | F.col("target_route").isNull(),
            "cross_route_edges": (F.col("source_route") != F.col("target_route")) | (F.col("source_route") != F.col("route_id")),
        },
    ).first()
    out = {"steps": ids["steps"], "repeated_step_ids": ids["steps"] - ids["ids"]}
    return out | {k: v for k, v in rows.asDict().items() if k != "rows"} | {k: v for k, v in on_edges.asDict().items() if k != "rows"}


def retrieval(index: DataFrame, queries: int = QUERIES, k: int = 10) -> dict:
    """Recall of the first rows against all, and seconds a query of the batch search."""
    from retort.stages.index import benchmark

    began = time.perf_counter()
    row = benchmark(index, queries, k).first().asDict()
    seconds = (time.perf_counter() - began) / max(row["queries"], 1)
    return row | {"seconds_per_query": seconds, "passed": (row["self_recall"] or 0) >= LEAST_RECALL and seconds < MOST_SECONDS}


def accept(steps: DataFrame, routes: DataFrame, edges: DataFrame, index: DataFrame, registry=None, required: tuple[str, ...] = ()) -> dict:
    """All gates and whether they hold. Validation reads the registry and doesn't write to it."""
    before = registry.facts().count() if registry else None
    counts = integrity(steps, routes, edges)
    sound = not any(v for k, v in counts.items() if k not in ("steps",))
    leaks = leakage.audit(steps)
    found = retrieval(index)
    missing = []
    if registry:
        settled = {r["task"] for r in registry.models().where("status = 'active'").select("task").collect()} | {r["task"] for r in registry.current("audit").select("task").collect()}
        missing = sorted(set(required) - settled)
    gates = {
        "integrity": sound,
        "leakage": leaks.strict,
        "index": index.where("reactant is null or product is null").isEmpty() and not index.isEmpty(),
        "retrieval": found["passed"],
        "models": not missing,
        "registry_unchanged": registry is None or registry.facts().count() == before,
    }
    return {"gates": gates, "accepted": all(gates.values()), "integrity": counts, "retrieval": found, "missing_tasks": missing, "leakage": [r.asDict() for r in leaks.counts.collect()]}


def environment() -> dict[str, str]:
    """Versions that a model is pinned to (GV10)."""
    import numpy
    import pyarrow
    import pyspark

    return {"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__}


def lock(report: dict, digests: dict[str, str], version: str) -> dict:
    """A release lock: refuses a report that isn't accepted; its own digest covers everything else (GV8)."""
    if not report["accepted"]:
        raise PermissionError(f"gates not met: {sorted(k for k, v in report['gates'].items() if not v)}")
    body = {"version": version, "digests": digests, "gates": report["gates"], "environment": environment()}
    return body | {"lock": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def verify_lock(locked: dict) -> bool:
    body = {k: v for k, v in locked.items() if k != "lock"}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() == locked["lock"]


def identity_report(routes: DataFrame, steps: DataFrame, assigned: DataFrame) -> dict[str, int]:
    """Counts of source routes, variants and assignments (GV13)."""
    groups = identity.repeated_keys(routes, "source_route_id").agg(F.count("*").alias("duplicate_source_route_groups"), F.coalesce(F.sum("rows") - F.count("*"), F.lit(0)).alias("variant_rows")).first().asDict()
    sizes = routes.agg(F.count("*").alias("routes"), F.countDistinct("source_route_id").alias("source_routes")).first().asDict()
    return sizes | groups | identity.assignment_audit(steps, assigned).first().asDict() | {"steps": steps.count()}


def route_audit(routes: DataFrame, steps: DataFrame) -> dict[str, int]:
    """Counts of canonical routes: repeated ids, and routes without steps and steps without a route (GV13)."""
    ids = routes.groupBy("route_id").agg(F.count("*").alias("n"))
    sizes = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("routes"), F.count("*").alias("source_routes"), F.count_if(F.col("n") > 1).alias("duplicate_source_route_groups")).first().asDict()
    of_steps = steps.groupBy("route_id").agg(F.count("*").alias("steps"))
    both = ids.join(of_steps, "route_id", "full_outer")
    found = both.agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.count_if(F.col("steps").isNull()).alias("routes_without_steps"), F.count_if(F.col("n").isNull()).alias("steps_without_route")).first().asDict()
    return sizes | {"variant_rows": sizes["routes"] - sizes["source_routes"]} | found
