"""The work queue as immutable frames: a state is the latest row of each item, and a step makes a new state.

Nothing is updated in place, so a step that dies leaves the old state; a retried step gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.operators.reshape import latest_wins

#: Statuses, and terminal errors that put an item in quarantine.
PENDING, RUNNING, MAPPED, EXISTING, LOW, FAILED, TIMEOUT = "pending", "running", "mapped", "existing", "low_confidence", "failed", "timeout"
TERMINAL_ERRORS = ("mcs_timeout", "mcs_error", "mcs_no_mapping", "rxnmapper_sequence_too_long")
LEAST_CONFIDENCE, LEAST_COVERAGE, MOST_TOKENS = 0.50, 0.60, 512


def claim(state: DataFrame, count: int, most_attempts: int = 3, key: str = "item_id") -> DataFrame:
    """The next ``count`` items by key, as running with one more attempt (Q2, SL7).

    Failed items come again while they have attempts left and aren't quarantined (a ``quarantined`` column, if any).
    """
    open_items = state.where((F.col("status") == PENDING) | ((F.col("status") == FAILED) & (F.col("attempts") < most_attempts)))
    if "quarantined" in state.columns:
        open_items = open_items.where(~F.coalesce("quarantined", F.lit(False)))
    return open_items.orderBy(key).limit(count).withColumn("status", F.lit(RUNNING)).withColumn("attempts", F.col("attempts") + 1)


def recover_stale(state: DataFrame, cutoff: Column) -> DataFrame:
    """Running items that began before the cutoff are pending again (Q3)."""
    return state.withColumn("status", F.when((F.col("status") == RUNNING) & (F.col("started") < cutoff), PENDING).otherwise(F.col("status")))


def merge_results(state: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    """The state with each result's present values over it; a null in a result leaves what was there (Q4)."""
    shared = [c for c in state.columns if c != key and c in results.columns]
    fresh = results.select(key, *[F.col(c).alias(f"_{c}") for c in shared])
    joined = state.join(fresh, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in state.columns])


def count_fallback(state: DataFrame, attempted: DataFrame, key: str = "item_id") -> DataFrame:
    """One more fallback attempt for the attempted items (Q5)."""
    marks = attempted.select(key).distinct().withColumn("_tried", F.lit(1))
    return state.join(marks, key, "left").withColumn("fallback_attempts", F.coalesce("fallback_attempts", F.lit(0)) + F.coalesce("_tried", F.lit(0))).drop("_tried")


def current(log: DataFrame, key: str = "item_id", version: str = "version") -> DataFrame:
    """The state that an append-only log of attempts amounts to."""
    return latest_wins(log, [key], [F.desc(version)])


def mapping_status(confidence: Column, coverage: Column, valid: Column, error: Column, tokens: Column) -> Column:
    """A learned mapper's status: over-length and errors fail, then confidence, coverage and validity decide."""
    return (
        F.when(tokens > MOST_TOKENS, FAILED)
        .when(error.isNotNull(), FAILED)
        .when(F.coalesce(valid, F.lit(False)) & (confidence >= LEAST_CONFIDENCE) & (coverage >= LEAST_COVERAGE), MAPPED)
        .otherwise(LOW)
    )


def route_outputs(results: DataFrame) -> dict[str, DataFrame]:
    """The four outputs of a batch of results (SC11): all; fallback tried; not scientifically eligible; exceptions.

    ``results`` has status, backend, fallback_attempted and error.
    """
    passed = F.col("status").isin(MAPPED, EXISTING)
    eligible = passed & (F.col("backend") != "mcs")
    tagged = results.withColumn("passed", passed).withColumn("scientific_eligibility", eligible).withColumn("quarantined", F.coalesce(F.col("error").isin(*TERMINAL_ERRORS), F.lit(False)) & ~passed)
    return {
        "reaction_mappings_rxnmapper": tagged,
        "reaction_mappings_mcs_fallback": tagged.where("fallback_attempted"),
        "reaction_mappings_rejected": tagged.where("not scientific_eligibility"),
        "reaction_mapping_exceptions": tagged.where("fallback_attempted or error = 'rxnmapper_sequence_too_long'"),
    }
