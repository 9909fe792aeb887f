"""The mapping stage: a pluggable backend over eligible candidates, guarded by token length, with a bounded fallback."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.chem import reaction
from retort.operators.queue import EXISTING, FAILED, LEAST_CONFIDENCE, LEAST_COVERAGE, LOW, MAPPED, MOST_TOKENS, TIMEOUT, route_outputs
from retort.schemas import MAPPING


class MappingBackend(Protocol):
    """Maps texts in batches: (mapped text, confidence) each; raises for a batch that it can't do."""

    name: str

    def map_batch(self, texts: list[str]) -> list[tuple[str, float]]: ...


def count_tokens(text: str) -> int:
    """Tokens of a reaction text as a learned mapper would see them: atoms, bonds, digits and two special ones."""
    import re

    return len(re.findall(r"\[[^\]]*\]|Br|Cl|>>|%\d\d|.", text)) + 2


def map_recursively(backend: MappingBackend, texts: list[str]) -> list[tuple[str | None, float, str | None]]:
    """(mapped, confidence, error) of each text; a failing batch is halved until the bad text stands alone (Q8)."""
    if not texts:
        return []
    try:
        return [(m, c, None) for m, c in backend.map_batch(texts)]
    except Exception as problem:  # noqa: BLE001  any failure of a plugged-in backend is a result
        if len(texts) == 1:
            return [(None, 0.0, f"{backend.name}_error: {type(problem).__name__}")]
        half = len(texts) // 2
        return map_recursively(backend, texts[:half]) + map_recursively(backend, texts[half:])


def _child(send, function, argument) -> None:
    send.send(function(argument))


def bounded(function: Callable, argument, seconds: float):
    """The function's result, or None after so many seconds, when its process is killed (Q9)."""
    context = multiprocessing.get_context("fork")
    receive, send = context.Pipe(False)
    process = context.Process(target=_child, args=(send, function, argument), daemon=True)
    process.start()
    try:
        return receive.recv() if receive.poll(seconds) else None
    except EOFError:
        return None
    finally:
        process.kill()
        process.join()


@dataclass(frozen=True)
class MappingConfig:
    backend: MappingBackend | None = None  # None: existing maps, then the fallback
    fallback: bool = True
    batch: int = 32
    token_limit: int = MOST_TOKENS
    seconds: float = 5.0
    tokens: Callable[[str], int] = count_tokens


class Surroundings:
    """The fallback as a backend."""

    name = "mcs"

    def map_batch(self, texts: list[str]) -> list[tuple[str, float]]:
        return [(m.reaction, m.confidence) for m in map(reaction.map_by_surroundings, texts)]


def preflight(config: MappingConfig, probe: str = "CCO>>CC=O") -> str:
    """Fails before anything is written if the backend doesn't map a known reaction; its name otherwise (GV15)."""
    if config.backend is None:
        if not config.fallback:
            raise RuntimeError("no backend and no fallback")
        return "fallback"
    (result,) = map_recursively(config.backend, [probe])
    if result[2] is not None:
        raise RuntimeError(f"the mapping backend fails: {result[2]}")
    return config.backend.name


def _rows(config: MappingConfig, texts: list[str]) -> list[tuple]:
    out: list[tuple | None] = [None] * len(texts)
    todo = []
    for i, text in enumerate(texts):
        length = config.tokens(text)
        first = reaction.map_reaction(text) if ":" in text else None
        if first is not None and first.status == EXISTING:
            out[i] = (EXISTING, first.reaction, "existing", 1.0, first.coverage, None, length, False)
        elif config.backend is not None and length > config.token_limit:
            out[i] = (FAILED, None, config.backend.name, 0.0, 0.0, f"{config.backend.name}_sequence_too_long", length, False)
        else:
            todo.append(i)
    if config.backend is not None:
        for low in range(0, len(todo), config.batch):
            part = todo[low : low + config.batch]
            for i, (mapped, confidence, error) in zip(part, map_recursively(config.backend, [texts[i] for i in part]), strict=True):
                if error is None:
                    check = reaction.map_reaction(mapped)
                    good = check.status == EXISTING and confidence >= LEAST_CONFIDENCE and check.coverage >= LEAST_COVERAGE
                    out[i] = (MAPPED if good else LOW, mapped, config.backend.name, confidence, check.coverage, None, config.tokens(texts[i]), False)
                else:
                    out[i] = (FAILED, None, config.backend.name, 0.0, 0.0, error, config.tokens(texts[i]), False)
    if config.fallback:
        for i, row in enumerate(out):
            if row is None or row[0] == FAILED:
                found = bounded(reaction.map_by_surroundings, texts[i], config.seconds) if config.backend is not None else reaction.map_by_surroundings(texts[i])
                if found is None:
                    out[i] = (TIMEOUT, None, "mcs", 0.0, 0.0, "mcs_timeout", config.tokens(texts[i]), True)
                else:
                    out[i] = (found.status, found.reaction, "mcs", found.confidence, found.coverage, found.error, config.tokens(texts[i]), True)
    return [r if r is not None else (FAILED, None, "none", 0.0, 0.0, "no_backend", 0, False) for r in out]


def map_candidates(candidates: DataFrame, config: MappingConfig = MappingConfig()) -> DataFrame:
    """Mapping columns for each candidate (CH10, Q7-Q11). Each distinct reaction is mapped once and joined back."""
    names = [x.split()[0] for x in MAPPING.split(", ")]
    eligible = candidates.where("eligibility_status = 'eligible'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame(_rows(config, batch["reaction_smiles"].tolist()), columns=names)
            frame.insert(0, "reaction_smiles", batch["reaction_smiles"].to_numpy())
            yield frame

    mapped = eligible.select("reaction_smiles").distinct().mapInPandas(run, f"reaction_smiles string, {MAPPING}")
    fresh = candidates.drop("mapping_status").join(mapped, "reaction_smiles", "left")
    status = F.when(F.col("eligibility_status") == "eligible", F.coalesce("mapping_status", F.lit(FAILED))).otherwise("not_eligible")
    return fresh.withColumn("mapping_status", status).withColumn("validation_status", F.when(status.isin(MAPPED, EXISTING), "passed").otherwise("rejected"))


def outputs(mapped: DataFrame) -> dict[str, DataFrame]:
    """The stage's four datasets."""
    renamed = mapped.withColumn("status", F.col("mapping_status")).withColumn("error", F.col("error_code"))
    return {name: frame.drop("status", "error") for name, frame in route_outputs(renamed.withColumn("fallback_attempted", F.coalesce("fallback_attempted", F.lit(False)))).items()}


def benchmark(candidates: DataFrame, backend: MappingBackend, sizes: tuple[int, ...] = (8, 16, 32, 64), rows: int = 512) -> list[dict]:
    """Throughput and batch times of a backend on the driver over the first rows, and which batch size is best."""
    import statistics
    import time

    texts = [r[0] for r in candidates.where("eligibility_status = 'eligible'").orderBy("reaction_smiles").limit(rows).select("reaction_smiles").collect()]
    out = []
    for size in sizes:
        times = []
        for low in range(0, len(texts), size):
            began = time.perf_counter()
            map_recursively(backend, texts[low : low + size])
            times.append(time.perf_counter() - began)
        out.append({"batch": size, "per_second": len(texts) / max(sum(times), 1e-9), "median_s": statistics.median(times) if times else 0.0, "p95_s": sorted(times)[int(0.95 * (len(times) - 1))] if times else 0.0})
    best = max(out, key=lambda r: r["per_second"], default=None)
    return [r | {"recommended": r is best} for r in out]
