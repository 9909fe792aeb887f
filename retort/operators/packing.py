"""Greedy packing of leakage components into train, val and test."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.session import cut_lineage

FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
#: Components that the packing task holds as Python objects at a time (40 MB). All are packed one by one, in blocks of so many.
PACKED_COMPONENTS = 500_000


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _pack(ordered: Iterable[tuple[str, int]], filled: dict[str, int], room: dict[str, float], seed: int) -> Iterator[str]:
    """Splits of components in the given order; ``filled`` is brought up to date. Only ties need the hash."""
    for component, n in ordered:
        split, least, ties = None, None, False
        for s, r in room.items():
            fill = ((filled[s] + n) / r, filled[s] / r)
            if least is None or fill < least:
                split, least, ties = s, fill, False
            elif fill == least:
                ties = True
        if ties:
            split = min((s for s, r in room.items() if ((filled[s] + n) / r, filled[s] / r) == least), key=lambda s: _hash(f"{seed}|{component}|{s}"))
        filled[split] += n
        yield split


def pack_sizes(sizes: list[tuple[str, int]], seed: int = 42, fractions: dict[str, float] = FRACTIONS, total: int | None = None) -> tuple[dict[str, str], dict[str, int]]:
    """Largest first; each to the split with the least projected fill, then current fill, then a hash."""
    total = sum(n for _, n in sizes) if total is None else total
    filled = dict.fromkeys(fractions, 0)
    room = {s: max(total * f, 1) for s, f in fractions.items()}
    ordered = sorted(sizes, key=lambda x: (-x[1], _hash(f"{seed}|{x[0]}"), x[0]))
    return dict(zip([c for c, _ in ordered], _pack(ordered, filled, room, seed), strict=True)), filled


def pack_components(members: DataFrame, component: str = "component", seed: int = 42, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(component, rows, split), all by the rule of ``pack_sizes``.

    The order of packing is sequential, so one task sorts all sizes, spilling what it can't hold, and packs them as they
    come, a block at a time; none passes through the driver. A null component has no split and is left out.
    """
    text = F.col(component).cast("string").alias("text")
    tie = F.sha2(F.concat(F.lit(f"{seed}|"), text), 256)
    start = F.conv(F.substring(tie, 1, 15), 16, 10).cast("long")  # 60 bits; the whole hash is only worked out where these tie
    sizes = cut_lineage(members.groupBy(component).agg(F.count("*").alias("rows")).withColumn("start", start))  # counted, then packed
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    room = {s: max(total * f, 1) for s, f in fractions.items()}
    block, kind = PACKED_COMPONENTS, sizes.schema[component].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = dict.fromkeys(fractions, 0)
        for batch in batches:
            for part in (batch.slice(at, block) for at in range(0, batch.num_rows, block)):
                texts, rows = part.column("text").to_pylist(), part.column("rows")
                splits = pa.array(list(_pack(zip(texts, rows.to_pylist(), strict=True), filled, room, seed)), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("component"), rows, splits], names=["component", "rows", "split"])

    ordered = sizes.coalesce(1).sortWithinPartitions(F.desc("rows"), "start", tie, F.col(component).cast("string")).select(F.col(component).alias("component"), text, "rows")
    found = ordered.mapInArrow(packed, f"component {kind}, rows long, split string")
    return found.where("component is not null").withColumnRenamed("component", component)
