"""Connected components by randomised contraction, all in DataFrames.

Every round each node picks the neighbour (or itself) of the least hash, a hash of its own in each round, and edges are
redrawn between the picks. Whatever the graph's shape, long paths and hubs included, a third of the nodes at least is
expected to go with each round, so all rounds together cost a few times the first. A graph of SMALL_GRAPH edges or fewer,
a size that is counted first, is settled in one task. The picks are then read back from the last round to the first.

Lineage is cut with a reliable checkpoint each round; only one count a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.session import cut_lineage

#: Edges that one task settles (some 40 MB there).
SMALL_GRAPH = 200_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node on the edges (a, b): a union-find."""
    lead: dict = {}
    kind = None

    def find(x):
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            lead.setdefault(a, a), lead.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                lead[max(a, b)] = min(a, b)
    if lead:
        yield pa.RecordBatch.from_arrays([pa.array(list(lead), kind), pa.array([find(x) for x in lead], kind)], names=["node", "root"])


def _lows(picks: DataFrame) -> DataFrame:
    """(node, low): the picked nodes with the least original node that came to them."""
    return cut_lineage(picks.groupBy(F.col("head").alias("node")).agg(F.min("low").alias("low")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes are those on an edge.

    Self loops keep isolated nodes. Edges with a null end are ignored. Raises if ``max_rounds`` do not suffice.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut_lineage(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    kind = both.schema["a"].dataType.simpleString()
    lows: list[DataFrame | None] = [None]  # of each round's nodes; the first's are their own
    picks: list[DataFrame] = []
    while not picks or both.count() > 2 * SMALL_GRAPH:
        if len(picks) == max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        salt = F.lit(len(picks))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64(salt, "b").alias("h"), F.col("b").alias("n"))).alias("m"))
        head = F.least("m", F.struct(F.xxhash64(salt, "node").alias("h"), F.col("node").alias("n")))["n"]
        picked = near.select("node", head.alias("head"))
        picked = picked.withColumn("low", F.col("node")) if lows[-1] is None else picked.join(lows[-1], "node")
        picks.append(cut_lineage(picked))
        lows.append(_lows(picks[-1]))
        a, b = (picks[-1].select(F.col("node").alias(x), F.col("head").alias(f"{x}_head")) for x in "ab")
        both = cut_lineage(both.join(a, "a").join(b, "b").where("a_head <> b_head").select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).distinct())
    roots = cut_lineage(both.where("a < b").coalesce(1).mapInArrow(_settle, f"node {kind}, root {kind}"))
    joined = roots.join(lows[-1], "node")
    found = joined.join(joined.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "component")
    for low, picked in zip(reversed(lows[1:]), reversed(picks), strict=True):
        settled = cut_lineage(low.join(found, "node", "left").select(F.col("node").alias("head"), F.coalesce("component", "low").alias("component")))
        found = picked.join(settled, "head").select("node", "component")
    return cut_lineage(found)


def sharing(frame: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """The rows of ``frame`` whose keys another node has as well; rows with a null in these or the node are not. One shuffle."""
    group = Window.partitionBy(*keys)
    full = frame.dropna(subset=[node, *keys])
    return full.withColumns({"_least": F.min(node).over(group), "_most": F.max(node).over(group)}).where("_least < _most").drop("_least", "_most")


def stars(frame: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(src, dst): from the least node of the same keys to each other one; a key of one node only takes no edge."""
    full = frame.dropna(subset=[node, *keys]).withColumn("_least", F.min(node).over(Window.partitionBy(*keys)))
    return full.where(F.col("_least") < F.col(node)).select(F.col("_least").alias("src"), F.col(node).alias("dst"))
