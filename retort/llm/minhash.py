"""MinHash near-duplicate detection with b-bit signatures.

1. One pass over the texts makes a sketch of each: 128 minima over its shingle set, banded 32 x 4 into
   64-bit bucket keys, and the low 4 bits of each minimum packed as bit planes (64 bytes).
2. Texts with one shingle set are one node (a digest of the set), however many copies there are.
3. Nodes that share a bucket are candidates. A collision-corrected estimate from bit counts of the planes
   screens them; the survivors are confirmed on their full shingle sets.
4. Confirmed links become components.

A pair at similarity 0.8 misses all bands with probability (1 - 0.8**4)**32 < 5e-8 and falls under the
screen (five standard deviations below) about as rarely. Candidates are first taken as stars (each node with
the least node it meets), which is linear in a bucket's size. A bucket's other pairs matter only between nodes
that the stars left in different components. Where such a bucket is small, its pairs that pass the screen are
confirmed by a join. A larger one is dealt into blocks of bounded size, and each task confirms the pairs of two blocks
on their sets and returns only links that unite components, so no list of pairs is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.textbatch import BLANKS, Slice, map_batches, mix, seeds, text_slices
from retort.operators.components import connected_components
from retort.session import cut_lineage

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Keys of so many documents at most (24 MB) are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Buckets of more nodes are worked on in blocks of about so many nodes or bytes of sets.
SMALL_BUCKET, BLOCK_NODES, BLOCK_BYTES = 64, 768, 8_000_000

_odd = seeds(HASHES, 101) | np.uint64(1)
_add = seeds(HASHES, 202)
_fold = seeds(16, 303) | np.uint64(1)


def shingle_sets(part: Slice, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row in slice, sorted distinct shingle hashes) of each text; fewer words than ``width`` make one shingle."""
    starts, ends = part.words(BLANKS)
    words = part.hashes(starts, ends, "folded")
    bounds = np.searchsorted(starts, part.offsets)
    wide = np.zeros(0, np.uint64)
    if len(words) >= width:
        wide = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            wide += words[i : len(words) - width + 1 + i] * _fold[i]
        wide = mix(wide)
    for row in range(len(part)):
        low, high = bounds[row], bounds[row + 1]
        if high - low >= width:
            yield row, np.unique(wide[low : high - width + 1])
        elif high > low:
            salt = np.uint64(high - low)
            yield row, mix(np.array([(words[low:high] * _fold[: high - low]).sum(dtype=np.uint64) + salt]))
        else:
            yield row, np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for low in range(0, len(shingles), 4096):
        block = shingles[low : low + 4096]
        np.minimum(best, (block[None, :] * _odd[:, None] + _add[:, None]).min(axis=1), out=best)
    return best


def bit_planes(best: np.ndarray) -> list[int]:
    """The low bits (below the bits that order the minima, remixed) as BITS planes of two signed 64-bit words."""
    low = mix(best) & np.uint64((1 << BITS) - 1)
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(">i8") for b in range(BITS)]
    return [int(x) for plane in planes for x in plane]


PLANES = [f"p{i}" for i in range(BITS * HASHES // 64)]
SKETCH = "doc_id long, key long, node binary, n_shingles long, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys_of = batch.column("doc_id"), batch.column("key")
            for part in text_slices(batch.column("text")):
                nodes, sizes, bands, planes = [], [], [], []
                for _, shingles in shingle_sets(part, width):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        nodes.append(None), bands.append([]), planes.append([None] * len(PLANES))
                        continue
                    best = minima(shingles)
                    grouped = best.reshape(BANDS, ROWS)
                    keys = mix((grouped * _fold[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                    nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    bands.append(keys.view(np.int64))
                    planes.append(bit_planes(best))
                columns = list(zip(*planes, strict=True)) if planes else [[]] * len(PLANES)
                yield pa.RecordBatch.from_arrays(
                    [ids[slice(*part.rows)].cast(pa.int64()), keys_of[slice(*part.rows)], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                    + [pa.array(x, pa.int64()) for x in columns],
                    names=["doc_id", "key", "node", "n_shingles", "bands", *PLANES],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                found = [shingles for _, shingles in shingle_sets(part, width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["node", "members"],
                )

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            shared.append(int((b[np.minimum(at, len(b) - 1)] == a).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(shared, pa.int64())], names=["src", "dst", "shared"])


def estimated_similarity(left: str, right: str) -> Column:
    """Jaccard estimate from two rows' planes: share of equal low-bit groups, corrected for chance collisions."""
    matches = []
    for word in range(HASHES // 64):
        same = [F.bitwise_not(F.col(f"{left}.p{b * (HASHES // 64) + word}").bitwiseXOR(F.col(f"{right}.p{b * (HASHES // 64) + word}"))) for b in range(BITS)]
        matches.append(F.bit_count(reduce(lambda x, y: x.bitwiseAND(y), same)))
    share = reduce(lambda x, y: x + y, matches) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def screen(threshold: float) -> float:
    """Five standard deviations below the threshold."""
    return threshold - 5 * (threshold * (1 - threshold) / HASHES) ** 0.5


def _linker(percent: int):
    """Links between the nodes of two blocks of a bucket (or within one) that unite components, best estimates first."""
    floor = screen(percent / 100)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        band = rows.column("band")[0].as_py()
        side = rows.column("side").to_numpy()
        names = rows.column("node").to_pylist()
        _, group = np.unique(np.array(rows.column("component").to_pylist(), "S16"), return_inverse=True)
        size = rows.column("n_shingles").to_numpy()
        planes = np.stack([rows.column(p).to_numpy() for p in PLANES], axis=1).view(np.uint64)
        keys = np.array(rows.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if side.any() else first
        same = np.zeros((len(first), len(second)), np.int16)
        words = HASHES // 64
        for w in range(words):
            agree = np.full((len(first), len(second)), np.uint64(0xFFFFFFFFFFFFFFFF))
            for b in range(BITS):
                agree &= ~(planes[first, b * words + w][:, None] ^ planes[second, b * words + w][None, :])
            same += np.bitwise_count(agree)
        chance = 2.0**-BITS
        wanted = (same / HASHES - chance) / (1 - chance) >= floor
        wanted &= group[first][:, None] != group[second][None, :]
        wanted &= 100 * np.minimum(size[first][:, None], size[second][None, :]) >= percent * np.maximum(size[first][:, None], size[second][None, :])
        for b in range(band):  # a pair belongs to the first bucket that it shares
            wanted &= keys[first, b][:, None] != keys[second, b][None, :]
        if not side.any():
            wanted &= np.arange(len(first))[:, None] < np.arange(len(second))[None, :]
        x, y = np.nonzero(wanted)
        order = np.argsort(-same[x, y], kind="stable")
        lead = list(range(int(group.max(initial=0)) + 1))

        def find(g: int) -> int:
            while lead[g] != g:
                lead[g] = lead[lead[g]]
                g = lead[g]
            return g

        source, target = [], []
        for i, j in zip(first[x[order]].tolist(), second[y[order]].tolist(), strict=True):
            u, v = find(group[i]), find(group[j])
            if u == v:
                continue
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                lead[u] = v
                source.append(names[i]), target.append(names[j])
        return pa.table({"src": pa.array(source, pa.binary()), "dst": pa.array(target, pa.binary())})

    return run


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, members) of the wanted nodes; only their texts are made into sets."""
    wanted = cut_lineage(nodes.join(wanted, "node", "left_semi").select("node", "key"))
    few = wanted.count() <= BROADCAST_KEYS
    texts = docs.join(F.broadcast(wanted.select("key")) if few else wanted.select("key"), "key", "left_semi").select("text")
    sets = map_batches(texts, _sets(width), "node binary, members binary")
    return cut_lineage(sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("members").alias("members")))


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (src, dst) whose full sets reach the threshold."""
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst"))).distinct()
    sets = _sets_of(docs, nodes, ends, width)
    both = (
        pairs.join(sets.select(F.col("node").alias("src"), F.col("members").alias("left")), "src")
        .join(sets.select(F.col("node").alias("dst"), F.col("members").alias("right")), "dst")
        .select("src", "dst", "left", "right")
    )
    # a pair whose sizes alone rule the threshold out need not be intersected
    fit = both.where(100 * F.least(F.octet_length("left"), F.octet_length("right")) >= percent * F.greatest(F.octet_length("left"), F.octet_length("right")))
    counted = map_batches(fit.select("src", "dst", "left", "right"), _overlap, "src binary, dst binary, shared long")
    sizes = nodes.select("node", "n_shingles")
    return cut_lineage(
        counted.join(sizes.select(F.col("node").alias("src"), F.col("n_shingles").alias("n_src")), "src")
        .join(sizes.select(F.col("node").alias("dst"), F.col("n_shingles").alias("n_dst")), "dst")
        .where(100 * F.col("shared") >= percent * (F.col("n_src") + F.col("n_dst") - F.col("shared")))
        .select("src", "dst")
    )


def _block_links(docs: DataFrame, nodes: DataFrame, crowded: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (src, dst) between the components that meet in the crowded buckets."""
    sets = _sets_of(docs, nodes, crowded.select("node").distinct(), width).join(nodes.select("node", "bands"), "node")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(8 * F.col("shingles") / BLOCK_BYTES))
    # joined before they are dealt out, so that a node in many blocks is one row of the join for each bucket
    dealt = (
        crowded.withColumn("blocks", blocks)
        .drop("members")
        .join(sets, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", ((F.col("own") == F.col("j")) & (F.col("i") < F.col("j"))).cast("int"))
    )
    columns = ["band", "side", "node", "component", "n_shingles", *PLANES, "bands", "members"]
    found = dealt.select("bucket", "i", "j", *columns).groupBy("bucket", "i", "j").applyInArrow(_linker(percent), "src binary, dst binary")
    return cut_lineage(found)


def _key(doc_id: Column, text: Column) -> Column:
    """Finds a row's text again: a hash of id and text, which rows without an id have too. Rows that share one are told apart by what else is known of them."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, component, component_id) of every row; component, a node, is null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    sketches = cut_lineage(map_batches(docs, _sketch(width), SKETCH))
    nodes = cut_lineage(
        sketches.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), *[F.first(p).alias(p) for p in PLANES])
    )
    banded = sketches.where("node is not null").select("node", F.posexplode("bands").alias("band", "bucket"))
    meetings = cut_lineage(banded.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail"))
    shared = cut_lineage(banded.join(meetings, "bucket").groupBy("bucket", "band", "node", "head").agg(F.lit(1).alias("one")).drop("one"))

    pairs = shared.where("node > head").select(F.col("node").alias("dst"), F.col("head").alias("src")).distinct()
    x, y = nodes.alias("x"), nodes.alias("y")
    stars = (
        pairs.join(x, F.col("src") == F.col("x.node"))
        .join(y, F.col("dst") == F.col("y.node"))
        .where(estimated_similarity("x", "y") >= screen(percent / 100))
        .groupBy("dst")
        .agg(F.min("src").alias("src"))
        .select("src", "dst")
    )
    first_links = _confirmed(docs, nodes, cut_lineage(stars), width, percent)
    first_groups = connected_components(first_links)

    grouped = nodes.join(first_groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    inside = shared.select("bucket", "band", "node").join(grouped.select("node", "component", "n_shingles", *PLANES), "node")
    split = (
        inside.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
        .where("low < high")
        .select("bucket", "members", "shingles")
    )
    open_rows = cut_lineage(inside.join(split, "bucket"))
    left, right = (open_rows.where(F.col("members") <= SMALL_BUCKET).alias(x) for x in "lr")
    rest = (
        left.join(right, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") < F.col("r.component")) & (estimated_similarity("l", "r") >= screen(percent / 100)))
        .select(F.col("l.node").alias("src"), F.col("r.node").alias("dst"))
        .distinct()
    )
    more_links = _confirmed(docs, nodes, cut_lineage(rest), width, percent)
    block_links = _block_links(docs, nodes, open_rows.where(F.col("members") > SMALL_BUCKET), width, percent)
    groups = connected_components(first_links.union(more_links).union(block_links))

    labelled = cut_lineage(nodes.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = cut_lineage(labelled.groupBy("component").agg(F.min("rep").alias("component_id")))  # written, so that the next join can split a large component
    named = labelled.join(least, "component").select("node", "component", "component_id")
    return (
        sketches.select("doc_id", "key", "n_shingles", "node")
        .join(named, "node", "left")
        .select("doc_id", "key", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, any other columns).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Texts are linked when
    100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id reachable and
    kept marks the row that bears it. Null and empty texts have no shingles, are linked with nothing and stay.
    Rows that repeat a doc_id are separate texts under one id. A null doc_id takes the component's least
    non-null id, and links as any other; its row is kept only if the component has none. An empty table gives an empty result.
    """
    found = _grouped(docs, width, percent).drop("key", "component")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least doc_id, then of the least hash of id and text.

    Rows without an id come after all others. Of rows with one id and text one stays. Rows without shingles (null, empty,
    blank texts) stay, whatever repeats.
    """
    unset = -(2**63)
    judged = cut_lineage(_grouped(docs, width, percent).where("component is not null").select(F.coalesce("doc_id", F.lit(unset)).alias("id"), "key", "component", F.struct(F.col("doc_id").isNull(), "doc_id", "key").alias("order")))
    best = cut_lineage(judged.groupBy("component").agg(F.min("order").alias("best")))
    same = judged.groupBy("component", "id", "key", "order").agg(F.count("*").alias("n")).join(best, "component")
    marked = cut_lineage(same.where("n > 1 or order <> best").select("id", "key", (F.col("order") != F.col("best")).alias("gone")))
    few = marked.count() <= BROADCAST_KEYS
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(unset)).alias("id"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    kept = rows.join(F.broadcast(marked) if few else marked, ["id", "key"], "left").where("not coalesce(gone, false)")
    repeated = kept.where("gone is not null").dropDuplicates(["id", "key"])  # the best rows that repeat
    return kept.where("gone is null").select("row.*").unionByName(repeated.select("row.*")) if not marked.where("not gone").isEmpty() else kept.select("row.*")
