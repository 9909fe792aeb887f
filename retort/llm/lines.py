"""Line deduplication across documents: equal lines and lines one edit apart go, the earliest stays.

Lines within one edit are found by a deletion-neighbourhood join: every text that a line becomes by losing one
character is a hashed key, and lines that share a key are linked. Two lines of one length that share the key of the
same lost position differ by a substitution there; a line whose whole text is another's key lacks one character of it.
Either kind of group is star-shaped around its earliest line, so groups of any size give one link a line.

Emitting such keys for every line would multiply the corpus by its line length. Two exact screens come first: lines
one edit apart agree on all but one segment when cut into a few segments counted from both ends. Only lines that share
what is left without one half, and then without one of SEGMENTS, emit variants, and only for characters of that segment.

The texts are worked through once: hashes of every line are written out, and all but the texts of the lines that pass the
first screen comes from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.textbatch import BLANKS, Slice, map_batches, mix, seeds, text_slices
from retort.session import cut_lineage

SEGMENTS = 16
#: Where the longer of two lines has fewer code points, an edit is over a tenth of it: they are matched for equality only.
NEAR_CHARS = 10
#: Keys up to this number (16 MB) are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 2_000_000
#: Lines looked up again up to this number (some 20 MB with their places) are broadcast to the documents; beyond it the join shuffles.
BROADCAST_LINES = 200_000


_sum_table = seeds(256, 13)
_sum_table[0x0A] = 0


class Lines:
    """The lines with a word of a slice, as byte and code-point ranges, with hashes of any code-point range."""

    def __init__(self, part: Slice):
        data, offsets = part.data, np.asarray(part.offsets)
        breaks = np.flatnonzero(data == 0x0A)
        starts, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
        filled = ends > starts
        starts, ends = starts[filled], ends[filled]
        if len(starts):
            # up to the next line's start there are only line breaks
            some = np.logical_or.reduceat(~BLANKS[data], starts)
            sums = np.add.reduceat(_sum_table[data], starts)
            starts, ends, sums = starts[some], ends[some], sums[some]
        else:
            sums = np.zeros(0, np.uint64)
        self.part, self.starts, self.ends, self.sums = part, starts, ends, sums
        self.text = part.owner(starts)
        self.number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets)[self.text]
        self.inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that continue a code point
        self.passed = self.inner - np.arange(len(self.inner))  # code points that begin before each
        self.first, self.last = self.starts - np.searchsorted(self.inner, self.starts), self.ends - np.searchsorted(self.inner, self.ends)
        self.size = self.last - self.first

    def bytes_at(self, points: np.ndarray) -> np.ndarray:
        """Where the code points begin."""
        return points + np.searchsorted(self.passed, points, side="right")

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each line: of its bytes in order, and of how often it has each."""
        return self.part.hashes(self.starts, self.ends).view(np.int64), mix(self.sums + (self.ends - self.starts).astype(np.uint64)).view(np.int64)

    def range_hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.part.hashes(self.bytes_at(low), self.bytes_at(high))

    def segment_keys(self, rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, first and last code point of the segment) for each line without each of its segments.

        A line of n characters is cut as n and as n - 1, so that it meets lines of its length and one longer or shorter.
        """
        out = []
        size = self.size[rows]
        for grid in (size, size - 1):
            for s in range(segments):
                a, b = grid * s // segments, grid - grid * (s + 1) // segments
                prefix = self.range_hash(self.first[rows], self.first[rows] + a)
                suffix = self.range_hash(self.last[rows] - b, self.last[rows])
                key = mix(prefix * np.uint64(3) + mix(suffix + np.uint64(5)) + mix((a * np.int64(1 << 32) + b).astype(np.uint64)))
                out.append((rows, key, self.first[rows] + a, self.last[rows] - b))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch.column("text")):
            lines = Lines(part)
            at = pa.array(lines.text + part.rows[0], pa.int64())
            near = np.flatnonzero(lines.size >= NEAR_CHARS - 1)
            row, key, _, _ = lines.segment_keys(near, 2)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            fresh = np.ones(len(row), bool)  # cutting n and n - 1 in two gives some keys twice
            fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key = row[fresh], key[fresh]
            cuts = np.searchsorted(row, np.arange(len(lines.starts) + 1))
            halves = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key.view(np.int64)))
            h1, h2 = lines.hashes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(lines.number, pa.int32()), pa.array(h1), pa.array(h2), halves], names=["doc_id", "text_hash", "line_no", "h1", "h2", "halves"]
            )


OCCURRENCE = "doc_id long, text_hash long, line_no int, h1 long, h2 long, halves array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, key) of candidate lines without one of SEGMENTS."""
    for batch in batches:
        for part in text_slices(batch.column("line")):
            lines = Lines(part)
            row, key, _, _ = lines.segment_keys(np.arange(len(lines.starts)), SEGMENTS)
            at = pa.array(lines.text[row] + part.rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(at), batch.column("h2").take(at), pa.array(key.view(np.int64))], names=["h1", "h2", "key"])


VARIANT = "h1 long, h2 long, variant long, kind int"
#: A variant's kinds: the lost position counts; a character lost anywhere; the whole line.
SAME_PLACE, SHORTENED, WHOLE = 0, 1, 2


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of lines (h1, h2, line, hot keys): all that lose one character of a segment whose key is hot, and the line."""
    for batch in batches:
        hot_lists = batch.column("hot").to_pylist()
        for part in text_slices(batch.column("line")):
            lines = Lines(part)
            owner = lines.text + part.rows[0]
            row, key, low, high = lines.segment_keys(np.arange(len(lines.starts)), SEGMENTS)
            hot = [set(hot_lists[i]) for i in owner.tolist()]
            chosen = np.fromiter((k in hot[r] for r, k in zip(row.tolist(), key.view(np.int64).tolist(), strict=True)), bool, len(row))
            row, low, high = row[chosen], low[chosen], high[chosen]
            span = high - low
            place = np.repeat(low - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(int(span.sum()))
            line = np.repeat(row, span)
            unique = np.unique(line * np.int64(1 << 40) + (place - lines.first[line]))
            line, place = unique >> 40, (unique & ((1 << 40) - 1)) + lines.first[unique >> 40]
            # the text without a character is hashed as its two parts, strung together by the sum of their prefix hashes
            lost = _joined(part, lines, line, place)
            position = mix(lost + mix((place - lines.first[line]).astype(np.uint64)) * np.uint64(9))
            whole = _joined(part, lines, np.arange(len(lines.starts)), None)
            at = np.concatenate([owner[line], owner[line], owner])
            kinds = np.repeat(np.array([SAME_PLACE, SHORTENED, WHOLE], np.int32), [len(line), len(line), len(whole)])
            values = np.concatenate([position, lost, whole]).view(np.int64)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(take), batch.column("h2").take(take), pa.array(values), pa.array(kinds)], names=["h1", "h2", "variant", "kind"])


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _joined(part: Slice, lines: Lines, line: np.ndarray, place: np.ndarray | None) -> np.ndarray:
    """Polynomial hash over code points of each line without the character at ``place`` (None: of the whole line).

    Powers count from the line's start, so what follows a lost character moves down by one.
    """
    points = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    values = mix(points + np.uint64(77))
    n = len(values)
    up = np.full(n + 1, _BASE)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down_base = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = np.full(n + 2, down_base)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n])])
    first, last = lines.first[line], lines.last[line]
    if place is None:
        return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    head = (sums[place] - sums[first]) * down[first]
    tail = (sums[last] - sums[place + 1]) * down[first + 1]
    return mix(head + tail + (last - first - 1).astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _lines_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, first, line) of the wanted lines (h1, h2, first), read from the documents that have them first."""
    unset = F.lit(-(2**63))
    by_doc = wanted.groupBy(F.coalesce("first.doc_id", unset).alias("doc"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("h1", "h2", "first")).alias("wanted"))
    few = wanted.count() <= BROADCAST_LINES
    rows = _keyed(docs).withColumn("doc", F.coalesce("doc_id", unset)).drop("doc_id").join(F.broadcast(by_doc) if few else by_doc, ["doc", "text_hash"])
    split = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["first"].alias("first"), F.get(lines, w["first"]["line_no"]).alias("line"))))[0]
    return cut_lineage(rows.select(F.inline(split)).dropDuplicates(["h1", "h2"]))


def near_line_links(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2, lead_h1, lead_h2) of lines within one edit of an earlier line, one row for each such earliest line of a group.

    ``firsts``: distinct lines (h1, h2) with their earliest occurrence ``first`` and the keys of their halves.
    """
    halves = firsts.select("h1", "h2", "first", F.explode("halves").alias("key"))
    shared = cut_lineage(halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key"))
    few = shared.count() <= BROADCAST_KEYS
    likely = cut_lineage(halves.join(F.broadcast(shared) if few else shared, "key", "left_semi").select("h1", "h2", "first").distinct())
    likely = _lines_of(docs, likely)

    keys = map_batches(likely, _segments, "h1 long, h2 long, key long").distinct()
    keys = cut_lineage(keys)
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mine = keys.join(hot, "key").groupBy("h1", "h2").agg(F.collect_set("key").alias("hot"))
    candidates = cut_lineage(likely.join(mine, ["h1", "h2"]))

    variants = map_batches(candidates.select("h1", "h2", "line", "hot"), _variants, VARIANT).distinct()
    placed = cut_lineage(variants.join(candidates.select("h1", "h2", "first"), ["h1", "h2"]).withColumn("group", (F.col("kind") > SAME_PLACE).cast("int")))
    item = F.struct("first", "h1", "h2")
    leads = placed.groupBy("variant", "group").agg(
        F.min(F.when(F.col("kind") == SAME_PLACE, item)).alias("same"),
        F.min(F.when(F.col("kind") == SHORTENED, item)).alias("shortened"),
        F.min(F.when(F.col("kind") == WHOLE, item)).alias("whole"),
        F.count("*").alias("n"),
    )
    lead = F.when(F.col("kind") == SAME_PLACE, F.col("same")).when(F.col("kind") == SHORTENED, F.col("whole")).otherwise(F.col("shortened"))
    links = (
        placed.join(leads.where("n > 1").drop("n"), ["variant", "group"])
        .withColumn("lead", lead)
        .where("lead.first < first")
        .select("h1", "h2", F.col("lead.h1").alias("lead_h1"), F.col("lead.h2").alias("lead_h2"))
        .distinct()
    )
    # verify on the lines themselves
    texts = candidates.select("h1", "h2", "line")
    return cut_lineage(
        links.join(texts, ["h1", "h2"])
        .join(texts.select(F.col("h1").alias("lead_h1"), F.col("h2").alias("lead_h2"), F.col("line").alias("lead_line")), ["lead_h1", "lead_h2"])
        .where(F.levenshtein("line", "lead_line", 1).between(0, 1) & (F.greatest(F.length("line"), F.length("lead_line")) >= NEAR_CHARS))
        .select("h1", "h2", "lead_h1", "lead_h2")
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, removed): for each text that loses lines, their numbers from 0, in order.

    A line with a word goes if an earlier line of any document is equal to it or, where the longer has NEAR_CHARS code points
    or more, within one edit (insertion, deletion or substitution of a code point). Earlier is by doc_id (null first), then a hash of the
    text, then the line's number; whether the earlier line itself goes makes no difference. Rows with the same doc_id
    and text are one document and lose the same lines. Lines without a word are never touched.
    """
    found = cut_lineage(map_batches(_keyed(docs), _occurrences, OCCURRENCE))
    occurrences = found.select("h1", "h2", F.struct("doc_id", "text_hash", "line_no").alias("at"), "halves")
    firsts = cut_lineage(occurrences.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")))
    near = near_line_links(docs, firsts).select("h1", "h2").distinct().withColumn("near", F.lit(True))
    loses = cut_lineage(firsts.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = occurrences.drop("halves").join(loses, ["h1", "h2"]).where("near or not (at <=> first)")
    return gone.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")).agg(F.sort_array(F.collect_set("at.line_no")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its removed lines; texts that lose every line with a word go.

    Null and empty texts stay as they are.
    """
    clash = [c for c in docs.columns if c in ("_text_hash", "_removed", "_doc")]
    if clash:
        raise ValueError(f"columns {clash} are used here")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_text_hash", F.xxhash64(text)).withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    gone = removed_lines(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_doc"), F.col("text_hash").alias("_text_hash"), F.col("removed").alias("_removed"))
    joined = rows.join(gone, ["_doc", "_text_hash"], "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    rewritten = joined.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept))
    left = F.col("_removed").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return rewritten.where(left).select(*[F.col(c) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row: its lines with a word, and the numbers of those that go."""
    keyed = _keyed(docs)
    wordy = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    counted = keyed.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "doc_id", "text_hash", wordy.cast("long").alias("n_lines"))
    gone = removed_lines(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "text_hash", "removed")
    empty = F.array().cast("array<int>")
    return counted.join(gone, ["doc", "text_hash"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size(F.coalesce("removed", empty)), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", empty).alias("removed")
    )
