"""Token counts of every prefix, by dynamic programming over the pieces of a SentencePiece BPE model.

``prefix_counts`` stores the count of each prefix of each text (by code points), which then answers how many
tokens any truncation has and which is the longest within a budget, without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.lattice import FollowCache, Lattice, follow_cache, regular
from retort.llm.piecemodel import PieceModel, piece_model
from retort.llm.spchunks import chunk_texts, space_chunks, with_leading_space
from retort.llm.textbatch import ChunkMemo, Slice, distinct_chunks, gather, map_batches, text_slices


def prefix_table(model: PieceModel, follows: FollowCache, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token counts of the prefixes of 1, 2, ... characters of all chunks, characters of each).

    count[k] = count[where the last piece of prefix k begins] + 1, over the lattice of the chunks' pieces.
    """
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    usual = np.array([regular(c) for c in chunks], bool)
    lattice = Lattice(model, follows, [c for c, u in zip(chunks, usual, strict=True) if u])
    if usual.all():
        return lattice.count, sizes
    values = np.zeros(int(sizes.sum()), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values[gather(np.arange(len(values)), at[usual], sizes[usual])] = lattice.count
    for i in np.flatnonzero(~usual).tolist():
        values[at[i] : at[i] + sizes[i]] = [len(x) for x in model.plain_prefixes(chunks[i])]
    return values, sizes


class PrefixCounter:
    """Counts for slices of texts; keeps what it has worked out for chunks in a bounded memo."""

    def __init__(self, path: str):
        self.model = piece_model(path)
        self.follows = follow_cache(path)
        self.memo = ChunkMemo(np.int32, limit=250_000, room=8_000_000)

    def counts(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(counts of every non-empty prefix of every text with its leading space, where each text's begin)."""
        starts, ends = space_chunks(part)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
        keys, seconds, example, inverse = distinct_chunks(part, starts, ends)

        def make(missing: np.ndarray):
            at = example[missing]
            return prefix_table(self.model, self.follows, chunk_texts(part, starts[at], ends[at]))

        places, sizes = self.memo.resolve(keys, seconds, make)
        totals = self.memo.flat[places + sizes - 1].astype(np.int64)[inverse]
        within = gather(self.memo.flat, places[inverse], sizes[inverse]).astype(np.int64)
        first = np.searchsorted(starts, part.offsets)
        running = np.concatenate([[0], np.cumsum(totals)])
        text_base = np.repeat(running[first[:-1]], np.diff(first))
        within += np.repeat(running[:-1] - text_base, sizes[inverse])
        characters = np.concatenate([[0], np.cumsum(sizes[inverse])])
        return within, characters[first]


def _measure(path: str, budget: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        for batch in batches:
            spaced = with_leading_space(batch.column("text"))
            for part in text_slices(spaced):
                counts, bounds = counter.counts(part)
                rows = range(len(part))
                tokens = [int(counts[bounds[i + 1] - 1]) if bounds[i + 1] > bounds[i] else 0 for i in rows]
                fits = []
                for i in rows:  # counts may fall from one prefix to the next, so the longest that fits is looked for
                    own = counts[bounds[i] + 1 : bounds[i + 1]]
                    good = np.flatnonzero(own <= budget) if tokens[i] > budget else ()
                    fits.append(int(good[-1]) + 1 if len(good) else (len(own) if tokens[i] <= budget else 0))
                rows_at = slice(*part.rows)
                columns = [batch.column("doc_id")[rows_at].cast(pa.int64()), batch.column("n_bytes")[rows_at], pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
                if keep:
                    stored = [counts[bounds[i] + 1 : bounds[i + 1]].astype("<i4").tobytes() for i in rows]
                    columns.append(pa.array(stored, pa.binary()))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))


def prefix_counts(docs: DataFrame, model_path: str, budget: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars, prefix_tokens): prefix_tokens has the count of the first k code points as the k-th little-endian int32.

    A null text counts as empty: no tokens and an empty table. Repeated ids and other columns don't matter.
    """
    docs = _sized(docs)
    return map_batches(docs, _measure(model_path, budget, True), "doc_id long, n_bytes long, n_tokens long, fit_chars long, prefix_tokens binary")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every text; null counts as empty.

    fit_chars is the longest prefix, in code points, of at most ``limit`` tokens. Read off the prefix tables, which
    aren't kept here.
    """
    docs = _sized(docs)
    counted = map_batches(docs, _measure(model_path, limit, False), "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def tokens_of_prefix(counted: DataFrame, chars: str) -> DataFrame:
    """Adds prefix_n: the tokens of the first ``chars`` (a column name) code points, from the stored table."""
    at = F.greatest(F.lit(0), F.least(F.col(chars), F.octet_length("prefix_tokens") / 4)).cast("int")
    raw = F.expr(f"substring(prefix_tokens, (least({chars}, octet_length(prefix_tokens) div 4) - 1) * 4 + 1, 4)")
    big = F.concat(*[F.substring(raw, i, 1) for i in (4, 3, 2, 1)])
    return counted.withColumn("prefix_n", F.when(at <= 0, F.lit(0)).otherwise(F.conv(F.hex(big), 16, 10).cast("long")))
