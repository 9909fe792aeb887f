"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct chunks of a batch are strung together and indexed: suffixes sorted by as many characters as the
longest piece has. Each piece's occurrences are one range of that order, found by binary search. The
occurrences are edges of a lattice; sorted by position, they are relaxed from left to right. For a BPE model an edge
is taken if its piece may follow the piece that the best path ends with at the edge's start
(``PieceModel.apart``), of which there is one at each position; that is the library's own encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.lattice import FollowCache, Lattice, follow_cache, regular
from retort.llm.piecemodel import SPACE, PieceModel, piece_model
from retort.llm.spchunks import chunk_texts, space_chunks, with_leading_space
from retort.llm.textbatch import ChunkMemo, Slice, distinct_chunks, gather, map_batches, text_slices


def encode_chunks(model: PieceModel, follows: FollowCache, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks, how many each has)."""
    usual = np.array([regular(c) for c in chunks], bool)
    lattice = Lattice(model, follows, [c for c, u in zip(chunks, usual, strict=True) if u])
    ids, counts = lattice.ids(model)
    if usual.all():
        return ids, counts
    sizes = np.zeros(len(chunks), np.int64)
    sizes[usual] = counts
    odd = {i: model.plain_prefixes(chunks[i])[-1] for i in np.flatnonzero(~usual).tolist()}
    for i, found in odd.items():
        sizes[i] = len(found)
    values = np.zeros(int(sizes.sum()), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values[gather(np.arange(len(values)), at[usual], sizes[usual])] = ids
    for i, found in odd.items():
        values[at[i] : at[i] + len(found)] = found
    return values, sizes


class SuffixEncoder:
    def __init__(self, path: str):
        self.model = piece_model(path)
        self.follows = follow_cache(path)
        self.memo = ChunkMemo(np.int32, limit=300_000, room=3_000_000)

    def ids(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice of spaced texts, where each text's begin)."""
        starts, ends = space_chunks(part)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(part) + 1, np.int64)
        keys, seconds, example, inverse = distinct_chunks(part, starts, ends)

        def make(missing: np.ndarray):
            at = example[missing]
            return encode_chunks(self.model, self.follows, chunk_texts(part, starts[at], ends[at]))

        places, sizes = self.memo.resolve(keys, seconds, make)
        flat = gather(self.memo.flat, places[inverse], sizes[inverse])
        bounds = np.concatenate([[0], np.cumsum(sizes[inverse])])
        return flat, bounds[np.searchsorted(starts, part.offsets)]


def decode_ids(model: PieceModel, ids: list[int]) -> str:
    """The text that ids spell: byte pieces are joined to characters, and the leading space goes."""
    parts: list[bytes] = []
    for i in ids:
        piece = model.pieces[i]
        if i in model.rank:
            parts.append(piece.replace(SPACE, " ").encode())
        elif model.processor.is_byte(i):
            parts.append(bytes([int(piece[3:5], 16)]))
    text = b"".join(parts).decode("utf-8", errors="replace")
    return text[1:] if text.startswith(" ") else text


ENCODED = "doc_id long, ids array<int>"


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every text by the model; null and empty texts have no ids. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SuffixEncoder(model_path)
        for batch in batches:
            for part in text_slices(with_leading_space(batch.column("text"))):
                flat, bounds = encoder.ids(part)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[slice(*part.rows)].cast(pa.int64()), lists], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [None if ids is None else decode_ids(model, ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, round_trip): each text encoded, and decoded from its ids again in the same task.

    ids_sha256 is over the ids as little-endian int32; round_trip tells whether the decoded text is the text
    (with U+2581 read as a space, as the model does). The decoder joins pieces as arrays of bytes.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SuffixEncoder(model_path)
        model = encoder.model
        spelled = []
        for i, piece in enumerate(model.pieces):
            spelled.append(piece.replace(SPACE, " ").encode() if i in model.rank else bytes([int(piece[3:5], 16)]) if model.processor.is_byte(i) else b"")
        letters = np.frombuffer(b"".join(spelled), np.uint8)
        sizes = np.array([len(x) for x in spelled], np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for batch in batches:
            for part in text_slices(with_leading_space(batch.column("text"))):
                flat, bounds = encoder.ids(part)
                decoded = gather(letters, places[flat], sizes[flat])
                ends = np.concatenate([[0], np.cumsum(sizes[flat])])[bounds]
                digests, same = [], []
                for i in range(len(part)):
                    digests.append(hashlib.sha256(flat[bounds[i] : bounds[i + 1]].astype("<i4").tobytes()).hexdigest())
                    same.append(bool(np.array_equal(decoded[ends[i] : ends[i + 1]], part.data[part.offsets[i] : part.offsets[i + 1]])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[slice(*part.rows)].cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(digests), pa.array(same)],
                    names=["doc_id", "n_ids", "ids_sha256", "round_trip"],
                )

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")
