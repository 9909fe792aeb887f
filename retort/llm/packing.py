"""Best-fit packing of tokenised texts into sequences of bounded length.

Each task packs the pieces of its own rows: bounded-space online best-fit over a fixed number of open bins. The pieces
of the texts at hand (a slice of about a megabyte) are placed longest first, which fills 99.5 % or more.
The free spaces in use are the set bits of one integer, so the best bin is found with bit arithmetic; when
all bins are open and none fits, the fullest is closed for a new one. No row is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.textbatch import ChunkMemo, Slice, distinct_chunks, gather, map_batches, text_slices

END_ID, SPECIAL = 2, b"<|endoftext|>"
OPEN_BINS = 4096

_ascii_space = np.zeros(256, dtype=bool)
_ascii_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_maybe_space = _ascii_space.copy()
_maybe_space[0x1C:0x20] = True
_e280 = np.zeros(256, dtype=bool)
_e280[0x80:0x8B] = True
_e280[[0xA8, 0xA9, 0xAF]] = True


def _space_ends(data: np.ndarray) -> np.ndarray:
    """Marks bytes that end a white-space character in UTF-8."""
    ends = _maybe_space[data]
    if (data >= 0x80).any() and len(data) > 1:
        ends[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        if len(data) > 2:
            a, b, c = data[:-2], data[1:-1], data[2:]
            odd = (a == 0xE2) & (((b == 0x80) & _e280[c]) | ((b == 0x81) & (c == 0x9F)))
            odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE1) & (b == 0xA0) & (c == 0x8E)
            odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
            ends[2:] |= odd
    return ends


class ByteEncoder:
    """Ids of whole texts by a byte-level BPE, each distinct chunk encoded once.

    The tokenizer's pattern never takes white space after another character into one word, so a text may be
    cut before each run of white space. The rank file holds the same vocabulary and is the faster library;
    chunks with the special string go through the tokenizer file, as do texts in which it occurs.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer_path = tokenizer_path
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.memo = ChunkMemo(np.int32, limit=200_000, room=4_000_000)

    @cached_property
    def library(self):
        """The tokenizer file's own library, read only once a text with the special string comes up."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_path)

    def _encode_chunks(self, part: Slice, starts: np.ndarray, ends: np.ndarray, spaces: np.ndarray):
        sizes = ends - starts
        # chunks from a space to a non-space stay apart when strung together, so one call does them all
        joined = np.flatnonzero(_ascii_space[part.data[starts]] & ~spaces[ends - 1] & (sizes < 4096))
        text = gather(part.data, starts[joined], sizes[joined]).tobytes()
        ids: dict[int, np.ndarray] = {}
        alone = set(range(len(starts))) - set(joined.tolist())
        if SPECIAL in text:
            alone |= set(joined.tolist())
            joined, text = joined[:0], b""
        flat = np.array(self.encoding.encode_ordinary(text.decode()), np.int32)
        cuts = np.searchsorted(np.cumsum(self.length[flat]), np.cumsum(sizes[joined]), side="left") + 1
        begins = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
        for i in alone:
            body = part.data[starts[i] : ends[i]].tobytes()
            found = self.library.encode(body.decode(), add_special_tokens=False).ids if SPECIAL in body else self.encoding.encode_ordinary(body.decode())
            ids[i] = np.array(found, np.int32)
        counts = np.zeros(len(starts), np.int64)
        counts[joined] = cuts - begins
        for i, x in ids.items():
            counts[i] = len(x)
        values = np.zeros(int(counts.sum()), np.int32)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        if len(joined):
            values[np.repeat(at[joined] - begins, counts[joined]) + np.arange(len(flat))] = flat
        for i, x in ids.items():
            values[at[i] : at[i] + len(x)] = x
        return values, counts

    def ids(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, where each text's begin)."""
        if not len(part.data):
            return np.zeros(0, np.int32), np.zeros(len(part) + 1, np.int64)
        spaces = _space_ends(part.data)
        begins = _ascii_space[part.data]
        begins[1:] &= ~spaces[:-1]
        if SPECIAL in part.data.tobytes():
            body = part.data.tobytes()
            for i in range(len(part)):
                if SPECIAL in body[part.offsets[i] : part.offsets[i + 1]]:
                    begins[part.offsets[i] : part.offsets[i + 1]] = False
        begins[part.offsets[:-1][part.offsets[:-1] < part.offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(part.data))
        keys, seconds, example, inverse = distinct_chunks(part, starts, ends)
        places, sizes = self.memo.resolve(keys, seconds, lambda m: self._encode_chunks(part, starts[example[m]], ends[example[m]], spaces))
        flat = gather(self.memo.flat, places[inverse], sizes[inverse])
        bounds = np.concatenate([[0], np.cumsum(sizes[inverse])])
        return flat, bounds[np.searchsorted(starts, part.offsets)]


class BestFit:
    """Bounded-space online best-fit: a bin is [sequence id, filled]; bins wait under their free space."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self.waiting[free].pop()
            if not self.waiting[free]:
                self.bits &= ~(1 << free)
            self.open -= 1
        else:
            if self.open >= self.most:  # the fullest closes
                full = (self.bits & -self.bits).bit_length() - 1
                self.waiting[full].pop()
                if not self.waiting[full]:
                    self.bits &= ~(1 << full)
                self.open -= 1
            free, sequence = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:  # a full bin closes by itself
            self.waiting[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(tokenizer_path: str, ranks_path: str, pattern: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = ByteEncoder(tokenizer_path, ranks_path, pattern), BestFit(capacity)
        base = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for part in text_slices(batch.column("text")):
                flat, bounds = encoder.ids(part)
                docs, pieces, starts, lengths, sums = ([] for _ in range(5))
                for i in range(len(part)):
                    own = np.append(flat[bounds[i] : bounds[i + 1]], END_ID).astype("<u4")
                    start, piece = 0, 0
                    while start < len(own):
                        stop = min(len(own), start + ((len(own) - start) % capacity or capacity))
                        docs.append(i + part.rows[0]), pieces.append(piece), starts.append(start), lengths.append(stop - start)
                        sums.append(zlib.crc32(own[start:stop]))
                        start, piece = stop, piece + 1
                sequences, offsets = [0] * len(lengths), [0] * len(lengths)
                for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):  # those at hand, longest first
                    sequence, offsets[k] = bins.place(lengths[k])
                    sequences[k] = base + sequence
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(docs, pa.int64())), pa.array(pieces, pa.int32())] + [pa.array(x, pa.int64()) for x in (starts, lengths, sums, sequences, offsets)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int = 1024) -> DataFrame:
    """One row per piece: its document, place in it, ids' CRC-32, and the sequence and offset that it is packed at.

    A text's ids are those of the tokenizer file without added special tokens, then an end id; null counts as
    empty. Texts longer than ``capacity`` are cut into pieces of that size, the first taking the remainder.
    Repeated ids are packed as the separate rows they are; other columns are ignored; no rows give no rows.
    Sequence ids bear the task's number, so a retried task makes the same ones.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(docs, _pack(tokenizer_path, ranks_path, pattern, capacity), PACKED)
