"""Vectorised work on the text column of one Arrow batch.

Texts are looked at as bytes. Words and chunks are (start, end) byte ranges found with array
arithmetic, and hashed by polynomial prefix sums, so no Python code runs per word. Peak memory is
a small multiple of ``SLICE_BYTES`` or of the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def seeds(count: int, seed: int) -> np.ndarray:
    """``count`` fixed 64-bit constants, the same on every executor."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything that ends a word of the pattern [^\x20\x09-\x0D]+
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
NEWLINE = separators((0x0A, 0x0A))

_plain = seeds(256, 11)
_folded = _plain.copy()
_folded[65:91] = _plain[97:123]  # A-Z hash as a-z
_second = seeds(256, 12)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, SLICE_BYTES + 65536)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


class Slice:
    """Some neighbouring rows of a batch: ``rows`` is (low, high), ``offsets`` are relative to ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: tuple[int, int]):
        self.data, self.offsets, self.rows = data, offsets, rows
        self._sums: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the maximal runs without a separator; never across two texts."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~breaks[self.data]
        fresh = np.zeros(len(inside) + 1, dtype=bool)
        fresh[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | fresh[1:-1]
        ends = inside
        ends = ends.copy()
        ends[:-1] &= ~inside[1:] | fresh[1:-1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Which text (0-based in this slice) each byte position lies in."""
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, kind: str = "plain") -> np.ndarray:
        """64-bit hashes of byte ranges; ``folded`` ignores the case of A-Z, ``second`` is independent of ``plain``."""
        up, down = _power_tables(len(self.data) + 1)
        if kind not in self._sums:
            table = {"plain": _plain, "folded": _folded, "second": _second}[kind]
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(table[self.data] * up[: len(self.data)], out=sums[1:])
            self._sums[kind] = sums
        sums = self._sums[kind]
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """Cuts a string column into slices; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield Slice(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], (low, high))
        low = high


def _give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and the next stage's tables come on top."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose worker gives its memory back at the end of each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return frame.mapInArrow(tidy, schema)


class ChunkMemo:
    """Values (one array each) of chunks of text by hash, so each distinct chunk is worked out once.

    At ``limit`` chunks or ``room`` values it starts afresh, which bounds its memory; results do not depend on it.
    """

    def __init__(self, dtype: type, limit: int = 400_000, room: int = 12_000_000):
        self.dtype, self.limit, self.room = dtype, limit, room
        self._reset()

    def _reset(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.check = np.zeros(1 << 12, np.uint64)
        self.used = 0

    def resolve(self, keys: np.ndarray, seconds: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """(places, sizes) in ``flat`` for distinct ``keys``; ``make(missing indices) -> (values, sizes)``.

        ``seconds`` are independent hashes of the same chunks: a stored chunk that disagrees is another text.
        """
        if len(self.place) > self.limit or self.used > self.room:
            self._reset()
        held = np.fromiter(map(self.place.get, keys.tolist(), (-1,) * len(keys)), np.int64, len(keys))
        if (self.check[held[held >= 0]] != seconds[held >= 0]).any():
            self._reset()
            held[:] = -1
        missing = np.flatnonzero(held < 0)
        if len(missing):
            values, sizes = make(missing)
            first = len(self.place)
            last, used = first + len(missing), self.used + len(values)
            if used > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(used, len(self.flat)), self.dtype)])
            if last > len(self.at):
                more = max(last, len(self.at))
                self.at, self.size, self.check = (np.concatenate([x[:first], np.zeros(more, x.dtype)]) for x in (self.at, self.size, self.check))
            self.flat[self.used : used] = values
            self.at[first:last] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.size[first:last], self.check[first:last] = sizes, seconds[missing]
            held[missing] = np.arange(first, last)
            self.place.update(zip(keys[missing].tolist(), range(first, last), strict=True))
            self.used = used
        return self.at[held], self.size[held]


def gather(flat: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of flat[place : place + size]."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return flat[np.repeat(places - begin, sizes) + np.arange(total)]


def distinct_chunks(part: Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, index of an example, inverse) of the distinct byte ranges.

    Raises in the (2**-64 per pair) case that two different ranges share the first hash.
    """
    first = part.hashes(starts, ends)
    keys, example, inverse = np.unique(first, return_index=True, return_inverse=True)
    second = part.hashes(starts, ends, "second")
    if (second != second[example][inverse]).any():
        raise ValueError("two different chunks have one hash")
    return keys, second[example], example, inverse
