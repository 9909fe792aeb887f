"""Cuts texts into the chunks that a SentencePiece BPE model encodes independently.

No piece holds a space after another character, so no merge spans the point before a run of spaces. A text
gets the model's leading space; each chunk is a run of spaces and what follows up to the next run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from retort.llm.piecemodel import SPACE
from retort.llm.textbatch import Slice, gather


def with_leading_space(column: pa.Array) -> pa.Array:
    """Non-empty texts with the model's dummy space in front and its space sign read as a space."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pc.replace_substring(column, SPACE, " ")
    lead = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return pc.binary_join_element_wise(lead, column, pa.scalar("", pa.large_string()))


def space_chunks(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the chunks of a slice, in order and without gaps."""
    data = part.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    firsts = part.offsets[:-1][part.offsets[:-1] < part.offsets[1:]]
    begins[firsts] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


def chunk_texts(part: Slice, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The chunks as strings with the space sign for spaces."""
    sizes = ends - starts
    body = gather(part.data, starts, sizes).tobytes()
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    offsets = pa.py_buffer(cuts.astype(np.int64).tobytes())
    texts = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(body))
    return pc.replace_substring(texts, " ", SPACE).to_pylist()
