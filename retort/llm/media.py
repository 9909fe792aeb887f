"""Media columns: texts' bytes kept as FLAC audio, read back, and cut into PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.flac import BLOCK, Stream, decode, decode_frames, encode
from retort.llm.textbatch import Slice, map_batches, text_slices


def payload(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Texts' bytes, each with 255 appended up to a positive multiple of BLOCK, and the padded sizes."""
    sizes = np.diff(part.offsets)
    padded = np.maximum(-(-sizes // BLOCK), 1) * BLOCK
    out = np.full(int(padded.sum()), 255, np.uint8)
    begin = np.concatenate([[0], np.cumsum(padded)[:-1]])
    out[np.repeat(begin - part.offsets[:-1], sizes) + np.arange(len(part.data))] = part.data
    return out, padded


def feature(samples: np.ndarray) -> str:
    """Whole-number features of 8-bit samples: count, sum, sum of squares, peak, sign changes, and total variation."""
    wide = samples.astype(np.int64)
    crossings = int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())
    return f"n={len(wide)};sum={int(wide.sum())};energy={int((wide * wide).sum())};peak={int(np.abs(wide).max())};crossings={crossings};variation={int(np.abs(np.diff(wide)).sum())}"


STORED = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with 255, less 128 as 8-bit samples, in a FLAC stream.

    Null texts count as empty and are stored as one block of padding. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                raw, counts = payload(part)
                data, bounds = encode(raw.astype(np.int16) - 128, counts)
                media = [data[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[slice(*part.rows)].cast(pa.int64()), pa.array(np.diff(part.offsets), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, STORED)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, byte_offset, pcm) of FLAC streams (doc_id, media), one row a frame.

    sample_offset and byte_offset are the places of the block's first sample and of its frame in the stream, so a reader
    can seek to either. Frames with a wrong checksum raise. Null media gives no blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, stream in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if stream is None:
                    continue
                s = Stream(memoryview(stream))
                frames = decode_frames(np.frombuffer(stream, np.uint8), s.starts, s.ends).astype(np.int8)
                n = len(frames)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.first_sample), pa.array(s.count), pa.array(s.starts), pa.array([x.tobytes() for x in frames], pa.binary())],
                    names=["doc_id", "block", "sample_offset", "n_samples", "byte_offset", "pcm"],
                )

    schema = "doc_id long, block int, sample_offset long, n_samples long, byte_offset long, pcm binary"
    return map_batches(media.select("doc_id", "media").where("media is not null"), run, schema)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as FLAC, the stored bytes decoded and checked, and digests of what was read back.

    Equal texts have equal values, as the encoder depends on nothing but the bytes. Null counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                raw, counts = payload(part)
                data, bounds = encode(raw.astype(np.int16) - 128, counts)
                n = range(len(part))
                stored = [data[bounds[i] : bounds[i + 1]].tobytes() for i in n]
                back = decode(np.frombuffer(b"".join(stored), np.uint8), bounds)
                read = [(x.astype(np.int16) + 128).astype(np.uint8).tobytes() for x in back]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[slice(*part.rows)].cast(pa.int64()),
                        pa.array(np.diff(part.offsets), pa.int64()),
                        pa.array([len(x) for x in read], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in read]),
                        pa.array([zlib.crc32(x[-32:]) for x in read], pa.int64()),
                        pa.array([len(x) for x in stored], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
                        pa.array([feature(x) for x in back]),
                    ],
                    names=[x.split()[0] for x in DIGESTS.split(", ")],
                )

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, DIGESTS)
