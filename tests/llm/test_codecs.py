"""The FLAC codec and the piece lattice on random input."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from retort.llm import flac
from retort.llm.queries import BYTES, PIECES
from retort.llm.packing import ByteEncoder
from retort.llm.spchunks import with_leading_space
from retort.llm.spencode import SuffixEncoder
from retort.llm.textbatch import text_slices


def test_flac_round_trip_seek_and_checksums():
    rng = np.random.default_rng(0)
    kinds = [rng.integers(-128, 128, 1152), np.zeros(576), np.tile([127, -128], 288), np.cumsum(rng.integers(-2, 3, 1728)) % 100, np.full(576, 127)]
    counts = np.array([len(k) for k in kinds])
    data, bounds = flac.encode(np.concatenate(kinds).astype(np.int16), counts)
    for got, sent in zip(flac.decode(data, bounds), kinds, strict=True):
        assert (got == sent).all()
    stream = data[bounds[3] : bounds[4]].tobytes()
    assert (flac.read_range(stream, 500, 700) == kinds[3][500:1200]).all()
    for at in (bounds[1] - 1, bounds[1] - 60):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError, match="wrong|sync"):
            flac.decode(broken, bounds)


def _frame(subframe_bits: str) -> np.ndarray:
    """A frame of 576 samples around a subframe given as bits."""
    head = np.array([0xFF, 0xF8, 0x24, 0x02, 0x00], np.uint8)
    body = np.packbits(np.array([int(b) for b in subframe_bits + "0" * (-len(subframe_bits) % 8)], np.uint8))
    data = np.concatenate([head, [flac._checksums(head, np.array([0]), np.array([5]), False)[0]], body]).astype(np.uint8)
    crc = int(flac._checksums(data, np.array([0]), np.array([len(data)]), True)[0])
    return np.concatenate([data, [crc >> 8, crc & 255]]).astype(np.uint8)


def test_linear_predictor_partitions_and_escapes():
    rng = random.Random(5)
    residual = [rng.randrange(-6, 7) for _ in range(574)]
    samples = [10, 12]
    for r in residual:
        samples.append(r + ((samples[-1] * 6 + samples[-2] * 1) >> 3))

    def signed(v, n):
        return format(v & ((1 << n) - 1), f"0{n}b")

    bits = "0" + format(33, "06b") + "0" + signed(10, 8) + signed(12, 8) + format(4, "04b") + signed(3, 5) + signed(6, 5) + signed(1, 5)
    bits += "00" + format(1, "04b")  # two partitions: one Rice-coded, one escaped to raw five bits
    bits += format(2, "04b")
    for r in residual[:286]:
        u = (r << 1) ^ (r >> 31)
        bits += "0" * (u >> 2) + "1" + format(u & 3, "02b")
    bits += "1111" + format(5, "05b") + "".join(signed(r, 5) for r in residual[286:])
    data = _frame(bits)
    got = flac.decode_frames(data, np.array([0]), np.array([len(data)]))
    assert got[0].tolist() == samples


ALPHABET = ["a", "e", "t", "h", " ", " ", "  ", "\n", "▁", "日", "😀", "é", ".", "<s>", "<|endoftext|>", "'ll", "1", "\x00", " ", " ", "\x1c"]


def test_random_texts_encode_as_the_libraries_do():
    rng = random.Random(6)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(1500)]
    pieces, library = SuffixEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for part in text_slices(with_leading_space(pa.array(texts))):
        ids, bounds = pieces.ids(part)
        for i in range(len(part)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(texts[part.rows[0] + i])
    encoder = ByteEncoder(*BYTES)
    for part in text_slices(pa.array(texts)):
        ids, bounds = encoder.ids(part)
        for i in range(len(part)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.library.encode(texts[part.rows[0] + i], add_special_tokens=False).ids
