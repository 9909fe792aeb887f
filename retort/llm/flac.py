"""FLAC streams of 8-bit mono PCM: an encoder with fixed predictors and a decoder of Rice residuals and linear predictors.

Both work on many frames at once: the loops go over positions within a frame, and each step is array arithmetic over
all frames. Frames are 576 samples. Each stream has STREAMINFO (with the MD5 of its samples) and a SEEKTABLE with a point
for every frame, so any range of samples can be decoded alone. Decoding checks the CRC-8 of each frame header, the
CRC-16 of each frame and the MD5 of the samples.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
RATE = 8000
SEEK_POINT = 18


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    rows = []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly if value & top else value << 1) & mask
        rows.append(value)
    return np.array(rows, np.uint32)


_crc8, _crc16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wide: bool) -> np.ndarray:
    """CRC of each byte range, all ranges in step; the longest first, so those still going are a prefix."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    value = np.zeros(len(order), np.uint32)
    going = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), side="right")
    for step, n in enumerate(going.tolist()):
        byte = data[at[:n] + step].astype(np.uint32)
        if wide:
            value[:n] = ((value[:n] << np.uint32(8)) & np.uint32(0xFFFF)) ^ _crc16[(value[:n] >> np.uint32(8)) ^ byte]
        else:
            value[:n] = _crc8[value[:n] ^ byte]
    out = np.empty_like(value)
    out[order] = value
    return out


def _coded_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's extended UTF-8: (bytes as rows of 6, how many)."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 11) + (numbers >= 1 << 16) + (numbers >= 1 << 21) + (numbers >= 1 << 26)
    out = np.zeros((len(numbers), 6), np.uint8)
    for n in range(1, 7):
        rows = size == n
        value = numbers[rows]
        if n == 1:
            out[rows, 0] = value
            continue
        lead = (0xFF << (8 - n)) & 0xFF
        for i in range(n):
            bits = value >> (6 * (n - 1 - i))
            out[rows, i] = (lead | bits) if i == 0 else (0x80 | (bits & 0x3F))
    return out, size


def encode(samples: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams of texts' samples, strung together, and where each begins.

    ``samples`` are the 8-bit samples of all texts one after the other; ``counts`` how many each has, positive
    multiples of BLOCK.
    """
    frames = samples.reshape(-1, BLOCK).astype(np.int32)
    total = len(frames)
    per = counts // BLOCK
    first = np.concatenate([[0], np.cumsum(per)])
    number = np.arange(total) - np.repeat(first[:-1], per)
    one, two = np.diff(frames, axis=1), np.diff(frames, n=2, axis=1)
    cost = np.stack([np.abs(frames[:, 2:]).sum(axis=1), np.abs(one[:, 1:]).sum(axis=1), np.abs(two).sum(axis=1)], axis=1)
    order = np.argmin(cost, axis=1)
    residual = frames.copy()
    residual[order == 1, 1:] = one[order == 1]
    residual[order == 2, 2:] = two[order == 2]
    folded = (residual << 1) ^ (residual >> 31)
    inside = np.arange(BLOCK)[None, :] >= order[:, None]
    folded[~inside] = 0
    lengths = np.stack([(BLOCK - order) * (k + 1) + (folded >> k).sum(axis=1) for k in range(9)], axis=1)
    rice = np.argmin(lengths, axis=1)
    body_bits = 8 * order + 10 + lengths[np.arange(total), rice]
    constant = (frames == frames[:, :1]).all(axis=1)
    verbatim = ~constant & (body_bits >= 8 * BLOCK)
    coded = ~constant & ~verbatim
    body_bits = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, body_bits)) + 8
    numbers, number_size = _coded_numbers(number)
    head_size = 4 + number_size + 1
    sizes = head_size + (body_bits + 7) // 8 + 2

    prefix = 4 + 4 + 34 + 4 + SEEK_POINT * per
    frame_end = np.cumsum(sizes)
    frame_in = frame_end - sizes
    text_bytes = np.add.reduceat(sizes, first[:-1]) if total else np.zeros(0, np.int64)
    stream_start = np.concatenate([[0], np.cumsum(prefix + text_bytes)])
    frame_at = frame_in + np.repeat(np.cumsum(prefix), per)

    out = np.zeros(int(stream_start[-1]), np.uint8)
    out[frame_at], out[frame_at + 1] = 0xFF, 0xF8
    out[frame_at + 2], out[frame_at + 3] = 0x24, 0x02  # 576 samples at 8 kHz; one channel of 8 bits
    for i in range(6):
        rows = number_size > i
        out[frame_at[rows] + 4 + i] = numbers[rows, i]
    out[frame_at + head_size - 1] = _checksums(out, frame_at, head_size - 1, wide=False)

    body = frame_at + head_size
    out[body] = np.where(constant, 0, np.where(verbatim, 2, (8 | order) << 1))
    out[body[constant] + 1] = frames[constant, 0].astype(np.int8).view(np.uint8)
    out[body[verbatim][:, None] + 1 + np.arange(BLOCK)] = frames[verbatim].astype(np.int8).view(np.uint8)
    for o in (1, 2):
        rows = coded & (order == o)
        out[body[rows][:, None] + 1 + np.arange(o)] = frames[rows, :o].astype(np.int8).view(np.uint8)
    # 2 bits of method, 4 of partition order, 4 of parameter, then a unary quotient and the parameter's bits for each residual
    k = rice[coded][:, None]
    u = folded[coded]
    q = u >> k
    held = inside[coded]
    width = np.where(held, q + 1 + k, 0)
    begin = ((body[coded] + 1 + order[coded]) * 8)[:, None]
    stop = begin + 10 + np.cumsum(width, axis=1)
    point = (stop - k - 1)[held]  # of the quotient's closing one
    value = ((1 << k) | (u & ((1 << k) - 1)))[held].astype(np.int64)
    value <<= 24 - (np.broadcast_to(k, u.shape)[held] + 1) - (point & 7)
    if len(point):
        low, high = int(point.min()) >> 3, (int(point.max()) >> 3) + 3
        place = (point >> 3) - low
        added = np.bincount(place, (value >> 16) & 255, high - low) + np.bincount(place + 1, (value >> 8) & 255, high - low) + np.bincount(place + 2, value & 255, high - low)
        window = out[low : min(high, len(out))]
        window += added[: len(window)].astype(np.uint8)
        at = (begin[:, 0] + 6) >> 3  # the parameter's four bits
        out[at] |= (rice[coded] >> 2).astype(np.uint8)
        out[at + 1] |= ((rice[coded] & 3) << 6).astype(np.uint8)
    checks = _checksums(out, frame_at, sizes - 2, wide=True)
    out[frame_at + sizes - 2], out[frame_at + sizes - 1] = checks >> 8, checks & 255

    pcm = samples.astype(np.int8).tobytes()
    offset = 0
    for i in range(len(counts)):
        a, b = int(first[i]), int(first[i + 1])
        own = sizes[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3)
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(counts[i])).to_bytes(8) + hashlib.md5(pcm[offset : offset + int(counts[i])]).digest()
        points = np.zeros(b - a, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"], points["offset"], points["count"] = np.arange(b - a) * BLOCK, frame_in[a:b] - frame_in[a], BLOCK
        head = b"fLaC" + bytes([0]) + (34).to_bytes(3) + info + bytes([0x83]) + (SEEK_POINT * (b - a)).to_bytes(3) + points.tobytes()
        out[stream_start[i] : stream_start[i] + len(head)] = np.frombuffer(head, np.uint8)
        offset += int(counts[i])
    return out, stream_start


class Stream:
    """What a stream's metadata blocks say: its samples, their MD5 and where its frames are."""

    def __init__(self, data: bytes | memoryview, base: int = 0):
        if bytes(data[:4]) != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points = 4, False, None
        while not last:
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4])
            last, kind = bool(kind & 0x80), kind & 0x7F
            block = bytes(data[at + 4 : at + 4 + size])
            if kind == 0:
                packed = int.from_bytes(block[10:18])
                self.channels, self.bits = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
                self.samples, self.md5 = packed & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            at += 4 + size
        if self.channels != 1 or self.bits > 16 or points is None:
            raise ValueError("only mono streams of up to 16 bits with a point for each frame")
        self.first_sample = points["sample"].astype(np.int64)
        self.count = points["count"].astype(np.int64)
        self.starts = points["offset"].astype(np.int64) + at + base
        self.ends = np.append(self.starts[1:], base + len(data))


class _Bits:
    """Reads bit fields at many positions of one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            words = (words << np.uint64(8)) | padded[i : i + len(words)]
        self.words = words

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each position, of which the first 57 are right."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width), at.shape)
        value = self.window(at) >> (np.uint64(64) - np.maximum(width, 1).astype(np.uint64))
        return np.where(width > 0, value.astype(np.int64), 0)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value = self.read(at, width)
        return value - ((value >> (np.asarray(width) - 1)) << np.asarray(width))

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        count = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            top = (self.window(at[live] + count[live]) >> np.uint64(32)).astype(np.float64)
            zeros = 32 - np.frexp(top)[1]  # 32 for none
            count[live] += zeros
            live = live[zeros == 32]
        return count


def _residuals(bits: _Bits, at: np.ndarray, order: int, block: int) -> np.ndarray:
    """Rice-coded residuals of frames with one predictor order and block size."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    out = np.zeros((len(at), block - order), np.int64)
    for split in np.unique(parts).tolist():
        for m in np.unique(method[parts == split]).tolist():
            if m > 1:
                raise ValueError("reserved residual coding")
            rows = np.flatnonzero((parts == split) & (method == m))
            place, wide = at[rows] + 6, 4 + m
            column = 0
            for p in range(1 << split):
                k = bits.read(place, wide)
                place = place + wide
                raw = k == (1 << wide) - 1
                raw_width = np.where(raw, bits.read(place, 5), 0)
                place = place + np.where(raw, 5, 0)
                n = (block >> split) - (order if p == 0 else 0)
                if raw.any():
                    for _ in range(n):
                        q = np.where(raw, 0, bits.unary(place))
                        tail = place + np.where(raw, 0, q + 1)
                        u = (q << np.where(raw, 0, k)) | bits.read(tail, np.where(raw, 0, k))
                        plain = np.where(raw_width > 0, bits.signed(tail, np.maximum(raw_width, 1)), 0)
                        out[rows, column] = np.where(raw, plain, (u >> 1) ^ -(u & 1))
                        place = tail + np.where(raw, raw_width, k)
                        column += 1
                    continue
                down = np.uint64(63) - k.astype(np.uint64)  # shifting out the closing one too
                keep = (np.int64(1) << k) - 1
                for _ in range(n):
                    top = bits.window(place)
                    q = 32 - np.frexp((top >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
                    if (q > 31).any():
                        q = bits.unary(place)
                    place = place + q
                    u = (q << k) | ((bits.window(place) >> down).astype(np.int64) & keep)
                    out[rows, column] = (u >> 1) ^ -(u & 1)
                    place = place + (k + 1)
                    column += 1
    return out


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK, width: int = 8) -> np.ndarray:
    """Samples (one row a frame) of frames of one block size at the given places; raises on a bad checksum."""
    if not len(starts):
        return np.zeros((0, block), np.int64)
    sizes = ends - starts
    check = _checksums(data, starts, sizes - 2, wide=True)
    if (check != (data[ends - 2].astype(np.uint32) << 8 | data[ends - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    if (data[starts] != 0xFF).any() or (data[starts + 1] & 0xFE != 0xF8).any():
        raise ValueError("a frame has no sync code")
    lead = data[starts + 4]
    number_size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    code, rate = data[starts + 2] >> 4, data[starts + 2] & 15
    extra = np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    head = 4 + number_size + extra
    if (_checksums(data, starts, head, wide=False) != data[starts + head]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    bits = _Bits(data)
    body = (starts + head + 1) * 8
    kind = bits.read(body + 1, 6)
    wasted = bits.read(body + 7, 1)
    if wasted.any():
        raise ValueError("wasted bits are not used here")
    at = body + 8
    out = np.zeros((len(starts), block), np.int64)
    rows = np.flatnonzero(kind == 0)
    out[rows] = bits.signed(at[rows], width)[:, None]
    rows = np.flatnonzero(kind == 1)
    for i in range(block if len(rows) else 0):
        out[rows, i] = bits.signed(at[rows] + i * width, width)
    for k in np.unique(kind[kind > 1]).tolist():
        rows = np.flatnonzero(kind == k)
        place = at[rows]
        linear = k >= 32
        if not (linear or 8 <= k <= 12):
            raise ValueError("reserved subframe type")
        order = k - 31 if linear else k - 8
        for i in range(order):
            out[rows, i] = bits.signed(place + i * width, width)
        place = place + order * width
        if linear:
            precision = bits.read(place, 4) + 1
            shift = bits.signed(place + 4, 5)
            place = place + 9
            taps = np.stack([bits.signed(place + i * precision, precision) for i in range(order)], axis=1)
            place = place + order * precision
            rest = _residuals(bits, place, order, block)
            own = out[rows]
            for i in range(order, block):
                own[:, i] = rest[:, i - order] + ((own[:, i - order : i][:, ::-1] * taps).sum(axis=1) >> shift)
            out[rows] = own
            continue
        rest = _residuals(bits, place, order, block)
        warm = out[rows, :order]
        for o in range(order, 0, -1):  # sum up differences of falling order
            start = np.diff(warm[:, :o], n=o - 1, axis=1)
            rest = np.cumsum(np.concatenate([start, rest], axis=1), axis=1)
        out[rows] = rest
    return out


def decode(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The 8-bit samples of streams strung together; checks their frames and their MD5."""
    streams = [Stream(memoryview(data[bounds[i] : bounds[i + 1]]), int(bounds[i])) for i in range(len(bounds) - 1)]
    if not streams:
        return []
    frames = decode_frames(data, np.concatenate([s.starts for s in streams]), np.concatenate([s.ends for s in streams]))
    flat = frames.astype(np.int8)
    out, at = [], 0
    for s in streams:
        own = flat[at : at + len(s.starts)].reshape(-1)
        if hashlib.md5(own.tobytes()).digest() != s.md5 or len(own) != s.samples:
            raise ValueError("the samples' MD5 is wrong")
        out.append(own)
        at += len(s.starts)
    return out


def read_range(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples [first, first + count) of a stream, of which only the frames that hold them are decoded."""
    data = np.frombuffer(stream, np.uint8)
    s = Stream(memoryview(stream))
    low = max(int(np.searchsorted(s.first_sample, first, side="right")) - 1, 0)
    high = int(np.searchsorted(s.first_sample, first + count, side="left"))
    got = decode_frames(data, s.starts[low:high], s.ends[low:high]).reshape(-1)
    skip = first - int(s.first_sample[low])
    return got[skip : skip + count].astype(np.int8)
