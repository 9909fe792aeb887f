"""The lattice of a vocabulary's pieces over distinct chunks of text, found with a suffix index and relaxed in arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from retort.llm.piecemodel import SPACE, PieceModel, piece_model
from retort.llm.textbatch import gather, mix


class SuffixIndex:
    """Suffixes of a text of character codes (0 separates chunks), in order of their first ``depth`` characters."""

    def __init__(self, codes: np.ndarray, alphabet: int, depth: int):
        self.bits = max(1, int(alphabet).bit_length())
        self.per_word = 64 // self.bits
        words = -(-depth // self.per_word)
        padded = np.concatenate([codes.astype(np.uint64), np.zeros(words * self.per_word, np.uint64)])
        keys = []
        for w in range(words):
            key = np.zeros(len(codes), np.uint64)
            for i in range(self.per_word):
                at = w * self.per_word + i
                key = (key << np.uint64(self.bits)) | padded[at : at + len(codes)]
            keys.append(key)
        inner = np.flatnonzero(codes)
        order = inner[np.argsort(keys[0][inner])]
        # few suffixes share their first word; only those are sorted by the others
        first = keys[0][order]
        same = np.zeros(len(order), bool)
        same[1:] = first[1:] == first[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        order[tied] = order[tied][np.lexsort([k[order[tied]] for k in reversed(keys)])]
        self.order = order
        self.keys = [k[order] for k in keys]

    def ranges(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern, given as its codes one after another, [low, high) of the suffixes that begin with it."""
        count, width = len(sizes), len(self.keys) * self.per_word
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros((count, width), np.uint64)
        table[np.repeat(np.arange(count), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = codes
        least, most = [], []  # the least and greatest key word that begins with a pattern's part of it
        for w in range(len(self.keys)):
            key = np.zeros(count, np.uint64)
            for i in range(w * self.per_word, (w + 1) * self.per_word):
                key = (key << np.uint64(self.bits)) | table[:, i]
            spare = (self.per_word - np.clip(sizes - w * self.per_word, 1, self.per_word)) * self.bits
            least.append(key), most.append(key + ((np.uint64(1) << spare.astype(np.uint64)) - np.uint64(1)))
        low = np.searchsorted(self.keys[0], least[0], side="left")
        high = np.searchsorted(self.keys[0], most[0], side="right")
        for i in np.flatnonzero((sizes > self.per_word) & (low < high)).tolist():
            for w in range(1, -(-int(sizes[i]) // self.per_word)):
                inside, first = self.keys[w][low[i] : high[i]], low[i]
                low[i] = first + np.searchsorted(inside, least[w][i], side="left")
                high[i] = first + np.searchsorted(inside, most[w][i], side="right")
                if low[i] >= high[i]:
                    break
        return low, np.maximum(low, high)


class FollowCache:
    """``PieceModel.follows`` for arrays of pairs: a direct-mapped table, filled as pairs come up."""

    def __init__(self, model: PieceModel, bits: int = 20):
        self.model, self.bits = model, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, bool)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slots = (mix(pairs) >> self.bits).astype(np.int64)
        out = self.values[slots]
        unknown = np.flatnonzero(self.keys[slots] != pairs)
        if len(unknown):
            distinct, inverse = np.unique(pairs[unknown], return_inverse=True)
            apart = self.model.apart
            found = np.array([apart(p >> 20, p & 0xFFFFF) for p in distinct.tolist()], bool)
            out[unknown] = found[inverse]
            at = (mix(distinct) >> self.bits).astype(np.int64)
            # where two of these share a slot, the last assigned pair must also own the value
            self.keys[at] = distinct
            self.values[at] = found
        return out


@lru_cache(maxsize=2)
def follow_cache(path: str) -> FollowCache:
    """The cache of a model, kept by a worker for its later tasks."""
    return FollowCache(piece_model(path))


class Lattice:
    """For each character position of the chunks: the last piece of the encoding up to there, where it begins, and the pieces so far.

    Chunks start with one space sign. Positions of chunk i are ``bounds[i]`` to ``bounds[i + 1] - 1``; entry k of the
    arrays describes the prefix that ends after character k. A character that no piece has is spelled in bytes:
    its last piece is -1.
    """

    def __init__(self, model: PieceModel, follows: FollowCache, chunks: list[str]):
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = bounds = np.concatenate([[0], np.cumsum(sizes)])
        # with one separator after each chunk
        shift = np.repeat(np.arange(len(chunks)), sizes)
        spread = np.zeros(len(self.points) + len(chunks), np.int64)
        spread[np.arange(len(self.points)) + shift] = self.points.astype(np.int64) + 1
        known, codes = np.unique(spread, return_inverse=True)
        # the pieces whose characters all occur, as codes
        place = np.minimum(np.searchsorted(known, model.made_points), max(len(known) - 1, 0))
        hit = known[place] == model.made_points if len(known) else np.zeros(len(place), bool)
        starts = np.cumsum(model.made_sizes) - model.made_sizes
        here = np.flatnonzero(np.logical_and.reduceat(hit, starts))
        pieces, lengths = model.made_ids[here], model.made_sizes[here]
        coded = gather(place, starts[here], lengths)
        index = SuffixIndex(codes, len(known), model.longest)
        low, high = index.ranges(coded, lengths)
        begin = gather(index.order, low, high - low)
        piece = np.repeat(pieces, high - low)
        stop = begin + np.repeat(lengths, high - low)
        del index
        owner = np.cumsum(spread == 0) - (spread == 0)  # chunk of each spread position
        chunk = owner[begin]
        begin, stop = begin - chunk, stop - chunk  # positions without separators
        level = stop - bounds[chunk]
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 65536 else level, kind="stable")
        begin, stop, piece, level = begin[order], stop[order], piece[order], level[order]
        self.last = np.full(len(self.points), -1, np.int64)
        self.came = np.arange(len(self.points), dtype=np.int64)
        self.count = np.zeros(len(self.points), np.int64)
        single = (known[coded[np.cumsum(lengths)[lengths == 1] - 1]] - 1).astype(np.uint32)
        lone = np.flatnonzero(~np.isin(self.points, single))
        p = self.points[lone]
        spelled = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
        lone_level = lone - bounds[shift[lone]] + 1
        lone_order = np.argsort(lone_level, kind="stable")
        lone, spelled, lone_level = lone[lone_order], spelled[lone_order], lone_level[lone_order]
        top = int(sizes.max(initial=0))
        cuts = np.searchsorted(level, np.arange(1, top + 2))
        lone_cuts = np.searchsorted(lone_level, np.arange(1, top + 2))
        for k in range(top):
            a, b = cuts[k], cuts[k + 1]
            first = begin[a:b] == stop[a:b] - (k + 1)
            before = np.maximum(begin[a:b] - 1, 0)
            left = np.where(first, -1, self.last[before])
            valid = left < 0
            ask = np.flatnonzero(~valid)
            if len(ask):
                valid[ask] = follows(left[ask], piece[a:b][ask])
            at = stop[a:b][valid] - 1
            self.last[at] = piece[a:b][valid]
            self.came[at] = begin[a:b][valid]
            self.count[at] = np.where(first, 0, self.count[before])[valid] + 1
            a, b = lone_cuts[k], lone_cuts[k + 1]
            if b > a:
                self.count[lone[a:b]] = (self.count[lone[a:b] - 1] if k else 0) + spelled[a:b]

    def ids(self, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has), read from the ends of the chunks back."""
        totals = self.count[self.bounds[1:] - 1]
        ends = np.cumsum(totals)
        out = np.zeros(int(totals.sum()), np.int64)
        live = np.arange(len(totals))
        at, put = self.bounds[1:] - 1, ends - 1
        byte_id = np.array([model.byte_ids[b] for b in range(256)], np.int64)
        while len(live):
            piece = self.last[at]
            plain = piece >= 0
            out[put[plain]] = piece[plain]
            step = np.ones(len(live), np.int64)
            for j in np.flatnonzero(~plain).tolist():
                spelled = chr(int(self.points[at[j]])).encode()
                out[put[j] - len(spelled) + 1 : put[j] + 1] = byte_id[list(spelled)]
                step[j] = len(spelled)
            put = put - step
            at = self.came[at] - 1
            more = at >= self.bounds[live]
            live, at, put = live[more], at[more], put[more]
        return out, totals


def regular(chunk: str) -> bool:
    """Whether the lattice takes the chunk: the merges of runs of spaces tie, so those go to the library."""
    return not chunk.startswith(SPACE * 2)
