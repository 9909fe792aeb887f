"""A SentencePiece BPE vocabulary as tables, and the rule by which a last piece may follow another.

Byte-pair encoding has the property that the first pieces of an encoding are the encoding of the text they
spell. So the encoding of each prefix is that of a shorter prefix plus one piece, and the piece is the only
one ending there that *may follow* the shorter prefix's last piece: encoding the two together leaves them as
they are. That makes an exact dynamic programme over prefixes out of the greedy merges.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import sentencepiece

SPACE = "▁"


class PieceModel:
    """Vocabulary, merge splits and the follow rule of a byte-fallback BPE model file."""

    def __init__(self, path: str):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {i: -sp.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.joins: dict[tuple[int, int], float] = {}
        for i in plain:
            text = self.pieces[i]
            for cut in range(1, len(text)):
                left, right = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if left is not None and right is not None:
                    self.joins[left, right] = self.rank[i]
        self.split: dict[int, tuple[int, int]] = {}
        for i in plain:
            if len(self.pieces[i]) > 1 and (last := self._last_merge(i)):
                self.split[i] = last
        #: pieces that merging can make
        self.made = {t: i for t, i in self.ids.items() if len(t) == 1 or i in self.split}
        self.longest = max(map(len, self.made))
        # the same as arrays: code points plus one, one piece after another
        self.made_ids = np.array(list(self.made.values()), np.int64)
        self.made_sizes = np.array([len(t) for t in self.made], np.int64)
        self.made_points = np.frombuffer("".join(self.made).encode("utf-32-le"), np.uint32).astype(np.int64) + 1

    def _last_merge(self, piece: int) -> tuple[int, int] | None:
        """The two parts of a piece's last merge; None if merging its characters doesn't lead to it."""
        row = [self.ids.get(c) for c in self.pieces[piece]]
        if None in row:
            return None
        while len(row) > 1:
            best = min(((self.joins[pair], at) for at, pair in enumerate(zip(row, row[1:], strict=False)) if pair in self.joins), default=None)
            if best is None:
                return None
            at = best[1]
            left, right = row[at], row[at + 1]
            row[at : at + 2] = [self.ids[self.pieces[left] + self.pieces[right]]]
        return (left, right) if row == [piece] else None

    def apart(self, x: int, y: int) -> bool:
        """Whether encoding the text of two pieces gives just these two, so that y may follow x.

        Undoes the merges of both from the last on. At each step x ends and y begins at the seam; they would have
        merged across it, had that come before the merges that took them up.
        """
        taken_x = taken_y = float("inf")
        while True:
            across = self.joins.get((x, y))
            if across is not None and across < taken_x and across <= taken_y:
                return False
            made_x = self.rank[x] if x in self.split else -1.0
            made_y = self.rank[y] if y in self.split else -1.0
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                taken_x, x = made_x, self.split[x][1]
            else:
                taken_y, y = made_y, self.split[y][0]

    def plain_prefixes(self, chunk: str) -> list[list[int]]:
        """The library's ids of every prefix of a chunk that starts with SPACE (for runs of spaces, whose merges tie)."""
        text = chunk.replace(SPACE, " ")[1:]
        return [[self.ids[SPACE]], *self.processor.encode([text[:k] for k in range(1, len(text) + 1)])]


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """The model, read once in each worker."""
    return PieceModel(path)
