"""Words worth a closer look, found by byte tables over a whole piece, with code point offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm._text import _FOLD, Words

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
HEX = DIGIT.copy()
HEX[97:103] = True


class Piece:
    def __init__(self, column: pa.Array):
        self.words = w = Words(column)
        self.raw = w.data.tobytes()
        self.n = len(column)
        points = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
        self.points = points
        self._folded: bytes | None = None

    @property
    def folded(self) -> bytes:
        if self._folded is None:
            self._folded = _FOLD.astype(np.uint8)[self.words.data].tobytes()
        return self._folded

    def text(self, d: int) -> str:
        return self.raw[self.words.offs[d] : self.words.offs[d + 1]].decode()

    def docs_of(self, at: np.ndarray) -> np.ndarray:
        """Documents of byte positions."""
        return np.searchsorted(self.words.offs, at, side="right") - 1

    def docs_with(self, *needles: bytes, fold: bool = False) -> set[int]:
        raw, found = self.folded if fold else self.raw, set()
        for x in needles:
            at = raw.find(x)
            while at >= 0:
                d = int(self.docs_of(np.array([at]))[0])
                border = int(self.words.offs[d + 1])
                if at + len(x) <= border:  # else it runs over the border, and so does any later one in d
                    found.add(d)
                at = raw.find(x, border)
        return found

    def docs_with_run(self, table: np.ndarray, least: int) -> set[int]:
        """Documents with ``least`` bytes of ``table`` in a row (a run over a border of documents counts too)."""
        f = np.concatenate([[False], table[self.words.data], [False]])
        edge = np.flatnonzero(f[1:] != f[:-1])
        a, b = edge[::2], edge[1::2]
        long = b - a >= least
        return set(self.docs_of(a[long]).tolist()) | set(self.docs_of(b[long] - 1).tolist())

    def words_with(self, table: np.ndarray, shortest: int = 1) -> np.ndarray:
        """Indices of words that hold a byte of ``table``."""
        c = np.zeros(len(self.words.data) + 1, np.int64)
        np.cumsum(table[self.words.data], out=c[1:])
        w = self.words
        return np.flatnonzero((c[w.end] > c[w.start]) & (w.end - w.start >= shortest))

    def word(self, i: int) -> str:
        return self.raw[self.words.start[i] : self.words.end[i]].decode()

    def doc_of_word(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, i, side="right") - 1

    def spans(self, i: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of words in code points of their documents."""
        base = self.points[self.words.offs[docs]]
        return self.points[self.words.start[i]] - base, self.points[self.words.end[i]] - base
