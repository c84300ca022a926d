"""Secrets: fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

Base spans come from three patterns (assignments, access keys, long hexadecimal runs), each leftmost and without overlap.

The chain tags every word of a document as begin, inside or outside of a secret's value.  Its features are the word's shape (kinds of
characters, length, how many differ, digits, changes of kind), the words around it (how the one before ends, whether one of three before
names a secret, how the one after begins), and the file: how much of it looks like code or settings.
Words tagged as secret that touch no base span add spans of kind ``chain``.

Training.  The only labels are base spans, so it is positive and unlabelled: the values inside base spans are secrets, and all other
words may hold secrets that the patterns miss.  Each chain with a secret is also shown with the words around its secrets hidden, so shape
alone must do.  After a first fit, words outside base spans that it takes for secrets more likely than not
become unknown, and a second fit sums over their tags instead of teaching "outside".  Chains are cut to ``TAUGHT`` words for this, of
at most ``sample_docs`` documents (those with the smallest hashed ids) and at most ``sample_chains`` chains.

Decoding is over whole documents.  A word that "outside" wins by more than any two transitions can give back is outside on every best path;
the runs of words between such ones are decoded, which gives the same tags.

Defined cases: null or empty text has no spans; null ids are ordinary ids; repeated rows are scanned one by one; spans that start
together are in the order of ``KINDS``; an empty table gives an empty result, and a model without a positive training word adds nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._candidates import HEX, Piece
from tidemark.llm._spark import sampled, trim
from tidemark.llm._text import pieces
from tidemark.llm.pii import _ARROW, SPANS

KINDS = ("assign", "access", "hex", "chain")
OUT, BEGIN, INSIDE = range(3)
TAUGHT = 32
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # shorter ones fail from any later start too
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(rb"pass|secret|token|key|auth|cred|pwd")

#: What a byte is: white space, digit, lower, upper, joining sign, quote, other sign, outside ASCII.
SPACE, NUMBER, LOWER, UPPER, JOIN, QUOTE, SIGN, WIDE = range(8)
_KIND = np.full(256, SIGN, np.uint8)
_KIND[128:] = WIDE
_KIND[[32, 9, 10, 11, 12, 13]] = SPACE
_KIND[48:58], _KIND[97:123], _KIND[65:91] = NUMBER, LOWER, UPPER
_KIND[[ord(c) for c in "+/_.=-:"]] = JOIN
_KIND[[ord(c) for c in "\"'`"]] = QUOTE
#: Digit, lower, upper; joining sign, other sign, outside ASCII.  Quotes around a value say nothing about it.
_HAS, _SIGNS = (sum(np.where(_KIND == k, 1 << i, 0) for i, k in enumerate(ks)) for ks in ((NUMBER, LOWER, UPPER), (JOIN, SIGN, WIDE)))
_COUNTED = (_KIND != SPACE) & (_KIND != QUOTE)
_NUMBER, _CODE = _KIND == NUMBER, np.zeros(256, bool)
_CODE[[ord(c) for c in "={}<>[]_/;#$"]] = True
_DIFFERENT = np.where(~_COUNTED, np.uint64(0), np.uint64(1) << (np.arange(256, dtype=np.uint64) % np.uint64(64)))
#: How a word ends: letter or digit, equals sign, colon, quote, else; and no word at all.
_TAIL = np.full(256, 4)
_TAIL[(_KIND >= NUMBER) & (_KIND <= UPPER) | (_KIND == WIDE)] = 0
_TAIL[[ord("="), ord(":")]], _TAIL[_KIND == QUOTE] = (1, 2), 3
NO_WORD = 5

_LENGTH = np.array([1, 2, 3, 4, 6, 9, 13, 17, 25, 33, 49])
#: Values of each feature: letters and digits, signs, length, different characters, share of digits, changes, before, after, code.
WIDTHS = (8, 8, len(_LENGTH) + 1, 11, 11, 8, 12, 5, 13)
AT = np.r_[0, np.cumsum(WIDTHS)]
BEFORE, AFTER = 6, 7
SLOTS = len(WIDTHS)


def _spans(t: str, assign: bool, access: bool, hexa: bool) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the value)"""
    found = [("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6] if assign else []
    found += [("access", *m.span(), *m.span()) for m in _ACCESS.finditer(t)] if access else []
    found += [("hex", *m.span(), *m.span()) for m in _HEX.finditer(t)] if hexa else []
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def base_spans(t: str, assign: bool = True, access: bool = True, hexa: bool = True) -> list[tuple[str, int, int]]:
    return [x[:3] for x in _spans(t, assign, access, hexa)]


@dataclass
class Chains:
    """Words of a piece, a document after the other; ``first``: where each document starts; tags: from base spans."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    slots: np.ndarray
    tags: np.ndarray
    first: np.ndarray
    base: dict[int, list[tuple[str, int, int]]]


def _features(p: Piece, doc: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each word, by whole-piece array steps."""
    w, data = p.words, p.words.data
    n, kind, counted = len(w.start), _KIND[data], _COUNTED[data]
    per_word = lambda x: np.add.reduceat(x, w.start, dtype=np.int64)  # noqa: E731  (white space adds nothing)
    digits, size = per_word(_NUMBER[data]), per_word(counted)
    change = np.zeros(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) & counted[1:] & counted[:-1]
    change[w.start] = False
    different = np.bitwise_count(np.bitwise_or.reduceat(_DIFFERENT[data], w.start)).astype(np.int64)
    slots = np.empty((n, SLOTS), np.int16)
    slots[:, 0] = np.bitwise_or.reduceat(_HAS[data], w.start)
    slots[:, 1] = np.bitwise_or.reduceat(_SIGNS[data], w.start)
    slots[:, 2] = np.searchsorted(_LENGTH, size, side="right")
    slots[:, 3] = np.minimum(different // 3, 10)
    slots[:, 4] = 10 * digits // np.maximum(size, 1)
    slots[:, 5] = np.minimum(per_word(change) // 2, 7)
    hint = np.zeros(n + 3, bool)
    where = np.searchsorted(w.start, [m.start() for m in _HINT.finditer(p.folded)], side="right") - 1
    hint[where[where >= 0]] = True
    place = np.arange(n) - w.first[doc]  # within the document
    near = np.zeros(n, bool)
    for back in (1, 2, 3):
        near[back:] |= hint[: max(n - back, 0)] & (place[back:] >= back)
    tail = np.full(n, NO_WORD)
    tail[1:] = np.where(place[1:] > 0, _TAIL[data[w.end[:-1] - 1]], NO_WORD)
    slots[:, BEFORE] = 2 * tail + near
    after = np.full(n, 4)
    after[:-1] = np.where(place[1:] > 0, 2 * (kind[w.start[1:]] == UPPER) + (digits[1:] > 0), 4)
    slots[:, AFTER] = after
    dense = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CODE[data], out=dense[1:])
    slots[:, 8] = np.minimum(200 * np.diff(dense[w.offs]) // np.maximum(np.diff(w.offs), 1), 12)[doc]
    return slots + AT[:-1].astype(np.int16)


def chains(column: pa.Array) -> Chains:
    p = Piece(column)
    w = p.words
    assign = p.docs_with(b"passw", b"secret", b"token", b"apikey", b"api_key", fold=True)
    access, hexa = p.docs_with(b"AKIA"), p.docs_with_run(HEX, 24)
    found = {d: s for d in sorted(assign | access | hexa) if (s := _spans(p.text(d), d in assign, d in access, d in hexa))}
    n = len(w.start)
    doc = np.repeat(np.arange(p.n), np.diff(w.first))
    start, end = p.spans(np.arange(n), doc)
    tags = np.zeros(n, np.int64)
    for d, spans in found.items():
        a, b = w.first[d], w.first[d + 1]
        for *_, s, e in spans:
            i, j = a + np.searchsorted(end[a:b], s, side="right"), a + np.searchsorted(start[a:b], e)
            tags[i:j] = INSIDE
            tags[i : min(i + 1, j)] = BEGIN
    slots = _features(p, doc) if n else np.zeros((0, SLOTS), np.int16)
    return Chains(doc, start, end, slots, tags, w.first[:-1][np.diff(w.first) > 0], {d: [x[:3] for x in s] for d, s in found.items()})


@dataclass
class Chain:
    unary: np.ndarray
    move: np.ndarray

    @classmethod
    def blank(cls) -> Chain:
        u = np.zeros((AT[-1], 3))
        u[:, 0] = 1
        return cls(u, np.zeros((3, 3)))

    def viterbi(self, c: Chains) -> np.ndarray:
        """The best tags of each whole document."""
        n, tags = len(c.tags), np.zeros(len(c.tags), np.int64)
        if not n:
            return tags
        score = sum(self.unary[c.slots[:, j]] for j in range(SLOTS))
        score[c.first, INSIDE] = -1e9
        settled = score[:, OUT] - score[:, 1:].max(1) > 2 * (self.move.max() - self.move.min())
        opens = np.zeros(n + 1, bool)
        opens[c.first], opens[n] = True, True
        begins = np.flatnonzero(~settled & (opens[:-1] | np.r_[True, settled[:-1]]))
        ends = np.flatnonzero(~settled & (opens[1:] | np.r_[settled[1:], True])) + 1
        order = np.argsort(begins - ends, kind="stable")  # longest first
        at, size = begins[order], (ends - begins)[order]
        if not len(at):
            return tags
        lives = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        came = np.zeros((n, 3), np.int8)
        best = score[at] + np.where(opens[at], 0.0, 1.0)[:, None] * self.move[OUT]
        for t in range(1, int(size[0])):
            k = at[: lives[t]] + t
            step = best[: lives[t], :, None] + self.move
            came[k] = step.argmax(1)
            best[: lives[t]] = step.max(1) + score[k]
        # A settled word after the run is outside.
        best += np.where(opens[at + size], 0.0, 1.0)[:, None] * self.move[:, OUT]
        now = best.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            k = at[: lives[t]] + t
            tags[k] = now[: lives[t]]
            now[: lives[t]] = came[k, now[: lives[t]]]
        return tags


def _expected(e: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, words, 3) and expected transitions (3, 3), from exponentials of scores."""
    n, length, _ = e.shape
    a, b = np.ones_like(e), np.ones_like(e)
    a[:, 0] = e[:, 0] * (1, 1, 0)
    for i in range(1, length):
        a[:, i - 1] /= a[:, i - 1].sum(1, keepdims=True)
        a[:, i] = (a[:, i - 1] @ move) * e[:, i]
    for i in range(length - 2, -1, -1):
        x = (e[:, i + 1] * b[:, i + 1]) @ move.T
        b[:, i] = np.where(real[:, i + 1, None], x / x.sum(1, keepdims=True), 1.0)
    p = a * b
    p /= np.maximum(p.sum(2, keepdims=True), 1e-300)
    pair = a[:, :-1, :, None] * move * (e * b)[:, 1:, None, :]
    pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-300)
    return p * real[:, :, None], (pair * real[:, 1:, None, None]).sum((0, 1))


def _climb(model: Chain, slots: np.ndarray, may: np.ndarray, real: np.ndarray, rounds: int) -> np.ndarray:
    """Raise the likelihood of the allowed tags (may: 0 or 1 for each); returns the marginals of free tags."""
    w, flat = (model.unary, model.move), slots.ravel()
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
    for t in range(1, rounds + 2):
        u = sum(w[0][slots[:, :, j]] for j in range(SLOTS))
        e, m = np.exp(u - u.max(2, keepdims=True)), np.exp(w[1])
        p, moves = _expected(e, m, real)
        if t > rounds:
            return p
        q, gold = _expected(e * may + 1e-30, m, real)
        d = (q - p) / len(slots)
        g0 = np.column_stack([np.bincount(flat, np.repeat(d[:, :, k].ravel(), SLOTS), len(w[0])) for k in range(3)])
        for x, g, (first, second) in zip(w, (g0, (gold - moves) / len(slots)), moments, strict=True):
            g = g - 1e-4 * x
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)


def _fit(parts: list[np.ndarray], rounds: int = 60) -> Chain:
    """parts: (words, SLOTS + 1) of each chain, the tags last."""
    model = Chain.blank()
    taught = [x for x in parts if x[:, SLOTS].any()]
    if not taught:
        return model
    for x in taught:  # once more with the words around secrets hidden
        y, secret = x.copy(), x[:, SLOTS] > 0
        y[secret, BEFORE], y[secret, AFTER] = AT[BEFORE], AT[AFTER]
        parts = [*parts, y]
    full = np.full((len(parts), max(map(len, parts)), SLOTS + 1), -1)
    for i, x in enumerate(parts):
        full[i, : len(x)] = x
    real, slots, tags = full[:, :, SLOTS] >= 0, np.maximum(full[:, :, :SLOTS], 0), np.maximum(full[:, :, SLOTS], 0)
    tags[:, 0] = np.where(tags[:, 0] == INSIDE, BEGIN, tags[:, 0])
    may = np.eye(3)[tags]
    model.unary[:], model.move[OUT, INSIDE] = 0, -4.0
    p = _climb(model, slots, may, real, rounds)
    may[(tags == OUT) & (p[:, :, OUT] < 0.5)] = 1
    _climb(model, slots, may, real, rounds)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, sample_chains: int = 2_000) -> Chain:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "_text"):
                c = chains(b.column(1))
                n = len(c.tags)
                place = np.arange(n) - np.repeat(c.first, np.diff(np.r_[c.first, n]))
                cut = np.flatnonzero(place % TAUGHT == 0)
                some = np.maximum.reduceat(c.tags, cut) > 0 if n else np.zeros(0, bool)
                x = np.column_stack([c.slots, c.tags]).astype(np.int32).ravel()
                edge = np.r_[cut, n].astype(np.int32) * (SLOTS + 1)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(edge), pa.array(x))], names=["some", "x"])
        trim()

    found = sampled(docs, id_col, text_col, sample_docs).mapInArrow(rows, "some boolean, x array<int>")
    # Chains without a base span come behind those with one at the same hash: about one in eight of them is taken.
    place = F.xxhash64("x").cast("double") / 2.0**64 + 0.5
    got = found.orderBy(F.when(F.col("some"), place).otherwise(place * 8), F.hash("x")).limit(sample_chains).select("x").toArrow()["x"]
    return _fit([x.values.to_numpy().reshape(-1, SLOTS + 1) for x in got])


def added(c: Chains, model: Chain) -> dict[int, list[tuple[str, int, int]]]:
    tags = model.viterbi(c)
    out = defaultdict(list)
    starts = set(c.first.tolist())
    for k in np.flatnonzero(tags).tolist():
        d, s, e = int(c.doc[k]), int(c.start[k]), int(c.end[k])
        if tags[k] == INSIDE and k not in starts and tags[k - 1] and out[d]:
            out[d][-1] = ("chain", out[d][-1][1], e)
        else:
            out[d].append(("chain", s, e))
    return {d: kept for d, spans in out.items() if (kept := [x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in c.base.get(d, ()))])}


def find(docs: DataFrame, model: Chain, text_col: str = "text", out: str = "spans") -> DataFrame:
    """All columns and ``out``: (kind, start, end, base) by start and kind, in code points; it replaces a column of that name."""
    rest = docs.select(*[c for c in docs.columns if c != out])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col):
                c = chains(b.column(b.schema.get_field_index(text_col)))
                more = added(c, model)
                spans = [sorted([(*s, True) for s in c.base.get(d, ())] + [(*s, False) for s in more.get(d, ())], key=lambda x: (x[1], KINDS.index(x[0]))) for d in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in spans], _ARROW)], names=[*b.schema.names, out])
        trim()

    return rest.mapInArrow(rows, T.StructType([*rest.schema.fields, T.StructField(out, SPANS)]))
