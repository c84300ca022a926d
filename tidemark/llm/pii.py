"""Personal data: fixed patterns, and a skip-chain conditional random field over what they leave.

Base spans come from patterns for e-mail, IP, card and phone; each kind is found leftmost and without overlap.

Every word has a label: none, or the kind of data that it is part of.  Its features are its shape (letters, digits and signs, length, counts of digits
and dots, first character) and what the words before and after it look like.  Neighbouring words share a chain potential.  Equal or similar words (the same
letters and digits, at least four) share a skip potential with their previous occurrence and with every occurrence inside a base span, however
far away, so labels agree across a document.  Words inside base spans are evidence; what they say to equal words needs no messages and is added up at once.
A word that "none" wins by more than its two neighbours can give back is none in the best labelling, unless an equal word is evidence or is not
won like that (if all such equal words went to none together, no skip potential would be lost).  Loopy sum-product messages run over the other words of a
piece until none of them changes; a word that ends with a label of at least ``SURE`` adds a span, and adjacent
words of one label make one span.  So a phone number given in full once is found again where it is cut short.

Training is by pseudo-likelihood.  The only labels are base spans, so it is positive and unlabelled: words in base spans have their kind, matches that
fail their check (Luhn, parts over 255) are known to be none, and other words may be data that the patterns miss.  Words of base spans with six characters or
more are shown again with their surroundings hidden.  After a first fit, words that are not known and that it takes for data more likely
than not are left out of a second one.  It uses at most ``sample_nodes`` words of at most ``sample_docs`` documents (those with the smallest hashed ids); words with
a digit or an ``@`` are 32 times as likely to be taken.

Defined cases: null or empty text has no spans; null ids are ordinary ids; repeated rows are scanned one by one; spans that start together are in the order of ``KINDS``;
an empty table gives an empty result, and a model without training rows adds nothing.
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

from tidemark.llm._candidates import DIGIT, Piece
from tidemark.llm._spark import sampled, trim
from tidemark.llm._text import _BITS_LOWER, mix, pieces, powers

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SURE = 0.9
STILL = 1e-4
U = np.uint64
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive repeats and the look-behind change no match: each part must take its whole run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOUCHED = DIGIT.copy()
_TOUCHED[64] = True
#: What a byte is: white space, digit, lower, upper, sign, outside ASCII; and signs that count on their own.
_KIND = np.full(256, 4, np.uint8)
_KIND[128:] = 5
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58], _KIND[97:123], _KIND[65:91] = 1, 2, 3
_ALNUM = (_KIND == 1) | (_KIND == 2) | (_KIND == 3) | (_KIND == 5)
_HAS = np.select([_KIND == 1, _KIND == 2, _KIND == 3], [1, 2, 4], 0)
_SIGNS = np.select([_KIND == 5, *(np.arange(256) == ord(c) for c in "@.-+"), np.isin(np.arange(256), [40, 41]), _KIND == 4], [1, 2, 4, 8, 16, 32, 64], 0)
_LENGTH = np.array([1, 2, 3, 4, 6, 8, 10, 13, 17, 25, 33])
#: Values of each feature: letters and digits, signs, length, digits, dots, first character, word before, word after.
WIDTHS = (8, 128, len(_LENGTH) + 1, 21, 5, 6, 9, 9)
AT = np.r_[0, np.cumsum(WIDTHS)]
BEFORE, AFTER = 6, 7
SLOTS = len(WIDTHS)


def _emails(t: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            last = m.end()
            out.append((s, last))
        at = t.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(t: str, at: bool = True, digits: bool = True, failed: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.  ``at`` and ``digits``: the text may hold these.
    ``failed`` gets matches of IP and card that fail their check."""
    found = [("email", s, e) for s, e in _emails(t)] if at else []
    wrong = failed.append if failed is not None else lambda span: None
    if digits:
        for m in _IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
            else:
                wrong(m.span())
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19:
                if luhn(d):
                    found.append(("card", *m.span()))
                else:
                    wrong(m.span())
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@dataclass
class Words:
    """All words of a piece: rows of the weight table, evidence (label or -1), whether known to be none, groups of equal words (0: of no group)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    slots: np.ndarray
    given: np.ndarray
    refused: np.ndarray
    group: np.ndarray
    base: dict[int, list[tuple[str, int, int]]]
    opens: np.ndarray


def words(column: pa.Array) -> Words:
    p = Piece(column)
    w, data = p.words, p.words.data
    n = len(w.start)
    doc = np.repeat(np.arange(p.n), np.diff(w.first))
    start, end = p.spans(np.arange(n), doc)
    touched = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_TOUCHED[data], out=touched[1:])
    at, given, refused, base = p.docs_with(b"@"), np.full(n, -1), np.zeros(n, bool), {}
    for d in np.flatnonzero(np.diff(touched[w.offs])).tolist():
        failed: list[tuple[int, int]] = []
        spans = base_spans(p.text(d), d in at, failed=failed)
        a, b = w.first[d], w.first[d + 1]
        over = lambda s, e: slice(a + np.searchsorted(end[a:b], s, side="right"), a + np.searchsorted(start[a:b], e))  # noqa: B023, E731
        for s, e in failed:
            refused[over(s, e)] = True
        for kind, s, e in reversed(spans):
            given[over(s, e)] = LABELS.index(kind)
        if spans:
            base[d] = spans
    opens = np.zeros(n + 1, bool)
    opens[w.first] = True
    if not n:
        return Words(doc, start, end, np.zeros((0, SLOTS), np.int16), given, refused, np.zeros(0, U), base, opens)
    per_word = lambda x: np.add.reduceat(x, w.start, dtype=np.int64)  # noqa: E731  (white space adds nothing)
    digits, has = per_word(DIGIT[data]), np.bitwise_or.reduceat(_HAS[data], w.start)
    signs, kind = np.bitwise_or.reduceat(_SIGNS[data], w.start), _KIND[data[w.start]]
    # A neighbour is a word with @, a word with digits (after a plus sign or not), one of letters or of signs, capital or ending in a sign; or none.
    looks = np.select([signs & 2 > 0, (digits > 0) & (signs & 16 > 0), digits > 0, has == 0, kind == 3, _KIND[data[w.end - 1]] == 4], [1, 2, 3, 4, 5, 6], 7)
    slots = np.zeros((n, SLOTS), np.int16)
    for j, x in enumerate((has, signs, np.searchsorted(_LENGTH, w.end - w.start, side="right"), np.minimum(digits, 20), np.minimum(per_word(data == 46), 4), kind)):
        slots[:, j] = x
    slots[1:, BEFORE], slots[:-1, AFTER] = np.where(opens[1:n], 8, looks[:-1]), np.where(opens[1:n], 8, looks[1:])
    slots[0, BEFORE], slots[-1, AFTER] = 8, 8
    # Equal words: the same letters (A-Z as a-z) and digits.
    keep = _ALNUM[data]
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    letters = data[keep]
    up, down = powers(0, len(letters))
    total = np.zeros(len(letters) + 1, U)
    np.cumsum(_BITS_LOWER[letters] * up[: len(letters)], out=total[1:])
    a, b = place[w.start], place[w.end]
    group = mix(mix((total[b] - total[a]) * down[a] + (b - a).astype(U)) ^ (doc.astype(U) * U(0x9E3779B97F4A7C15)))
    return Words(doc, start, end, slots + AT[:-1].astype(np.int16), given, refused, np.where(b - a >= 4, group | U(1), U(0)), base, opens)


@dataclass
class Graph:
    """The words whose labels are open, or evidence: ``word`` numbers, edges (left, right) of both kinds, the first of equal words (or -1),
    and whether the word before or after is settled as none."""

    word: np.ndarray
    given: np.ndarray
    local: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    same: np.ndarray
    before: np.ndarray
    after: np.ndarray


def _equal(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of each word and the next equal one, first equal word of each or -1)"""
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    first = np.full(len(g), -1)
    if len(g):
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first[group == 0] = -1
    again = np.flatnonzero(~new & (g != 0))
    return np.column_stack([order[again - 1], order[again]]), first


def graph(w: Words, field: Field) -> Graph:
    n = len(w.doc)
    score = sum(field.unary[w.slots[:, j]] for j in range(SLOTS)) if n else np.zeros((0, len(LABELS)))
    open_ = (score[:, 0] - score[:, 1:].max(1) <= 2 * (field.chain.max() - field.chain.min())) | (w.given >= 0)
    told = np.unique(w.group[open_])
    word = np.flatnonzero(open_ | (np.isin(w.group, told[told != 0]) if field.skip else False))
    first, last = w.opens[:-1][word], w.opens[1:][word]
    next_ = np.r_[(word[1:] == word[:-1] + 1) & ~first[1:], False] if len(word) else np.zeros(0, bool)
    near = np.flatnonzero(next_)
    before, after = ~first, ~last & ~next_
    before[near + 1] = False
    skip, same = _equal(w.group[word])
    return Graph(word, w.given[word], score[word], np.column_stack([near, near + 1]), skip, same, before, after)


@dataclass
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: float

    @classmethod
    def blank(cls) -> Field:
        u = np.zeros((AT[-1], len(LABELS)))
        u[:, 0] = 1
        return cls(u, np.zeros((len(LABELS), len(LABELS))), 0.0)

    def marginals(self, g: Graph) -> np.ndarray:
        n, k = len(g.word), len(LABELS)
        local = g.local + g.before[:, None] * self.chain[0] + g.after[:, None] * self.chain[:, 0]
        known = g.given >= 0
        local[known] = -50.0
        local[known, g.given[known]] = 50.0
        said, tells, asks = np.zeros((n, k)), known & (g.same >= 0), ~known & (g.same >= 0)
        np.add.at(said, (g.same[tells], g.given[tells]), self.skip)
        local[asks] += said[g.same[asks]]
        skip = g.skip[~known[g.skip].any(1)]
        edges = np.concatenate([g.chain, skip])
        pot = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), k, k)), np.broadcast_to(self.skip * np.eye(k), (len(skip), k, k))])
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
        msg, last, pace = np.zeros((len(src), k)), np.zeros((len(src), k)), np.full(len(src), 0.5)
        live = np.arange(len(src))
        # A message crosses a document in as many rounds as it has nodes, and twice that when each round goes half way.
        for _ in range(60 + 4 * n):
            if not len(live):
                break
            out = (local[src[live]] - msg[back[live]])[:, :, None] + pot[live]
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            change = new - new.max(1, keepdims=True) - msg[live]
            pace[live] *= np.where((change * last[live]).sum(1) < 0, 0.7, 1.0)  # messages that swing come to rest
            last[live] = change
            change *= pace[live, None]
            msg[live] += change
            np.add.at(local, dst[live], change)
            moved = live[np.abs(change).max(1) > STILL]
            hot, own = np.zeros(n, bool), np.zeros(len(src), bool)
            hot[dst[moved]], own[moved] = True, True
            live = np.flatnonzero(hot[src] | own)
        local -= local.max(1, keepdims=True) if n else 0
        p = np.exp(local)
        return p / p.sum(1, keepdims=True) if n else p


def added(w: Words, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """Spans that the field adds, none of which touches a base span."""
    g = graph(w, field)
    p = field.marginals(g)
    label = np.where((p.max(1) >= SURE) & (g.given < 0), p.argmax(1), 0) if len(p) else np.zeros(0, int)
    adjacent = np.zeros(len(label), bool)
    adjacent[g.chain[:, 1]] = True
    out = defaultdict(list)
    for k in np.flatnonzero(label).tolist():
        i, kind = g.word[k], LABELS[label[k]]
        d = int(w.doc[i])
        if adjacent[k] and label[k - 1] == label[k] and out[d]:
            out[d][-1] = (kind, out[d][-1][1], int(w.end[i]))
        else:
            out[d].append((kind, int(w.start[i]), int(w.end[i])))
    return out


def _climb(f: Field, slots: np.ndarray, left: np.ndarray, right: np.ndarray, skips: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Raise the pseudo-likelihood of y; returns the probabilities of the labels."""
    k = len(LABELS)
    w = [f.unary, f.chain, np.array([f.skip])]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
    hot = np.eye(k)[y]
    has_l, has_r = left >= 0, right >= 0
    for t in range(1, rounds + 2):
        s = w[0][slots].sum(1) + skips * w[2][0]
        s[has_l] += w[1][left[has_l]]
        s[has_r] += w[1].T[right[has_r]]
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        if t > rounds:
            f.skip = max(float(w[2][0]), 0.0)
            return p
        d = weight[:, None] * (hot - p) / weight.sum()
        g0 = np.column_stack([np.bincount(slots.ravel(), np.repeat(d[:, j], SLOTS), len(w[0])) for j in range(k)])
        g1 = np.zeros_like(w[1])
        np.add.at(g1, left[has_l], d[has_l])
        np.add.at(g1.T, right[has_r], d[has_r])
        # Potentials between words are held back more: what a word looks like comes first.
        for x, g, (m, v), hold in zip(w, (g0, g1, np.array([(d * skips).sum()])), moments, (5e-5, 2e-4, 1e-5), strict=True):
            g = g - hold * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def _fit(x: np.ndarray, rounds: int = 120) -> Field:
    """x: slots, labels left and right (-1: no word), labels of equal words, whether known, long enough to stand alone, own label."""
    f = Field.blank()
    if not len(x) or x[:, -1].max() == 0:
        return f
    f.unary[:] = 0
    alone = x[(x[:, -1] > 0) & (x[:, -2] > 0)].copy()  # once more with the surroundings hidden
    alone[:, BEFORE], alone[:, AFTER], alone[:, SLOTS : SLOTS + 2] = AT[BEFORE], AT[AFTER], 0
    x = np.concatenate([x, alone])
    args = x[:, :SLOTS], x[:, SLOTS], x[:, SLOTS + 1], x[:, SLOTS + 2 : -3], x[:, -1]
    p = _climb(f, *args, np.ones(len(x)), rounds)
    _climb(f, *args, np.where((x[:, -3] == 0) & (p[:, 0] < 0.5), 0.0, 1.0), rounds)
    return f


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, sample_nodes: int = 20_000) -> Field:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "_text"):
                w = words(b.column(1))
                n, y = len(w.doc), np.maximum(w.given, 0)
                left, right, skips = np.full(n, -1), np.full(n, -1), np.zeros((n, len(LABELS)), np.int64)
                left[1:], right[:-1] = np.where(w.opens[1:n], -1, y[:-1]), np.where(w.opens[1:n], -1, y[1:])
                pairs, _ = _equal(w.group)
                np.add.at(skips, (pairs[:, 0], y[pairs[:, 1]]), 1)
                np.add.at(skips, (pairs[:, 1], y[pairs[:, 0]]), 1)
                likely = (w.slots[:, 0] - AT[0] & 1 > 0) | (w.slots[:, 1] - AT[1] & 2 > 0) | (y > 0)
                x = np.column_stack([w.slots, left, right, skips, w.refused | (y > 0), w.end - w.start >= 6, y]).astype(np.int32)
                place = np.arange(n) - np.flatnonzero(w.opens[:n])[np.cumsum(w.opens[:n]) - 1] if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w.doc)), pa.array(place), pa.array(likely), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int32()))], names=["h", "place", "likely", "x"])
        trim()

    nodes = sampled(docs, id_col, text_col, sample_docs).mapInArrow(rows, "h long, place long, likely boolean, x array<int>")
    # A draw for each word, by its document and place: the same however the documents are dealt.
    draw = F.xxhash64("h", "place").cast("double") / 2.0**64 + 0.5
    got = nodes.orderBy(F.when(F.col("likely"), draw).otherwise(draw * 32), F.hash("x")).limit(sample_nodes).select("x").toArrow()
    return _fit(np.array(got["x"].to_pylist(), np.int64).reshape(-1, SLOTS + 5 + len(LABELS)))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, field: Field, text_col: str = "text", out: str = "spans") -> DataFrame:
    """All columns and ``out``: (kind, start, end, base) by start and kind, in code points; it replaces a column of that name."""
    rest = docs.select(*[c for c in docs.columns if c != out])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col):
                w = words(b.column(b.schema.get_field_index(text_col)))
                more = added(w, field)
                spans = [sorted([(*s, True) for s in w.base.get(d, ())] + [(*s, False) for s in more.get(d, ())], key=lambda x: (x[1], KINDS.index(x[0]))) for d in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in spans], _ARROW)], names=[*b.schema.names, out])
        trim()

    return rest.mapInArrow(rows, T.StructType([*rest.schema.fields, T.StructField(out, SPANS)]))


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The text with each run of overlapping spans replaced by its first kind in brackets; the spans column goes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = b.schema.get_field_index(text_col), b.schema.get_field_index(spans_col)
            texts = []
            for t, spans in zip(b.column(i), b.column(j), strict=True):
                t = t.as_py()
                if t is not None and spans.is_valid and len(spans):
                    out, at = [], 0
                    for s in spans.as_py():
                        if s["start"] >= at:
                            out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                    t = "".join(out) + t[at:]
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == i else c for k, c in enumerate(b.columns) if k != j], names=[n for n in b.schema.names if n != spans_col])

    return found.mapInArrow(rows, T.StructType([f for f in found.schema.fields if f.name != spans_col]))


def digest(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """(id, n_kind..., base_sha256, spans) from a column of spans."""
    base = F.filter("spans", lambda s: s["base"])
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: lambda s: s["base"] & (s["kind"] == k)
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(id_col, *counts, F.sha2(say(base).cast("binary"), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
