"""Exact substring deduplication by seed and extend.

Seeds: each window of ``window`` words picks the smallest hash among its ``anchor``-word
grams, leftmost on ties (winnowing).  The pick depends on the window's words alone, so equal windows always meet under the
same anchor.  Consecutive windows with the same pick form a block: the anchor extended
both ways as far as windows go that pick it.

Extension: anchors are joined across documents.  Where all blocks of an anchor
are equal, whole blocks repeat.  Where they differ, matches end inside blocks, and the
windows of these blocks alone are compared, by 128 bits.  No pairs are ever made: both
steps count under a key, with map-side combining, and the rows of a hot key are dealt to several tasks in the joins.  Touching spans merge into maximal repeats of at least ``window`` words.

Defined cases: null or empty text has no words and keeps an empty text; a text of fewer
than ``window`` words keeps all of them; a row that is repeated, id included, counts as
two documents (so both lose what they share); null ids are ordinary ids: documents are told apart by id and 128 bits of text;
an empty table gives an empty result.  Only the two named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import IDENTITY, identified, renamed, same, spread_join, stored, trim
from tidemark.llm._text import Ranges, Words, pieces, spread, starts


def _argmin(g: np.ndarray, k: int) -> np.ndarray:
    """Position of the leftmost minimum of g[i:i+k], for each i with a whole window."""
    n = len(g) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(g)), 1
    while size * 2 <= k:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(g[b] < g[a], b, a)
        size *= 2
    a, b = at[:n], at[k - size : k - size + n]
    return np.where(g[b] < g[a], b, a)


def _blocks(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "_text"):
            w = Words(piece.column(2))
            doc, at = starts(w.first, window)
            if not len(at):
                continue
            words = Ranges(w.hashes())
            n = len(w.start)
            gram = words.of(np.arange(n - anchor + 1), np.arange(anchor, n + 1))
            pick = _argmin(gram, window - anchor + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
            i = np.flatnonzero(new)
            count = np.diff(np.append(i, len(at)))
            begin = at[i]
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(doc[i])) for c in piece.columns[:2]),
                    pa.array(gram[pick[i]].view(np.int64)),
                    pa.array(words.of(begin, begin + count + window - 1).view(np.int64)),
                    pa.array((begin - w.first[doc[i]]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                names=[*IDENTITY, "a", "b", "start", "n"],
            )
    trim()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "_text"):
            w = Words(piece.column(2))
            spans = piece.column(3)
            rows = spans.flatten()
            doc = np.repeat(np.arange(piece.num_rows), np.diff(spans.offsets.to_numpy()))
            start, n, same = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            part = ~same.astype(bool)
            doc, start, n = doc[part], start[part].astype(np.int64), n[part].astype(np.int64)
            if not len(doc):
                continue
            doc, local = np.repeat(doc, n), spread(start, n)
            at = local + w.first[doc]
            h = w.hashes()
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(doc)) for c in piece.columns[:2]), *(pa.array(Ranges(h, lane).of(at, at + window).view(np.int64)) for lane in (0, 1)), pa.array(local.astype(np.int32))],
                names=[*IDENTITY, "w1", "w2", "pos"],
            )
    trim()


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "_text"):
            texts, total, removed = [], [], []
            for text, spans, hits in zip(piece.column(1), piece.column(2), piece.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                keep = np.ones(len(words), bool)
                if spans.is_valid:
                    v = spans.values
                    for s, n, same in zip(*(v.field(i).to_numpy(zero_copy_only=False) for i in range(3)), strict=True):
                        if same:
                            keep[s : s + n + window - 1] = False
                if hits.is_valid:
                    for s in hits.values.to_numpy(zero_copy_only=False):
                        keep[s : s + window] = False
                total.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                texts.append(b" ".join(compress(words, keep) if removed[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["id", "kept_text", "n_words", "n_removed"])
    trim()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 8) -> DataFrame:
    """(id, kept_text, n_words, n_removed) for each row: its text without the repeats of ``window`` words or more."""
    if not 0 < anchor <= window:
        raise ValueError("0 < anchor <= window is needed")
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = identified(docs, id_col, text_col)
    blocks = keyed.select(*IDENTITY, "_text").mapInArrow(lambda it: _blocks(it, window, anchor), "_h long, _h2 long, a long, b long, start int, n int")
    met = blocks.groupBy("a").agg(F.count("*").alias("c"), F.min("b").alias("lo"), F.max("b").alias("hi")).where("c > 1").select("a", F.expr("lo = hi").alias("same"))
    seeds = spread_join(blocks.drop("b"), met, ["a"], ["_h"], "inner").groupBy(*IDENTITY).agg(F.collect_set(F.struct("start", "n", "same")).alias("spans"))
    seeds = renamed(stored(seeds, "seeds"), "_s")
    whole = keyed.join(seeds, same("_s"), "left").select("_id", *IDENTITY, "_text", "spans")
    # With the id too, so that both uses read one shuffle of the texts.
    partial = whole.where(F.exists("spans", lambda s: ~s["same"])).select(*IDENTITY, "_text", "spans", "_id").mapInArrow(lambda it: _windows(it, window), "_h long, _h2 long, w1 long, w2 long, pos int")
    twice = partial.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    hits = spread_join(partial, twice, ["w1", "w2"], ["_h"], "inner").groupBy(*IDENTITY).agg(F.collect_set("pos").alias("hits"))
    ready = whole.join(renamed(hits, "_t"), same("_t"), "left").select("_id", "_text", "spans", "hits")
    return ready.mapInArrow(lambda it: _cut(it, window), f"id {kind}, kept_text string, n_words long, n_removed long").withColumnRenamed("id", id_col)
