"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins.  Boosting goes round the features in turn; each
step fits a tree of depth two to one feature's bins and adds it to this feature's lookup
table.  Then the pairs that explain most of what is left get small two-way tables, boosted the same
way.  A score is one table look-up and addition per feature and pair, over whole batches.

Training uses at most ``sample_rows`` labelled rows (those with the smallest hashed ids); their feature
vectors, never texts, go to the driver.  Scoring covers every row.

Defined cases: null or empty text has zero for every feature and gets a score; without a
single training row, or with labels of one kind, the score is that kind's smoothed share; repeated rows get equal scores; a
null id is scored but neither trains nor counts as held out; an empty table gives an empty result; of several labels of an id the largest holds;
columns other than the named ones are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import trim
from tidemark.llm._text import Words, pieces

NAMES = ("bytes", "words", "word_length", "upper", "exclamation", "bar", "symbol", "digit", "stop", "outside_ascii", "lines", "caps_pairs", "repeats", "n_exclamation", "n_bar", "n_symbol", "n_caps_pairs", "n_repeats", "longest_word")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256)
    t[[ord(c) for c in chars]] = 1
    return t


_CLASSES = np.stack([_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("!"), _table("|"), _table("#$%&*@^~<>{}[]\\_=+"), _table("0123456789"), _table(".,;:?"), np.r_[np.zeros(128), np.ones(128)], _table("\n")], axis=1)
_UPPER = _CLASSES[:, 0].astype(bool)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text; shares are per byte or word, n_ are logarithms of counts."""
    w = Words(column)
    n = len(column)
    hist = np.zeros((n, 256))
    for i in range(n):
        hist[i] = np.bincount(w.data[w.offs[i] : w.offs[i + 1]], minlength=256)
    size = np.maximum(np.diff(w.offs), 1)[:, None]
    count = hist @ _CLASSES
    per_doc = lambda flags, first: np.diff(np.r_[0, np.cumsum(flags)][first])
    words = np.diff(w.first)
    up = _UPPER[w.data]
    caps = per_doc(np.r_[up[1:] & up[:-1], np.zeros(min(1, len(up)), bool)], w.offs)
    h = w.hashes()
    same = per_doc(np.r_[np.zeros(min(1, len(h)), bool), h[1:] == h[:-1]], w.first)
    length = w.end - w.start
    longest = np.zeros(n)
    some = words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(length, w.first[:-1][some])
    letters = per_doc(length, w.first)
    rest = np.maximum(words, 1)
    share = count / size
    return np.column_stack([np.log1p(np.diff(w.offs)), np.log1p(words), letters / rest, share, caps / size[:, 0], same / rest, np.log1p(count[:, [1, 2, 3]]), np.log1p(caps), np.log1p(same), np.log1p(longest)])


@dataclass
class Additive:
    """``cuts``: bin edges by feature; ``tables``: what each bin adds; ``pairs``: (i, j, edges of i, edges of j, table)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(c, x[:, j], side="right")]
        for i, j, a, b, t in self.pairs:
            out += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    gain, k = _best_cut(g, h) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.r_[_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)]


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 60, rate: float = 0.25, pairs: int = 6, pair_bins: int = 8) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    edges = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    k = x.shape[1]
    # Quantiles alone give a feature that is mostly zero a single bin: its other values get bins of their own.
    model.cuts = [np.unique(np.r_[edges(x[:, j], bins), edges(v, bins // 2) if len(v := x[x[:, j] > 0, j]) else []]) for j in range(k)]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n))
            model.tables[j] += step
            f += step[at[j]]
    small = [np.unique(np.r_[edges(x[:, j], pair_bins // 2), edges(v, pair_bins // 2) if len(v := x[x[:, j] > 0, j]) else []]) for j in range(k)]
    bin2 = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(small)]
    grid = lambda i, j, v: np.bincount(bin2[i] * (len(small[j]) + 1) + bin2[j], v, (len(small[i]) + 1) * (len(small[j]) + 1)).reshape(len(small[i]) + 1, -1)
    g, h = slopes()
    gain = {(i, j): float((grid(i, j, g) ** 2 / (grid(i, j, h) + 1)).sum()) for i, j in combinations(range(k), 2)}
    best = sorted(gain, key=lambda p: (-gain[p], p))[:pairs]
    tables = {p: np.zeros((len(small[p[0]]) + 1, len(small[p[1]]) + 1)) for p in best}
    for _ in range(rounds // 2):
        for i, j in best:
            g, h = slopes()
            gg, hh = grid(i, j, g), grid(i, j, h)
            (_, a), (_, b) = _best_cut(gg.sum(1), hh.sum(1)), _best_cut(gg.sum(0), hh.sum(0))
            step = np.zeros_like(gg)
            for r in (slice(0, a), slice(a, None)):
                for c in (slice(0, b), slice(b, None)):
                    step[r, c] = rate * _leaf(gg[r, c].sum(), hh[r, c].sum())
            tables[i, j] += step
            f += step[bin2[i], bin2[j]]
    model.pairs = [(i, j, small[i], small[j], tables[i, j]) for i, j in best]
    return model


def held_out(id_col: str, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, folds: int = 5) -> Additive:
    """Learn from labelled rows outside fold 0, at most ``sample_rows`` of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(features(b.column(1))), pa.list_(pa.float64()))], names=["_id", "x"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("y"))
    # Ids first: at most sample_rows of them are broadcast, and no other text is looked at.
    few = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").withColumn("o", F.xxhash64("_id")).orderBy("o").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few.select("_id")), "_id", "left_semi")
    got = texts.mapInArrow(rows, f"_id {kind}, x array<double>").join(few, "_id").select("x", "y", "o", F.hash("x").alias("p")).orderBy("o", "p").limit(sample_rows).select("x", "y").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(NAMES))
    return fit_additive(x, np.array(got["y"].to_pylist(), dtype=float))


def score(docs: DataFrame, model: Additive, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, which replaces a column of that name."""
    rest = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*[docs[c] for c in rest]).schema.fields, T.StructField(out, T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col):
                x = features(b.column(b.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, out])
        trim()

    return docs.select(*rest).mapInArrow(rows, schema)
