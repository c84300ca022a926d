"""Near-duplicate documents by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Sketch: each document's distinct word shingles give one minimum for each of ``coords`` coordinates, and a signature of
   one byte for each of ``signs`` coordinates.  Documents with equal sets become one class, so copies are never paired.
2. Post: a class is posted under coordinate-value pairs.  Two classes that agree in at least ``need``
   coordinates also meet under the rarest pairs of both: of m pairs that anyone else has, the m - need + 1
   rarest suffice (prefix); a class with m < need meets nobody (skip).  Common passages make frequent pairs, which are thereby left out.
3. Count: inside each posting, signatures are compared; classes that agree in enough coordinates are candidates.
   A posting over ``SIGNED`` classes is cut into blocks, and its first class joins every block.  Each block keeps the edges of its
   best-agreement forest only, and each class its best edge: fewer candidates than classes.
4. Confirm: candidates are proved on the full sets, 100 * intersection >= percent * union, and proven ones are merged into components.
5. Rest: postings whose classes are in different components by now are gone through again, every two blocks in one
   task; forests of candidates between components gather what may still be linked.  Each such gathering is cut
   into blocks of ``BLOCK`` classes or ``SHINGLES`` shingles, and every two of its blocks are one task, which proves all its candidates
   between different components.  No candidate is left out, and none of them is ever a row.  What became one component costs nothing more.

``need`` is the largest count that a pair at the threshold misses with a chance under 1e-5, of ``coords`` in step 2 and of ``signs`` in step 3.
In a family of very many documents that share a good part, but less than the threshold, step 5 takes time with the square of the family.

Defined cases: a document without words (null text too) links with nothing; one with fewer words than a shingle has
the whole sequence as its only shingle; repeated rows are copies of each other; a null id never becomes
a component's id unless it is alone; an empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import components, forest, groups, identified, renamed, runs, same, spread_join, stored, trim
from tidemark.llm._text import Ranges, Words, mix, offsets, pieces, starts

SIGNED, BLOCK, SHINGLES = 2048, 512, 1 << 18
U = np.uint64


@lru_cache
def needed(coords: int, percent: int, miss: float = 1e-5) -> int:
    p, total = percent / 100, 0.0
    for k in range(coords + 1):
        total += comb(coords, k) * p**k * (1 - p) ** (coords - k)
        if total > miss:
            return max(k, 1)
    return coords


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    w = Words(column, lower=True)
    r = Ranges(w.hashes())
    n = np.diff(w.first)
    doc, at = starts(w.first, k)
    g = r.of(at, at + k)
    cut = np.searchsorted(doc, np.arange(len(n) + 1))
    short = np.flatnonzero((n > 0) & (n < k))
    alone = dict(zip(short.tolist(), r.of(w.first[short], w.first[short + 1]), strict=True))
    return [np.array([alone[d]], U) if d in alone else np.unique(g[cut[d] : cut[d + 1]]) for d in range(len(n))]


def sketches(sets: list[np.ndarray], coords: int, signs: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (coordinate-value pairs) and signature bytes of non-empty sets."""
    rng = np.random.Generator(np.random.PCG64(coords))
    xor, times = rng.integers(0, 1 << 63, signs, dtype=np.uint64) * U(2), rng.integers(0, 1 << 63, signs, dtype=np.uint64) * U(2) + U(1)
    tokens, sig = np.zeros((len(sets), coords), U), np.zeros((len(sets), signs), np.uint8)
    if len(sets):
        every = np.concatenate(sets)
        size = np.array([len(s) for s in sets])
        at, step = np.cumsum(size) - size, np.arange(signs, dtype=U) * U(0x9E3779B97F4A7C15)
        for j in range(signs):
            low = mix(np.minimum.reduceat((every ^ xor[j]) * times[j], at) + step[j])
            sig[:, j] = low & U(255)
            if j < coords:
                tokens[:, j] = low
    return tokens, sig


def _sketch(batches: Iterator[pa.RecordBatch], k: int, coords: int, signs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "_text"):
            sets = shingle_sets(b.column(3), k)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            c1, c2 = np.zeros(len(n), U), np.zeros(len(n), U)
            if len(some):
                every = np.concatenate([sets[i] for i in some])
                at = np.cumsum(n[some]) - n[some]
                c1[some] = mix(np.add.reduceat(mix(every), at) + n[some].astype(U))
                c2[some] = mix(np.add.reduceat(mix(every ^ U(0x5851F42D4C957F2D)), at))
            tokens, sig = sketches([sets[i] for i in some], coords, signs)
            lists, bytes_ = [None] * len(n), [None] * len(n)
            for row, i in enumerate(some.tolist()):
                lists[i], bytes_[i] = tokens[row].view(np.int64), sig[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array(c.view(np.int64), mask=n == 0) for c in (c1, c2)), pa.array(n), pa.array(lists, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
                names=["_id", "_h", "_h2", "c", "c2", "n", "tokens", "sig"],
            )
    trim()


def _signatures(t: pa.Table, signs: int) -> np.ndarray:
    return offsets(t["sig"].combine_chunks() if isinstance(t["sig"], pa.ChunkedArray) else t["sig"])[0].reshape(-1, signs)


def _grown(root: np.ndarray, sig: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(i, j, agree): edges of the best-agreement forest of one block; classes with the same root count as one."""
    n, now, edges = len(root), 0, []
    best, of, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    out[0] = False
    for _ in range(n - 1):
        agree = np.where(root == root[now], 1 << 20, (sig == sig[now]).sum(1))
        better = out & (agree > best)
        best[better], of[better] = agree[better], now
        now = int(np.where(out, best, -1).argmax())
        out[now] = False
        if need <= best[now] < 1 << 20:
            edges.append((now, int(of[now]), int(best[now])))
    return edges


def _forests(t: pa.Table, at: np.ndarray, need: int, signs: int) -> pa.Table | None:
    """(a, b, agree): forests of many blocks; those of two classes all at once."""
    node, root, sig, size = t["node"].to_numpy(), t["root"].to_numpy(), _signatures(t, signs), np.diff(at)
    i = at[:-1][size == 2]
    agree = (sig[i] == sig[i + 1]).sum(1)
    good = (agree >= need) & (root[i] != root[i + 1])
    i = i[good]
    found = [(i, i + 1, agree[good])]
    for g in np.flatnonzero(size > 2):
        if edges := _grown(root[at[g] : at[g + 1]], sig[at[g] : at[g + 1]], need):
            i, j, agree = (np.array(x) for x in zip(*edges, strict=True))
            found.append((i + at[g], j + at[g], agree))
    i, j, agree = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "agree": agree}) if len(i) else None


def _between(t: pa.Table, k: int, percent: int, need: int, signs: int) -> pa.Table | None:
    """(a, b): a forest of the links between different components, of two blocks or of one with itself."""
    ids, root, mine, sig = t["node"].to_numpy(), t["root"].to_numpy(), t["mine"].to_numpy(), _signatures(t, signs)
    cross = t["p"][0].as_py() != t["q"][0].as_py()
    candidates = np.zeros((len(ids), len(ids)), bool)
    for lo in range(0, len(ids), 64):
        part = slice(lo, lo + 64)
        candidates[part] = ((sig[part, None, :] == sig[None]).sum(2) >= need) & (root[part, None] != root[None]) & (not cross or mine[part, None] != mine[None])
    some = np.flatnonzero(candidates.any(0))
    if not len(some):
        return None
    ids, candidates = ids[some], candidates[np.ix_(some, some)]
    sets = [s for b in pieces(t.take(pa.array(some)).combine_chunks().to_batches()[0], "_text") for s in shingle_sets(b.column(b.schema.get_field_index("_text")), k)]
    both = _shared(sets)
    size = np.array([len(s) for s in sets])
    x, y = np.nonzero(np.triu(candidates & (100 * both >= percent * (size[:, None] + size[None] - both)), 1))
    if not len(x):
        return None
    node, low = forest(ids[x], ids[y])
    return pa.table({"a": node[node != low], "b": low[node != low]})


def _shared(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many members every two sets share: products of slices of the incidence matrix."""
    every, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    number, keep = np.cumsum(count > 1) - 1, count[code] > 1
    doc, code = doc[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[doc[i:j], code[i:j] - lo] = 1
        both += m @ m.T
    return both


def _prove(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of a group come with its head (node = b) first; one set is held at a time."""
    now, head = None, None
    for batch in batches:
        for piece in pieces(batch, "_text"):
            sets = shingle_sets(piece.column(3), k)
            a, b = [], []
            for group, part, node, mine in zip(*(piece.column(i).to_pylist() for i in range(3)), sets, strict=True):
                if node == group:
                    now, head = (group, part), mine
                elif (group, part) == now:
                    both = len(np.intersect1d(mine, head, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(head) - both):
                        a.append(node)
                        b.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    trim()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) that are similar enough.  Pairs with the same b share a task's work, up to ``BLOCK`` of them."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    asks = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"))
    heads = asks.select("b", "part").distinct().select("b", "part", F.col("b").alias("node"))
    rows = asks.union(heads).join(texts, "node").select("b", "part", "node", "_text")
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("node") != F.col("b")).mapInArrow(lambda it: _prove(it, k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, coords: int = 32, signs: int = 128) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; component_id is the smallest id reachable by links."""
    need, enough = needed(coords, percent), needed(signs, percent)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = identified(docs, id_col, text_col)
    sketch = stored(keyed.mapInArrow(lambda it: _sketch(it, shingle, coords, signs), f"_id {kind}, _h long, _h2 long, c long, c2 long, n long, tokens array<long>, sig binary"), "sketch")
    classes = sketch.where("c IS NOT NULL").groupBy("c", "c2").agg(F.min(F.struct("_h", "_h2")).alias("rep"), F.min("_id").alias("low"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sig").alias("sig"))
    # A number for each class, drawn once: the table is written with it.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("node", F.explode("tokens").alias("t"))
    met = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    rare = tokens.join(met, "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts")).where(F.size("ts") >= need)
    prefix = rare.select("node", F.explode(F.slice("ts", 1, F.size("ts") - need + 1)).alias("p")).select("node", F.col("p.df").alias("df"), F.col("p.t").alias("t"))
    posted = stored(prefix.join(classes.select("node", "sig", "rep"), "node").select("t", F.ceil(F.col("df") / SIGNED).cast("int").alias("blocks"), "node", "sig", "rep"), "postings")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    first = posted.where("blocks > 1").groupBy("t", "blocks").agg(F.min(F.struct("node", "sig")).alias("x"))
    dealt = posted.select("t", mine.alias("p"), "node", F.col("node").alias("root"), "sig").union(first.select("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), "x.node", "x.node", "x.sig"))
    best = runs(dealt, ["t", "p"], lambda t, at: _forests(t, at, enough, signs), "a long, b long, agree long").distinct()
    ends = best.select(F.explode(F.array(F.struct(F.col("a").alias("u")), F.struct(F.col("b").alias("u")))).alias("x"), "a", "b", "agree")
    tried = ends.groupBy("x.u").agg(F.max(F.struct("agree", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    reps = renamed(posted.select("node", "rep.*").distinct(), "_r")
    # Always by shuffle: the candidates grow with the documents, and the plan shall be alike at every size.
    texts = stored(keyed.join(reps.hint("merge"), same("_r")).groupBy("node").agg(F.first("_text").alias("_text")), "texts")
    sure = stored(_confirmed(tried, texts, shingle, percent), "links")
    root = components(sure)
    placed = posted.drop("rep").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    again = spread_join(placed, open_, ["t"], ["node"], "inner").withColumn("mine", mine).withColumn("j", others).select("t", F.least("mine", "j").alias("p"), F.greatest("mine", "j").alias("q"), "node", "root", "sig")
    bridges = runs(again, ["t", "p", "q"], lambda t, at: _forests(t, at, enough, signs), "a long, b long, agree long").select("a", "b")
    wide = components(sure.union(bridges))
    members = wide.join(root.select("node", F.col("root").alias("inner")), "node", "left").select("node", F.col("root").alias("outer"), F.coalesce("inner", "node").alias("root")).join(classes.select("node", "sig", "n"), "node")
    sizes = members.groupBy("outer").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("outer", "blocks")
    rest = spread_join(members, sizes, ["outer"], ["node"], "inner").withColumn("mine", mine).withColumn("j", others).select("outer", F.least("mine", "j").alias("p"), F.greatest("mine", "j").alias("q"), "mine", "node", "root", "sig").join(texts, "node")
    links = components(sure.union(groups(rest, ["outer", "p", "q"], lambda t: _between(t, shingle, percent, enough, signs), "a long, b long")))
    # The smallest id of each component, for its classes and then for their documents.
    joined = classes.select("node", "c", "c2", "low").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = joined.groupBy("root").agg(F.min("low").alias("m"))
    of = spread_join(joined.select("node", "c", "c2", "root"), low, ["root"], ["node"]).select("c", "c2", "m")
    out = spread_join(sketch.select("_id", "n", "c", "c2", "_h"), of, ["c", "c2"], ["_h"])
    out = out.select("_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("_id")).otherwise(F.col("m")).alias("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
