"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform; the code of a rotated vector is
its largest coordinate with its sign.  A table joins the codes of several rotations.  Multiprobe: a vector is
also put under the second-best code of each rotation, so near vectors meet although one code differs.
All pairs that share a bucket, a label and a length are compared by cosine in double precision.

``plan`` sets the numbers: so many rotations that a table has about as many buckets as a label has vectors, so buckets do
not grow with the table; then so many tables that pairs at exactly the threshold, drawn for this purpose, meet with a rate of ``RECALL`` or more.

Equal vectors of one label form a class, so copies are compared once.  Links are counted inside buckets and
leave them as one count and one edge for each class, never as pairs: a pair that meets in several buckets counts
in the one with the smallest key only.  A bucket over ``BLOCK`` classes is cut into
blocks, and every two of its blocks are one task's work, so tasks are bounded and no pair is lost.  Counting
links within a dense group takes time with the square of its distinct vectors, as its exact count of links does.

Defined cases: rows with a null label, or a vector that is null, empty, zero or holds null or non-finite components,
link with nothing; vectors of different lengths or labels never link; repeated rows are copies of each
other, and each counts as a vector; a null id becomes a component's id only if it is alone; an empty table gives an
empty result; columns other than the three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import components, forest, runs, spread_join, stored, trim
from tidemark.llm._text import mix, spread

BLOCK, SMALL = 1024, 64
RECALL = 0.995
U = np.uint64


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def keys(x: np.ndarray, rotations: int, tables: int, after: int = 0) -> np.ndarray:
    """Bucket keys of unit vectors: for each table but the first ``after`` the best codes, and those with one second-best code."""
    n, d = x.shape
    wide = 1 << max(d - 1, 0).bit_length()
    x = np.pad(x, ((0, 0), (0, wide - d)))
    at = np.arange(n)
    out = np.empty((n, tables - after, rotations + 1), U)
    for t in range(after, tables):
        rng = np.random.Generator(np.random.PCG64(97 + t))
        codes = []
        for _ in range(rotations):
            y = x
            for _ in range(3):
                y = _hadamard(y * rng.choice((-1.0, 1.0), wide))
            size = np.abs(y)
            first = size.argmax(1)
            size[at, first] = -1
            second = size.argmax(1)
            codes.append([(2 * i + (y[at, i] > 0)).astype(U) for i in (first, second)])
        for probe in range(rotations + 1):
            key = np.full(n, t, U)
            for r, (best, other) in enumerate(codes):
                key = mix(key * U(1 << 20) + (other if probe == r + 1 else best) + U(1))
            out[:, t - after, probe] = key
    return out.reshape(n, -1).view(np.int64)


def pairs_at(cosine: float, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and others at this cosine from them."""
    rng = np.random.Generator(np.random.PCG64(d))
    a, b = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    return a, cosine * a + np.sqrt(max(1 - cosine * cosine, 0.0)) * b


@lru_cache
def plan(d: int, rows: int, cosine: float, most: int = 64) -> tuple[int, int]:
    """(rotations, tables) for labels of up to ``rows`` vectors of length d.  Where ``most`` tables are not enough, there are fewer rotations, and larger buckets."""
    a, b = pairs_at(cosine, d, min(2000, max(100, (1 << 18) // d)))
    for rotations in range(max(1, ceil(log(max(rows, 2)) / log(2 << max(d - 1, 0).bit_length()))), 0, -1):
        met = np.zeros(len(a), bool)
        for t in range(most):
            k = keys(np.concatenate([a, b]), rotations, t + 1, t).reshape(2, len(a), -1)
            met |= (k[0, :, :, None] == k[1, :, None, :]).any((1, 2))
            if met.mean() >= RECALL:
                return rotations, t + 1
            if t == 7 and (1 - met.mean()) ** (most / 8) > 10 * (1 - RECALL):
                break  # far from it even if all tables are as good as these
    raise ValueError(f"{most} tables of one rotation do not reach {RECALL} at a cosine of {cosine} and length {d}")


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, at: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose cosine is large enough: small groups all at once, others by a product each."""
    size, out = np.diff(at), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    few = np.repeat(size <= SMALL, size)
    row = np.flatnonzero(few)
    more = np.repeat(at[1:], size)[row] - 1 - row
    ends = np.cumsum(more)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 50_000, side="right")))
        i, j = np.repeat(row[lo:hi], more[lo:hi]), spread(row[lo:hi] + 1, more[lo:hi])
        good = np.einsum("nd,nd->n", x[i], x[j]) >= least
        out.append((i[good], j[good]))
        lo = hi
    for g in np.flatnonzero(size > SMALL):
        y = x[at[g] : at[g + 1]]
        i, j = np.nonzero(np.triu(y @ y.T >= least, 1))
        out.append((i + at[g], j + at[g]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _count(table: pa.Table, at: np.ndarray, rows: int, least: float) -> pa.Table | None:
    """(a, b, links): for each class, a member of its cluster and how many vectors it links with, as found first here."""
    d = table["d"].to_numpy()
    out = []
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[np.flatnonzero(np.r_[True, d[1:] != d[:-1]]), len(d)]), strict=True):
        part = table.slice(lo, hi - lo)
        x = _unit(part["v"])
        node, times, mine, key, p, q = (part[c].to_numpy() for c in ("node", "m", "mine", "key", "p", "q"))
        i, j = _near(x, at[(at >= lo) & (at <= hi)] - lo, least)
        two = (p[i] == q[i]) | (mine[i] != mine[j])
        i, j = i[two], j[two]
        if not len(i):
            continue
        used, k = np.unique(np.r_[i, j], return_inverse=True)
        rotations, tables = plan(int(d[lo]), rows, least)
        own = keys(x[used], rotations, tables).reshape(len(used), tables, -1)
        here = np.zeros(len(i), bool)
        for s in range(0, len(i), 5000):
            a, b = own[k[s : min(s + 5000, len(i))]], own[k[len(i) + s : len(i) + min(s + 5000, len(i))]]
            shared = (a[:, :, :, None] == b[:, :, None, :]).any(3)  # keys of different tables differ
            here[s : s + 5000] = np.where(shared, a, np.iinfo(np.int64).max).min((1, 2)) == key[i[s : s + 5000]]
        i, j = i[here], j[here]
        if len(i):
            ids, flat = np.unique(node[np.r_[i, j]], return_inverse=True)
            links = np.bincount(flat, times[np.r_[j, i]])
            _, root = forest(node[i], node[j])
            out.append(pa.table({"a": ids, "b": root, "links": links.astype(np.int64)}))
    return pa.concat_tables(out) if out else None


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "long" if dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint", "boolean") else "string"
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast(kind).alias("label"), F.when(sound, F.col(vector_col)).alias("v"))
    # 128 bits tell a label's vectors from each other.
    rows = rows.withColumns({"h": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "label", "v"))})
    classes = rows.where("v IS NOT NULL").groupBy("h", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("_id").alias("low"))
    # A number for each class, drawn once: the table is written with it.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(0).offsets.to_numpy())
            for d in np.unique(size).tolist():
                part = b.take(pa.array(np.flatnonzero(size == d)))
                k = np.sort(keys(_unit(part.column(0)), *plan(d, most, least)), axis=1)
                k = [np.unique(r) for r in k]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.full(part.num_rows, d), pa.int32()), pa.array(k, pa.list_(pa.int64()))], names=["label", "node", "d", "keys"])
        trim()

    coded = classes.select("v", "label", "node").mapInArrow(bucket, f"label {kind}, node long, d int, keys array<long>")
    dealt = stored(coded.select("label", "d", "node", F.explode("keys").alias("key")), "keys")
    size = dealt.groupBy("label", "d", "key").agg(F.count("*").alias("k")).where("k > 1").select("label", "d", "key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    met = dealt.join(size, ["label", "d", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("d", "label", "key", F.least("mine", "j").alias("p"), F.greatest("mine", "j").alias("q"), "mine", "node").join(classes.select("node", "m", "v"), "node")
    found = stored(runs(met, ["d", "label", "key", "p", "q"], lambda t, at: _count(t, at, most, least), "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    tree = components(found.where("a != b").select("a", "b"))
    placed = classes.select("h", "h2", "node", "m", "low").join(links, "node", "left").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = placed.groupBy("root").agg(F.min("low").alias("least"))
    of = spread_join(placed.drop("low"), low, ["root"], ["node"]).select("h", "h2", F.col("least"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n"))
    out = spread_join(rows.select("_id", "h", "h2"), of, ["h", "h2"], ["_id"])
    out = out.select("_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h").isNull(), F.col("_id")).otherwise(F.col("least")).alias("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
