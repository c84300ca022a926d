"""Nearest neighbours, local outlier factor, principal components and the squared prediction error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.nearest import nearest

MERGERS = 16


def knn(df: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """(id, neighbour, distance, rank): the exact k nearest others, ties to the smaller id."""
    return nearest(df, id_col, vector_col, k)[0]


def scaled(df: DataFrame, id_col: str, columns: Sequence[str], ports: Sequence[str] = ()) -> DataFrame:
    """(id, vector) for distances over columns of different kinds: each divided by its largest size, ports by 65535."""
    top = df.agg(*[F.max(F.abs(c)).cast("double").alias(f"_m_{c}") for c in columns])
    by = [F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_m_{c}")), F.lit(0.0)) for c in columns]
    return df.join(F.broadcast(top)).select(F.col(id_col), F.array(*by, *[F.coalesce(F.col(c), F.lit(0)).cast("double") / 65535 for c in ports]).alias("vector"))  # one row of an aggregate


def lof(neighbours: DataFrame, k: int = 10) -> DataFrame:
    """(id, lof) from a neighbour table: the mean of lrd(o) / lrd(p) over p's neighbours.

    A point whose k neighbours all lie on it has infinite density: it is as dense as neighbours of that kind (ratio 1) and denser than any other (ratio 0);
    a point of finite density next to it has an infinite factor."""
    kdist = neighbours.groupBy("id").agg(F.max("distance").alias("kd"))
    reach = neighbours.join(kdist.select(F.col("id").alias("neighbour"), "kd"), "neighbour").withColumn("reach", F.greatest("distance", "kd"))
    endless = F.lit(float("inf"))
    lrd = reach.groupBy("id").agg(F.coalesce(F.try_divide(F.count("*"), F.sum("reach")), endless).alias("lrd"))
    both = neighbours.join(lrd.select(F.col("id").alias("neighbour"), F.col("lrd").alias("lo")), "neighbour").join(lrd, "id")
    return both.groupBy("id").agg((F.sum(F.when(F.col("lo") == F.col("lrd"), 1.0).otherwise(F.col("lo") / F.col("lrd"))) / F.count("*")).alias("lof"))


def merged(a: tuple[float, np.ndarray, np.ndarray], b: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and centred products of two sets of rows together, from those of each.  Nothing large is subtracted, so a large mean costs no digits."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, scatter matrix) over rows without nulls and NaN.  A task merges its batches; ``MERGERS`` tasks merge those, and the driver what they give."""
    k = len(columns)
    empty = (0.0, np.zeros(k), np.zeros((k, k)))

    def row(m: tuple[float, np.ndarray, np.ndarray], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([m[0]]), pa.array([m[1].tolist()]), pa.array([m[2].ravel().tolist()])], names=["part", "n", "mean", "scatter"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = empty
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            x = x[~np.isnan(x).any(1)]
            if len(x):
                mean = x.mean(0)
                total = merged(total, (float(len(x)), mean, (x - mean).T @ (x - mean)))
        yield row(total, TaskContext.get().partitionId() % MERGERS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty
        for b in batches:
            for r in b.to_pylist():
                total = merged(total, (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
        yield row(total, 0)

    schema = "part int, n double, mean array<double>, scatter array<double>"
    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(gather, schema)
    total = empty
    for r in parts.repartition(MERGERS, "part").mapInArrow(merge, schema).collect():  # a matrix for each of MERGERS tasks
        total = merged(total, (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
    return total


def pca(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, pc1, ...): centred rows projected on all components, largest eigenvalue first; the largest loading of each is positive (of equal ones, the first).

    Two passes, for any number of columns: centred moments, whose matrix alone reaches the driver, then a matrix product for each batch.  A row with a null or NaN does not
    count and has null components."""
    k = len(columns)
    _, mean, scatter = moments(df, columns)
    values, vectors = np.linalg.eigh(scatter)
    vectors = vectors[:, np.argsort(-values, kind="stable")]
    size = np.abs(vectors)
    vectors *= np.sign(vectors[(size >= size.max(0) * (1 - 1e-9)).argmax(0), np.arange(k)])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]])
            p = (x - mean) @ vectors
            bad = np.isnan(p).any(1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, j], mask=bad) for j in range(k)]], names=[key, *[f"pc{j + 1}" for j in range(k)]])

    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *[f"pc{j + 1} double" for j in range(k)]])
    return df.select(key, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]).mapInArrow(project, schema)


def spe(projected: DataFrame, key: str, last: int = 3, limit: float = 0.06) -> DataFrame:
    """Sum of squares of the last components, and whether it is over the limit."""
    pcs = [c for c in projected.columns if c.startswith("pc")][-last:]
    total = sum(F.col(c) * F.col(c) for c in pcs)
    return projected.select(key, total.alias("spe"), (total > limit).alias("alarm"))

