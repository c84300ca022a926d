"""What the operators share on Spark's side: tables, shared folders, sorted groups, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where it names none (tests), a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        told = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(told)
    return told


_written: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here, and lost executors lose nothing.  ``clear`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that operators of this application have stored, but for the first ``keep``.  Results that still read them must be written before."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    while len(paths) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, at: int) -> None:
    """Delete the table that was stored as number ``at``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_written[spark.sparkContext.applicationId].pop(at))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession) -> int:
    """How many tables are stored now."""
    return len(_written.get(spark.sparkContext.applicationId, []))


#: 128 bits of a row's id and text, which tell documents from each other.
IDENTITY = ("_h", "_h2")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, _h2, _text): ids, identities and texts; null texts are empty."""
    i, t = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(i.alias("_id"), F.xxhash64(i.isNull(), i, t).alias("_h"), F.xxhash64(F.lit(1), i.isNull(), i, t).alias("_h2"), t.alias("_text"))


def sampled(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(_h, _text) of the documents with the ``n`` smallest hashed ids (more where hashes are equal); texts of others are not looked at."""
    h = F.xxhash64(id_col)
    last = docs.select(h.alias("_h")).orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return docs.where(h <= F.lit(last)).select(h.alias("_h"), F.col(text_col).alias("_text"))


def renamed(df: DataFrame, tail: str) -> DataFrame:
    """The identity columns of ``df`` with other names, for a join."""
    return df.withColumnsRenamed({c: c + tail for c in IDENTITY})


def same(tail: str) -> Column:
    """A match of the identity columns with those that ``renamed`` made."""
    return (F.col("_h") == F.col("_h" + tail)) & (F.col("_h2") == F.col("_h2" + tail))


def spread_join(big: DataFrame, small: DataFrame, on: list[str], salt: list[str], how: str = "left", parts: int = 8) -> DataFrame:
    """A join on keys of which one may hold a third of ``big``: its rows are dealt to ``parts`` tasks by ``salt``, and ``small`` goes to each."""
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return big.withColumn("_part", F.pmod(F.xxhash64(*salt), F.lit(parts)).cast("int")).join(copies, [*on, "_part"], how).drop("_part")


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``fn`` to stretches of whole groups: the rows, sorted by the keys, and where each group starts (and the last ends).

    One shuffle and one spillable sort by the keys.  Groups must be bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
            t = t.combine_chunks()
            cuts = np.zeros(max(t.num_rows - 1, 0), bool)
            for k in keys:
                v = t.column(k).combine_chunks() if isinstance(t.column(k), pa.ChunkedArray) else t.column(k)
                v = v.to_numpy(zero_copy_only=False)
                cuts |= v[1:] != v[:-1]
            at = np.concatenate([[0], np.flatnonzero(cuts) + 1, [t.num_rows]])
            if not last:
                at = at[:-1]
            r = fn(t.slice(0, at[-1]), at) if len(at) > 1 else None
            return r.to_batches() if r is not None and r.num_rows else [], t.slice(at[-1]).to_batches() if not last else []

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                out, held = ready(pa.Table.from_batches(held), False)
                # A group longer than what is held is only looked at again once it has doubled.
                rows = 0 if sum(x.num_rows for x in held) < 20_000 else -sum(x.num_rows for x in held)
                yield from out
        if held:
            yield from ready(pa.Table.from_batches(held), True)[0]
        trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, least: int = 2) -> DataFrame:
    """Apply ``fn`` to each group of ``least`` rows or more, without a Python call for smaller ones."""

    def each(t: pa.Table, at: np.ndarray) -> pa.Table | None:
        out = [r for i in np.flatnonzero(np.diff(at) >= least) if (r := fn(t.slice(at[i], at[i + 1] - at[i]))) is not None]
        return pa.concat_tables(out) if out else None

    return runs(df, keys, each, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of a small graph."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest reachable node.

    Alternating large and small stars.  A round is two aggregations with map-side combining
    and two joins that AQE can split, so a hub with very many links stays spread.  Each task first contracts the
    edges it holds.  Rounds are written to the shared folder."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if len(a):
                n, r = forest(a, b)
                keep = n != r
                yield pa.RecordBatch.from_arrays([pa.array(n[keep]), pa.array(r[keep])], names=["a", "b"])

    spark = edges.sparkSession
    before = written(spark)
    e = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(contract, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
        e = stored(small.select(F.col("x.u").alias("a"), F.col("x.m").alias("b")).where("a != b").distinct(), "edges")
        forget(spark, before)  # the round before this one is not read again
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(e.select("b", "b").distinct())
