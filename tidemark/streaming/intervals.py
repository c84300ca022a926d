"""Interval analytics over unbounded input: watermarks bound the state, late rows beyond them are dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.stats import entropy_of


def counts(df: DataFrame, ts: str, key: str, seconds: int, late: str) -> DataFrame:
    """(window, key, n): tumbling intervals."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, ts: str, key: str, seconds: int, late: str) -> DataFrame:
    """(start_us, total, unique_keys, entropy) of each closed interval: counts of keys, then one row for the interval."""
    n = counts(df, ts, key, seconds, late)
    return n.groupBy(F.window(F.window_time("window"), f"{seconds} seconds")).agg(F.sum("n").alias("total"), F.count("*").alias("unique_keys"), F.round(entropy_of("n"), 6).alias("entropy")).select(F.unix_micros("window.start").alias("start_us"), "total", "unique_keys", "entropy")


def sessions(df: DataFrame, ts: str, key: str, seconds: int, late: str) -> DataFrame:
    """(key, first_us, end_us, n_events): a session closes after ``seconds`` without an event."""
    s = df.withWatermark(ts, late).groupBy(F.session_window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n_events"))
    return s.select(key, F.unix_micros("w.start").alias("first_us"), F.unix_micros("w.end").alias("end_us"), "n_events")


def first_of_key(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark: eviction of old keys keeps the state bounded."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def retain(df: DataFrame, ts: str, seconds: int, keep: int, folder: str) -> DataStreamWriter:
    """A sink that keeps the rows of the last ``keep`` intervals of ``seconds``, by event time: start it as any stream writer.

    A micro-batch is written to a folder of its own, which a repeated one replaces, by interval; then intervals that are too old are deleted whole.
    ``retained`` reads it.  The folder may be in any store that Spark reaches."""

    def step(batch: DataFrame, number: int) -> None:
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        batch.withColumn("interval", F.floor(us / (seconds * 1_000_000)).cast("long")).write.mode("overwrite").partitionBy("interval").parquet(f"{folder}/batch={number}")
        jvm, conf = batch.sparkSession._jvm, batch.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/interval=*")
        store = path.getFileSystem(conf)
        found = {str(s.getPath()): s.getPath() for s in store.globStatus(path)}
        number_of = {p: int(tail) for p in found if (tail := p.rsplit("=", 1)[1]).lstrip("-").isdigit()}
        for p, i in number_of.items():
            if i <= max(number_of.values()) - keep:
                store.delete(found[p], True)
        # Batches that have no interval left go too, so that later batches do not list them.
        for b in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")):
            if not store.globStatus(jvm.org.apache.hadoop.fs.Path(b.getPath(), "interval=*")):
                store.delete(b.getPath(), True)

    return df.writeStream.foreachBatch(step)


def retained(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows that ``retain`` keeps, and their interval."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("interval", T.LongType())])).parquet(folder).drop("batch")


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all input that is there, in append mode, and read what it wrote.  The folder must be a shared one."""
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")
