"""Late rows kept apart: a stream's rows in time, by interval, and those that came after their interval was closed.

The watermark of a micro-batch is the latest event time of the batches before it, less the allowed delay, as Spark's own is.  Rows behind it go to a table of their own.  An interval that ends
by the watermark is closed: whatever comes for it later is late, so what was read of it stays true.  A micro-batch writes folders of its own number, which a repeated one replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.times import micros

MARK = "latest long, batch long"


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/marks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MARK)
    return spark.read.schema(MARK).parquet(f"{folder}/marks")


def apart(df: DataFrame, ts: str, seconds: int, delay_seconds: float, folder: str) -> DataStreamWriter:
    """A sink that writes rows to ``rows`` or to ``late`` in ``folder``, which all machines share, by the number of their interval: start it as any stream writer.  Rows without a time go nowhere."""
    wide, delay = seconds * 1_000_000, int(delay_seconds * 1_000_000)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _marks(spark, folder).where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        us = micros(ts)
        timed = batch.where(us.isNotNull()).withColumn("interval", F.floor(us / wide).cast("long"))
        behind = F.lit(False) if before is None else us < before - delay
        for name, some in (("rows", ~behind), ("late", behind)):
            timed.where(some).write.mode("overwrite").partitionBy("interval").parquet(f"{folder}/{name}/batch={number}")
        now = timed.agg(F.max(us)).first()[0]
        latest = max(x for x in (before, now, -(1 << 62)) if x is not None)
        spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return df.writeStream.foreachBatch(step)


def _table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("interval", T.LongType())])
    return spark.read.schema(wide).parquet(f"{folder}/{name}").drop("batch")


def closed(spark: SparkSession, folder: str, schema: T.StructType, seconds: int, delay_seconds: float) -> DataFrame:
    """The rows of closed intervals and their interval: later batches add nothing to these intervals."""
    latest = _marks(spark, folder).agg(F.max("latest")).first()[0]
    ended = (latest - int(delay_seconds * 1_000_000)) // (seconds * 1_000_000) if latest is not None else -(1 << 62)
    return _table(spark, folder, "rows", schema).where(F.col("interval") < ended)


def late(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The late rows and their interval; ``groupBy("interval").count()`` tells how many each interval lacks."""
    return _table(spark, folder, "late", schema)
