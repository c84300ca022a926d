"""Statistics kept by interval: a folder for each interval, so a reader of a few intervals opens no other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(stats: DataFrame, path: str, name: str, interval: str = "interval", replace: bool = True) -> None:
    """``replace``: intervals that ``stats`` holds take the place of earlier ones, so a job may run again; others stay.

    Rows are dealt by ranges of interval and name: few files for each interval, and a large one is still split."""
    dealt = stats.repartitionByRange(interval, name).sortWithinPartitions(interval, name)
    dealt.write.partitionBy(interval).option("partitionOverwriteMode", "dynamic").mode("overwrite" if replace else "append").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, intervals: Sequence[int] | None = None, interval: str = "interval") -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df if intervals is None else df.where(F.col(interval).isin(*intervals))
