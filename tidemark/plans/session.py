"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
BATCH = str(8 << 20)
_shipped: set[str] = set()


def session(name: str = "tidemark", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass the cluster's own session to every function instead."""
    b = SparkSession.builder.appName(name).master(f"local[{cores or '*'}]")
    base = {"spark.sql.shuffle.partitions": str(cores or os.cpu_count() or 8), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors' Python workers, once for each application.

    Where the session does not say how large an Arrow batch may be, it is ``BATCH``: workers hold one or two at a time."""
    app = spark.sparkContext.applicationId
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if app not in _shipped:
        path = Path(tempfile.mkdtemp(), "tidemark_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one where it names none, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        told = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(told)
    return told


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: every use sees the same rows, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
