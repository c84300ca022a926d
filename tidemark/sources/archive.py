"""A binary archive: payload files (.dat) beside files of 64-bit offsets (.ind).

Each task writes its own pair under a name of its own; a manifest, written last, names the pairs that count.  What a lost or repeated task
left behind is in no manifest, so it is never read.  The folder must be one that all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 65_536


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(df: DataFrame, payload: str, folder: str, append: bool = True, skip: Column | None = None) -> int:
    """Write a binary column, return the number of records.  Rows for which ``skip`` is true are not written, nor are null payloads."""
    rows = df if skip is None else df.where(~F.coalesce(skip, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(folder)
        store.create_dir(at)
        name, n, offset = uuid.uuid4().hex, 0, 0
        with store.open_output_stream(f"{at}/{name}.dat") as dat, store.open_output_stream(f"{at}/{name}.ind") as ind:
            for b in batches:
                sizes = np.array([len(x.as_buffer()) for x in b.column(0)], "<u8")
                for x in b.column(0):
                    dat.write(x.as_buffer())
                ind.write((offset + np.cumsum(sizes, dtype="<u8") - sizes).astype("<u8").tobytes())
                n, offset = n + len(sizes), offset + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [n], "bytes": [offset]})

    # One row for each partition: what the driver gathers does not grow with the records.
    done = [r.asDict() for r in rows.where(F.col(payload).isNotNull()).select(F.col(payload).cast("binary")).mapInArrow(run, "name string, n long, bytes long").collect()]
    store, at = _open(folder)
    store.create_dir(at)
    old = [] if append else [i.path for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.startswith("manifest-")]
    with store.open_output_stream(f"{at}/manifest-{uuid.uuid4().hex}") as f:
        f.write(json.dumps(done).encode())
    for p in old:
        store.delete_file(p)
    return sum(d["n"] for d in done)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, record, payload): large parts are cut into ranges of records, each read by one task."""
    store, at = _open(folder)
    parts = []
    for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if i.base_name.startswith("manifest-"):
            with store.open_input_stream(i.path) as f:
                parts += json.loads(f.read())
    todo = [(p["name"], lo, min(lo + RANGE, p["n"]), p["n"], p["bytes"]) for p in parts for lo in range(0, p["n"], RANGE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, root = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                with s.open_input_file(f"{root}/{r['name']}.ind") as f:
                    f.seek(8 * r["lo"])
                    cuts = np.frombuffer(f.read(8 * (min(r["hi"] + 1, r["n"]) - r["lo"])), "<u8").tolist()
                cuts += [r["bytes"]] if r["hi"] == r["n"] else []
                with s.open_input_file(f"{root}/{r['name']}.dat") as f:
                    f.seek(cuts[0])
                    for i in range(0, len(cuts) - 1, 1024):
                        c = cuts[i : i + 1025]
                        yield pa.RecordBatch.from_pydict({"part": [r["name"]] * (len(c) - 1), "record": [r["lo"] + i + k for k in range(len(c) - 1)], "payload": pa.array([f.read(y - x) for x, y in zip(c, c[1:], strict=False)], pa.binary())})

    asked = spark.createDataFrame(todo, "name string, lo long, hi long, n long, bytes long").repartition(max(1, min(len(todo), 10_000)))
    return asked.mapInArrow(run, "part string, record long, payload binary")
