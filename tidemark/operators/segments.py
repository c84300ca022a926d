"""Stream segments: contiguous prefixes, clipping, assembly with overlaps, and flow keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contiguous_prefix(df: DataFrame, stream: str, offset: str, length: str) -> DataFrame:
    """(stream, start, prefix_end, n_segments): how far each stream reaches from its first offset without a gap.  Segments that start at one offset lie on the same side of it."""
    w = Window.partitionBy(stream).orderBy(offset, length)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = df.select(stream, F.col(offset).alias("_o"), (F.col(offset) + F.col(length)).alias("_e"), F.max(F.col(offset) + F.col(length)).over(before).alias("_m"))
    gap = F.when(F.col("_m").isNull() | (F.col("_o") <= F.col("_m")), 0).otherwise(1)
    s = s.withColumn("_gaps", F.sum(gap).over(Window.partitionBy(stream).orderBy("_o").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.where("_gaps = 0").groupBy(stream).agg(F.min("_o").alias("start"), F.max("_e").alias("prefix_end"), F.count("*").alias("n_segments"))


def truncate_after(df: DataFrame, stream: str, offset: str, length: str, limit: int) -> DataFrame:
    """(stream, kept, dropped): bytes on either side of the limit."""
    kept = F.greatest(F.least(F.col(offset) + F.col(length), F.lit(limit)) - F.col(offset), F.lit(0))
    return df.groupBy(stream).agg(F.sum(kept).cast("long").alias("kept"), F.sum(F.col(length) - kept).cast("long").alias("dropped"))


class _Segment:
    """Bytes from ``start`` on; the latest arrival is the smallest."""

    __slots__ = ("arrival", "start", "data")

    def __init__(self, arrival, start: int, data: bytes):
        self.arrival, self.start, self.data = arrival, start, data

    def __lt__(self, other: _Segment) -> bool:
        return (self.arrival, self.start, self.data) > (other.arrival, other.start, other.data)


def swept(segments: Iterable[tuple[object, int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Contiguous runs (start, data) of segments (arrival, offset, data) in order of their offsets; the latest arrival's bytes lie on top.

    A sweep with a heap of the segments that reach the current place: memory holds those and the current run, whatever the offsets are."""
    active: list[_Segment] = []
    run: list[bytes] = []
    at = begin = 0

    def until(to: int | None) -> Iterator[tuple[int, bytes]]:
        """Move to the next segment's start (null: to the end)."""
        nonlocal at, begin
        while active and (to is None or at < to):
            top = active[0]
            end = top.start + len(top.data)
            if end <= at:
                heappop(active)
                continue
            if not run:
                begin = at
            stop = end if to is None else min(end, to)
            run.append(top.data[at - top.start : stop - top.start])
            at = stop
        if run and (to is None or at < to):
            yield begin, b"".join(run)
            run.clear()

    for arrival, offset, data in segments:
        if data:
            yield from until(offset)
            at = max(at, offset) if active or run else offset
            heappush(active, _Segment(arrival, offset, data))
    yield from until(None)


BIN = 1 << 24


def assemble(df: DataFrame, stream: str, offset: str, data: str, arrival: str, start: int = 0, joined: bool = True, width: int = BIN) -> DataFrame:
    """(stream, start, data) for each contiguous run: of overlapping bytes the last arrival wins, bytes before ``start`` are dropped.

    A stream is cut into bins of ``width`` offsets, each assembled for itself, so one stream may hold most rows and reach any offset.  ``joined``: runs that cross bins are put together again, in a pass over
    each stream in order that holds one run; without it, runs end where bins end.  Of equal arrivals, the one with the larger offset wins, then the larger data.  Null offsets and data are left out."""
    rows = df.select(F.col(stream).cast("string").alias("k"), F.col(offset).cast("long").alias("o"), F.col(data).alias("d"), F.col(arrival).alias("a")).where("o IS NOT NULL AND octet_length(d) > 0")
    early = F.greatest(F.lit(start) - F.col("o"), F.lit(0))
    rows = rows.withColumns({"d": F.substring("d", (early + 1).cast("int"), F.octet_length("d")), "o": F.col("o") + early}).where("octet_length(d) > 0")
    bins = F.sequence(F.floor(F.col("o") / width), F.floor((F.col("o") + F.octet_length("d") - 1) / width))
    rows = rows.withColumn("bin", F.explode(bins))
    low = F.greatest(F.col("o"), F.col("bin") * width)
    high = F.least(F.col("o") + F.octet_length("d"), (F.col("bin") + 1) * width)
    rows = rows.select("k", "bin", low.alias("o"), F.substring("d", (low - F.col("o") + 1).cast("int"), (high - low).cast("int")).alias("d"), "a")
    schema = "k string, start long, data binary"
    sorted_ = rows.repartition("k", "bin").sortWithinPartitions("k", "bin", "o")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        ks, starts, datas = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(starts, pa.int64()), pa.array(datas, pa.binary())], names=["k", "start", "data"])

    def sized(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in found:
            out.append(row)
            size += len(row[2]) + 64
            if size > 1 << 22:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def bin_by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from sized((key[0], o, d) for key, part in groupby(lines, lambda r: r[:2]) for o, d in swept((a, o, d) for _, _, o, d, a in part))

    def run_by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            k = begin = end = None
            held: list[bytes] = []
            for key, at, d in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if held and (key != k or at != end):
                    yield k, begin, b"".join(held)
                    held = []
                if not held:
                    k, begin = key, at
                held.append(d)
                end = at + len(d)
            if held:
                yield k, begin, b"".join(held)

        yield from sized(runs())

    found = sorted_.mapInArrow(bin_by_bin, schema)
    if joined:
        found = found.repartition("k").sortWithinPartitions("k", "start").mapInArrow(run_by_run, schema)
    return found.withColumnRenamed("k", "stream")


def flow_key(a: Column, a_port: Column, b: Column, b_port: Column) -> tuple[Column, Column]:
    """(smaller end, larger end) as structs, the same for both directions."""
    x, y = F.struct(a.alias("addr"), a_port.alias("port")), F.struct(b.alias("addr"), b_port.alias("port"))
    return F.least(x, y), F.greatest(x, y)
