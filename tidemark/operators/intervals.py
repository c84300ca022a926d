"""Interval policies: aligned tumbling, aligned with an exclusive start, restart at the closing event, and idle gaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.times import micros
from tidemark.operators.scans import BEFORE, asof, in_ranges, running
from tidemark.plans.session import stored


def aligned(df: DataFrame, ts: str, seconds: int, strict: bool = False, out: str = "bucket") -> DataFrame:
    """Bucket number since the first event.  ``strict``: an event exactly at the end still belongs to the bucket."""
    first = df.agg(F.min(micros(ts)).alias("_t0"))
    since = (micros(ts) - F.col("_t0")) / F.lit(seconds * 1_000_000)
    number = F.greatest(F.ceil(since) - 1, F.lit(0)) if strict else F.floor(since)
    return df.join(F.broadcast(first)).withColumn(out, number.cast("long")).drop("_t0")  # the one row of an aggregate


def idle_sessions(df: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """(key, session, n_events, first_us, last_us): a session ends after more than ``seconds`` without an event."""
    w = Window.partitionBy(key).orderBy(ts, order)
    t = df.select(key, ts, order, micros(ts).alias("_us"))
    new = (F.col("_us") - F.lag("_us").over(w) > seconds * 1_000_000).cast("int")
    s = t.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(w).cast("long"))
    return s.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min("_us").alias("first_us"), F.max("_us").alias("last_us"))


def whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ``_range`` (the first column), one table for each range."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                if held and held[-1].column(0)[0] != b.column(0)[x]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _next_starts(table: pa.Table, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, where each key ends, the next start of each time: the first time of its key more than ``step`` later, or its key's end in this range)."""
    us = table["us"].to_numpy()
    code = table["key"].combine_chunks().dictionary_encode().indices.to_numpy() if isinstance(table["key"], pa.ChunkedArray) else table["key"].dictionary_encode().indices.to_numpy()
    ends = np.concatenate([np.flatnonzero(code[1:] != code[:-1]) + 1, [len(us)]])
    after = np.empty(len(us), np.int64)
    for x, y in zip([0, *ends[:-1]], ends, strict=True):
        after[x:y] = x + np.searchsorted(us[x:y], us[x:y] + step, side="right")
    return us, np.repeat(ends, np.diff(np.concatenate([[0], ends]))), after


def restart_at_event(df: DataFrame, ts: str, order: str, seconds: int, key: str | None = None, parts: int | None = None) -> DataFrame:
    """(key, interval, start_us, n_events): an interval ends at the first event more than ``seconds`` after its start, and that event starts the next.

    Which events are starts follows from the first one, event by event; here by jumps.  Distinct times are dealt to ranges.  In a range, each time's chain of starts is followed to its end by doubling,
    which leaves the time after which the next start is; as-of matches give that start and its own chain's end, and doubling over these marks
    what the first start of each key reaches, in as many rounds as the number of ranges has bits.  So one key, or none, may hold all rows.  Events without a time are left out; ``order`` changes nothing."""
    step = seconds * 1_000_000
    by = F.col(key).cast("string") if key else F.lit("")
    times = df.select(F.coalesce(by, F.lit("")).alias("key"), by.isNull().alias("none"), micros(ts).alias("us")).where("us IS NOT NULL")
    times = times.groupBy("key", "none", "us").agg(F.count("*").alias("n"))
    # A null key sorts as a key of its own.
    times = times.select(F.when(F.col("none"), "1").otherwise(F.concat(F.lit("0"), "key")).alias("key"), "us", "n")
    dealt = stored(in_ranges(times, ["key", "us"], parts), "times")
    ordered = lambda d: d.repartition("_range").sortWithinPartitions("_range", "key", "us")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_ranges(batches):
            us, end, after = _next_starts(table, step)
            last = np.where(after < end, after, np.arange(len(us)))
            while not np.array_equal(last, last[last]):
                last = last[last]
            yield pa.RecordBatch.from_arrays([table["key"].combine_chunks(), pa.array(us), pa.array(us[last] + step)], names=["key", "us", "then"])

    chains = stored(ordered(dealt.select("_range", "key", "us")).mapInArrow(leave, "key string, us long, then long"), "chains")
    # A chain that ends at ``us`` goes on with ``start``, whose own chain ends at ``then``.
    ends = chains.select("key", F.col("then").alias("us")).distinct()
    hops = asof(ends, chains.withColumn("start", F.col("us")), "us", ["start", "then"], ["key"], "forward", parts=parts).where("start IS NOT NULL")
    hops = stored(hops.select("key", "us", "start", "then"), "hops")
    first = chains.groupBy("key").agg(F.min("us").alias("start"), F.min_by("then", "us").alias("us"))
    reached, jump = first.select("key", "us"), hops.select("key", "us", "then")
    ranges = dealt.agg(F.max("_range")).first()[0] or 0
    n = 0
    for _ in range(ranges.bit_length() + 1):
        more = reached.join(jump, ["key", "us"]).select("key", F.col("then").alias("us"))
        reached = stored(reached.union(more).distinct(), "reached")
        if n == (n := reached.count()):
            break
        jump = stored(jump.alias("a").join(jump.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.then") == F.col("b.us"))).select("a.key", "a.us", "b.then"), "jumps")
    entries = first.select("key", F.col("start").alias("us")).union(hops.join(reached, ["key", "us"]).select("key", F.col("start").alias("us"))).distinct().withColumn("entry", F.lit(True))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_ranges(batches):
            us, end, after = _next_starts(table, step)
            n = table["n"].to_numpy()
            start = np.zeros(len(us), bool)
            for i in np.flatnonzero(table["entry"].fill_null(False).to_numpy()):
                while i < end[i] and not start[i]:
                    start[i] = True
                    if after[i] == end[i]:
                        break
                    i = after[i]
            number = np.cumsum(start)
            at = np.concatenate([[True], number[1:] != number[:-1]])
            rows = np.flatnonzero(at)
            part = np.full(len(rows), table.column(0)[0].as_py(), np.int32)
            first_us = pa.array(us[rows], mask=~start[rows])
            yield pa.RecordBatch.from_arrays([pa.array(part), table["key"].combine_chunks().take(pa.array(rows)), pa.array(number[rows]), first_us, pa.array(np.add.reduceat(n, rows))], names=["_range", "key", "number", "start_us", "n"])

    pieces = ordered(dealt.join(entries, ["key", "us"], "left").select("_range", "key", "us", "n", "entry"))
    pieces = stored(pieces.mapInArrow(walk, "_range int, key string, number long, start_us long, n long"), "pieces")
    before = pieces.groupBy("_range").agg(F.count("start_us").alias("starts")).select("_range", F.coalesce(F.sum("starts").over(BEFORE()), F.lit(0)).alias("before"))
    found = pieces.join(F.broadcast(before), "_range").groupBy((F.col("before") + F.col("number")).alias("number"))  # a row for each range
    found = found.agg(F.min("key").alias("key"), F.min("start_us").alias("start_us"), F.sum("n").alias("n_events"))
    zero = found.groupBy("key").agg(F.min("number").alias("zero"))
    named = F.when(F.col("key").startswith("0"), F.substr("key", F.lit(2)))
    return found.join(zero, "key").select(named.alias("key"), (F.col("number") - F.col("zero")).alias("interval"), "start_us", "n_events")


def single_step(df: DataFrame, ts: str, order: str, seconds: int, key: str) -> DataFrame:
    """(key, interval, start_us, n_events): an event more than ``seconds`` after its interval's start closes it, and the start
    moves on by ``seconds`` once.  After a gap, events have intervals of their own until the start has caught up.

    Event i is in interval k(i) = min(k(i-1) + 1, c(i)), c(i) being the whole steps between it and the first event.
    Written out, k(i) = i + min over j <= i of c(j) - j: a running minimum.  Events without a time are left out."""
    step = seconds * 1_000_000
    w = Window.partitionBy("key").orderBy("us", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = df.select(F.col(key).cast("string").alias("key"), micros(ts).alias("us"), F.col(order).alias("_o")).where("us IS NOT NULL")
    t = t.withColumns({"_i": F.count("*").over(w) - 1, "_t0": F.min("us").over(w)})
    t = t.withColumn("_c", F.expr(f"greatest(us - _t0 - 1, 0) div {step}"))
    t = t.withColumn("interval", (F.col("_i") + F.min(F.col("_c") - F.col("_i")).over(w)).cast("long"))
    return t.groupBy("key", "interval").agg((F.min("_t0") + F.col("interval") * step).alias("start_us"), F.count("*").alias("n_events"))


def rebase(df: DataFrame, file: str, ts: str, order: str, gap_seconds: int = 1) -> DataFrame:
    """Concatenate captures: times become offsets, each file begins ``gap_seconds`` after the end of the one before it.  There may be any number of files."""
    spans = df.groupBy(file).agg(F.min(micros(ts)).alias("_lo"), F.max(micros(ts)).alias("_hi"))
    spans = spans.withColumn("_long", F.col("_hi") - F.col("_lo") + gap_seconds * 1_000_000)
    start = running(spans, [file], {"_end": "_long"}).select(F.col(file).alias("_file"), "_lo", (F.col("_end") - F.coalesce("_long", F.lit(0))).alias("_start"))
    return df.join(start, F.col(file).eqNullSafe(F.col("_file"))).select(*df.columns, (micros(ts) - F.col("_lo") + F.col("_start")).alias("offset_us"))


def _sources(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("nothing to merge")
    out = parts[0].withColumn("source", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source", F.lit(i)))
    return out


def merge_sorted(parts: Sequence[DataFrame], ts: str, order: str) -> DataFrame:
    """An ordered merge of sources: by time, then by the number of the source, then in each source's own order.  One range shuffle."""
    return _sources(parts).orderBy(ts, "source", order)


def merge_positions(parts: Sequence[DataFrame], ts: str, order: str) -> DataFrame:
    """The rows of ``merge_sorted``, in no order, with their ``position`` in it from 1 on."""
    return running(_sources(parts), [ts, "source", order], {"position": F.lit(1).cast("long")})
