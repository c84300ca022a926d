"""Mergers that users write in Python: ordered folds, and associative merges with partial results.

Neither gathers a key's rows: a fold passes over them in order with the state of one key, a merge keeps states only.  Where Spark's own aggregates can say it, use those
(``Index(merge=...)``): they never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Keys whose partial states a task holds at most.
HELD = 50_000


def _typed(kind: str) -> pa.DataType:
    return to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)


def _batch(keys: list, states: list, key_type: pa.DataType, state_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(states, state_type)], names=["key", "merged"])


def _rows(batches: Iterator[pa.RecordBatch], seen: list[pa.DataType]) -> Iterator[tuple[Any, Any]]:
    """(key, value) of batches with a key and a value; ``seen`` gets the key's type."""
    for b in batches:
        seen[:] = [b.schema.field(0).type]
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def fold(df: DataFrame, key, order: str | Sequence[str], value, start: Any, step: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    """(key, merged): ``kept = step(kept, value)`` over each key's rows in ``order``, from ``start`` on; ``kind`` is the type of the result.

    For mergers that depend on the order: one sorted pass, which Spark spills, and one state at a time in memory.  ``start`` is copied by nobody: use values that ``step`` does not
    change in place, or a function that makes one.  One key is one task's work, as its steps follow each other; nulls are a key."""
    of = F.expr(key) if isinstance(key, str) else key
    what = F.expr(value) if isinstance(value, str) else value
    orders = [order] if isinstance(order, str) else list(order)
    rows = df.select(of.alias("key"), what.alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(orders)])
    state = _typed(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out, seen = [], [], [pa.null()]
        for k, part in groupby(_rows(batches, seen), lambda r: r[0]):
            kept = start() if callable(start) else start
            for _, v in part:
                kept = step(kept, v)
            keys.append(k)
            out.append(kept)
            if len(out) >= 10_000:
                yield _batch(keys, out, seen[0], state)
                keys, out = [], []
        if out:
            yield _batch(keys, out, seen[0], state)

    sorted_ = rows.repartition("key").sortWithinPartitions("key", *[f"_o{i}" for i in range(len(orders))]).select("key", "value")
    return sorted_.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, merged {kind}")


def merge(df: DataFrame, key, value, lift: Callable[[Any], Any], join: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    """(key, merged): ``join`` of what ``lift`` makes of each value, in any order and grouping; ``kind`` is the type of the states.

    Each task joins its own rows first, so a frequent key is a few states for each task and any key may hold most rows."""
    of = F.expr(key) if isinstance(key, str) else key
    what = F.expr(value) if isinstance(value, str) else value
    rows = df.select(of.alias("key"), what.alias("value"))
    state = _typed(kind)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        seen = [pa.null()]
        for k, v in _rows(batches, seen):
            s = lift(v)
            held[k] = join(held[k], s) if k in held else s
            if len(held) >= HELD:
                yield _batch(list(held), list(held.values()), seen[0], state)
                held = {}
        if held:
            yield _batch(list(held), list(held.values()), seen[0], state)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out, seen = [], [], [pa.null()]
        for k, states in groupby(_rows(batches, seen), lambda r: r[0]):
            kept = next(states)[1]
            for _, s in states:
                kept = join(kept, s)
            keys.append(k)
            out.append(kept)
            if len(out) >= 10_000:
                yield _batch(keys, out, seen[0], state)
                keys, out = [], []
        if out:
            yield _batch(keys, out, seen[0], state)

    schema = f"key {rows.schema['key'].dataType.simpleString()}, merged {kind}"
    return rows.mapInArrow(part, schema).repartition("key").sortWithinPartitions("key").mapInArrow(whole, schema)
