"""Record stores and declared orderings over them.

A store is an immutable version: a DataFrame, the column that tells arrival order, and the indices declared over it.  Appending, sweeping,
purging and removing return new versions.  An index is a description (key, direction, what happens to equal keys); asking it
yields a DataFrame, so Catalyst sees filters, projections and aggregations as one plan.
Nulls in keys sort first, as Spark sorts them; a null prune condition keeps the row.

Results come in the order that the index declares: ``query`` and ``eq`` in index order, ``lt`` from the nearest key downwards, ``gt`` from the
nearest key upwards.  That is a range shuffle; ``ordered=False`` leaves it out for consumers that do not look at the order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import mergers, scans

Expr = Column | str


def column(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def tested(df: DataFrame, test: Callable[[dict], bool]) -> Column:
    """A Python predicate on rows as a condition on ``df``.  The slow path: every row goes to Python, and no filter reaches the source."""

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(test(r)) for r in rows.to_dict("records")], dtype=bool)

    return run(F.struct(*df.columns))


@dataclass(frozen=True)
class Store:
    df: DataFrame
    row_id: str
    prune: Column | Callable[[dict], bool] | None = None
    routed: bool = False
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def indirect(cls, source: DataFrame, row_id: str, **kw) -> Store:
        """A view over caller-owned rows: nothing is copied by any store."""
        return cls(source, row_id, **kw)

    def stamped(self) -> Store:
        """With ingestion time and an empty hit count."""
        return replace(self, df=self.df.withColumns({"_ts": F.current_timestamp(), "_query_count": F.lit(0).cast("long")}))

    def scan(self, newest_first: bool = False) -> DataFrame:
        return self.df.orderBy(F.desc(self.row_id)) if newest_first else self.df

    def get_at(self, i: int) -> DataFrame:
        return self.df.where(F.col(self.row_id) == i)

    def size(self) -> int:
        return self.df.count()

    def append(self, rows: DataFrame, routes: Sequence[str] | None = None) -> Store:
        """``routes``: only indices of these names get the rows; without it, every index that takes all rows does."""
        if routes is None and not self.routed:
            return replace(self, df=self.df.unionByName(rows))
        to = F.lit(None).cast("array<string>") if routes is None else F.array(*[F.lit(r) for r in routes]).cast("array<string>")
        have = self.df if self.routed else self.df.withColumn("_routes", F.lit(None).cast("array<string>"))
        return replace(self, df=have.unionByName(rows.withColumn("_routes", to)), routed=True)

    def set_prune(self, condition: Expr | Callable[[dict], bool]) -> Store:
        """A condition, or a Python function of a row (see ``tested``)."""
        return replace(self, prune=column(condition) if isinstance(condition, Column | str) else condition)

    def sweep(self) -> tuple[Store, DataFrame]:
        """(version without pruned rows, pruned rows): one scan each, and filters reach the source."""
        prune = F.lit(False) if self.prune is None else self.prune if isinstance(self.prune, Column) else tested(self.df, self.prune)
        p = F.coalesce(prune, F.lit(False))
        return replace(self, df=self.df.where(~p)), self.df.where(p)

    def purge(self) -> Store:
        return replace(self, df=self.df.limit(0))

    def remove(self, ids: DataFrame | Sequence[int]) -> Store:
        if isinstance(ids, DataFrame):
            return replace(self, df=self.df.join(ids.select(F.col(ids.columns[0]).alias(self.row_id)), self.row_id, "left_anti"))
        return replace(self, df=self.df.where(~F.col(self.row_id).isin(list(ids))))

    def query(self, condition: Expr | Callable[[dict], bool]) -> Store:
        """The result is a store again.  A Python function of a row works too (see ``tested``)."""
        return replace(self, df=self.df.where(tested(self.df, condition) if not isinstance(condition, Column | str) else column(condition)))

    def route(self, **conditions: Expr) -> dict[str, Store]:
        """One store for each named condition; a row goes to every one that it meets."""
        return {name: self.query(c) for name, c in conditions.items()}

    def index(self, key: Expr, **kw) -> Index:
        if key is None:
            raise ValueError("an index needs a key")
        return Index(self, column(key), **kw)


@dataclass(frozen=True)
class Index:
    """``takes_all``: gets rows that have no routes.  ``newest_first``: equal keys in reverse order of arrival.  ``after_row``: does not hold earlier rows."""

    store: Store
    key: Column
    descending: bool = False
    drop_duplicates: bool = False
    merge: tuple[Column, ...] = ()
    after_row: int | None = None
    name: str = ""
    takes_all: bool = True
    newest_first: bool = False
    gone: tuple[DataFrame, ...] = ()
    luid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        if self.merge and self.newest_first:
            raise ValueError("merged rows have no arrival order")
        if not self.takes_all and not self.name:
            raise ValueError("an index that takes routed rows only needs a name")

    def _rows(self) -> DataFrame:
        df = self.store.df
        if self.store.routed:
            named = F.array_contains("_routes", self.name)
            df = df.where(F.coalesce(named, F.lit(self.takes_all))).drop("_routes")
        elif not self.takes_all:
            df = df.limit(0)
        for ids in self.gone:
            df = df.join(ids, self.store.row_id, "left_anti")
        return df if self.after_row is None else df.where(F.col(self.store.row_id) > self.after_row)

    def remove(self, ids: DataFrame) -> Index:
        """The index without these rows; the store keeps them."""
        return replace(self, gone=(*self.gone, ids.select(F.col(ids.columns[0]).alias(self.store.row_id))))

    def rows(self) -> DataFrame:
        """What the index holds: all rows, the first of each key, or the merged row of each key."""
        df = self._rows()
        if self.merge:
            return df.groupBy(self.key.alias("key")).agg(*self.merge)
        if self.drop_duplicates:
            first = df.groupBy(self.key.alias("_key")).agg(F.min_by(F.struct(*df.columns), self.store.row_id).alias("_row"))
            return first.select("_row.*")
        return df

    def folded(self, merger: Callable[[dict, dict], dict]) -> DataFrame:
        """One row for each key: ``merger(new, kept)`` over its rows in order of arrival, from the first on.  The merger is any Python function of two rows."""
        df = self._rows()
        kind = df.schema.simpleString()
        step = lambda kept, new: new if kept is None else merger(new, kept)
        return mergers.fold(df, self.key, self.store.row_id, F.struct(*df.columns), None, step, kind).select("merged.*")

    def _key(self) -> Column:
        return F.col("key") if self.merge else self.key

    def _order(self, down: bool) -> list[Column]:
        tie = [] if self.merge else [F.desc(self.store.row_id) if self.newest_first else F.asc(self.store.row_id)]
        return [self._key().desc() if down else self._key().asc(), *tie]

    def ordered(self, reverse: bool = False) -> DataFrame:
        return self.rows().orderBy(*self._order(self.descending != reverse))

    def positions(self) -> DataFrame:
        """All rows with their ``position`` in index order, from 1 on; every row's, without a task that sees all."""
        if self.merge or self.newest_first or self.descending:
            raise ValueError("positions are those of rows in ascending order")
        found = scans.running(self.rows().withColumn("_key", self.key), ["_key", self.store.row_id], {"position": F.lit(1).cast("long")})
        return found.drop("_key")

    def _found(self, condition: Column, down: bool, ordered: bool) -> DataFrame:
        df = self.rows().where(condition)
        return df.orderBy(*self._order(down)) if ordered else df

    def query(self, condition: Expr, ordered: bool = True) -> DataFrame:
        return self._found(column(condition), self.descending, ordered)

    def eq(self, v, ordered: bool = True) -> DataFrame:
        return self._found(self._key() == v, self.descending, ordered)

    def lt(self, v, ordered: bool = True) -> DataFrame:
        return self._found(self._key() < v, True, ordered)

    def gt(self, v, ordered: bool = True) -> DataFrame:
        return self._found(self._key() > v, False, ordered)

    def prefix(self, text: str, ordered: bool = True) -> DataFrame:
        """Rows whose string key starts with ``text``."""
        return self._found(self._key().startswith(text), self.descending, ordered)

    def lookup(self, v, direction: int = 0, by: Sequence[str] = ()) -> DataFrame:
        """The row at the key (0), at the next lower (-1) or higher (+1) one; ties go to the earliest row; one for each group of ``by``."""
        df = (self.lt, self.eq, self.gt)[direction + 1](v, ordered=False)
        key, id_ = self._key(), F.col(self.store.row_id)
        # The earliest row of each key, then the nearest key: ids may be of any type that has an order.
        first = df.groupBy(*by, key.alias("_key")).agg(F.min_by(F.struct(*df.columns), id_).alias("_row"))
        best = (F.max_by if direction < 0 else F.min_by)("_row", "_key")
        return (first.groupBy(*by) if by else first.groupBy()).agg(best.alias("_row")).where("_row IS NOT NULL").select("_row.*")

    def neighbours(self, by: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
        """Previous and next values of ``columns`` in index order, in each group of ``by``; without groups, over all rows, range by range."""
        if by:
            w = Window.partitionBy(*by).orderBy(self.key.desc() if self.descending else self.key.asc(), self.store.row_id)
            return self.rows().select("*", *[f(c).over(w).alias(f"{n}_{c}") for c in columns for n, f in (("prev", F.lag), ("next", F.lead))])
        if self.descending:
            raise ValueError("neighbours over all rows go up; read prev for next")
        rows = self.rows()
        found = scans.neighbours(rows.withColumn("_key", self._key()), ["_key", self.store.row_id], columns)
        return found.drop("_key")

    def nearest(self, probes: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), direction: int = -1, strict: bool = True, tolerance: float | None = None) -> DataFrame:
        """``lookup`` for many probes at once: each with ``values`` of the row whose key is next below (-1), above (1) or nearer of these (0) to its ``on``; ties go to the earliest row.

        Groups of ``by`` may have any size, and there may be none."""
        rows = self.rows().withColumn(on, self._key())
        return scans.asof(probes, rows, on, values, by, {-1: "backward", 1: "forward", 0: "nearest"}[direction], strict, tolerance, self.store.row_id)

    def size(self) -> DataFrame:
        return self._rows().agg(F.count("*").alias("n_rows"), F.countDistinct(self.key).alias("n_keys"))

    def ends(self, by: Sequence[str]) -> DataFrame:
        """(*by, first_id, last_id): the rows that pops would take first and last."""
        id_ = F.col(self.store.row_id)
        at = F.struct(self.key, id_)
        return self.rows().groupBy(*by).agg(F.min_by(id_, at).alias("first_id"), F.max_by(id_, at).alias("last_id"))

    def pop(self, last: bool = False, by: Sequence[str] = ()) -> tuple[DataFrame, Store]:
        """(the row with the smallest or largest key, of each group of ``by``; the store without it).  Ties: the earliest row first, the latest last."""
        df, at = self.rows(), F.struct(self.key, F.col(self.store.row_id))
        row = (F.max_by if last else F.min_by)(F.struct(*df.columns), at).alias("_row")
        taken = (df.groupBy(*by) if by else df.groupBy()).agg(row).where("_row IS NOT NULL").select("_row.*")
        return taken, self.store.remove(taken.select(self.store.row_id))

    def verify(self) -> bool:
        """Whether the ordered scan is ordered: inside each partition, and from each to the next."""
        k = self.ordered().select(self._key().alias("k"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
        w = Window.partitionBy("part").orderBy("at")
        wrong = (F.col("k") > F.col("p")) if self.descending else (F.col("k") < F.col("p"))
        parts = k.withColumn("p", F.lag("k").over(w)).groupBy("part").agg(F.min_by("k", "at").alias("first"), F.max_by("k", "at").alias("last"), F.max(F.coalesce(wrong, F.lit(False))).alias("wrong"))
        rows = sorted(parts.collect(), key=lambda r: r["part"])  # one row for each partition
        if any(r["wrong"] for r in rows):
            return False
        steps = [(a["last"], b["first"]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        return all(x is None or y is None or (x >= y if self.descending else x <= y) for x, y in steps)


class IndexGroup:
    """A tree of indices of one store; a query asks each member and keeps duplicates unless told otherwise."""

    def __init__(self, *members: Index | IndexGroup):
        self.members: list[Index | IndexGroup] = []
        for m in members:
            self.add(m)

    def add(self, m: Index | IndexGroup) -> None:
        ours, theirs = {i.store.id for i in self.flatten()}, {i.store.id for i in ([m] if isinstance(m, Index) else m.flatten())}
        if ours and theirs - ours:
            raise ValueError("the index belongs to another store")
        self.members.append(m)

    def delete(self, luid: str) -> None:
        self.members = [m for m in self.members if not (isinstance(m, Index) and m.luid == luid)]
        for m in self.members:
            if isinstance(m, IndexGroup):
                m.delete(luid)

    def flatten(self) -> list[Index]:
        return [i for m in self.members for i in ([m] if isinstance(m, Index) else m.flatten())]

    def size(self) -> int:
        return len(self.members)

    def query(self, *conditions: Expr, distinct: bool = False) -> DataFrame:
        """One condition for all members, or one for each; a group without members has no rows to ask."""
        every = self.flatten()
        if not every:
            raise ValueError("the group has no indices")
        if len(conditions) not in (1, len(every)):
            raise ValueError(f"{len(conditions)} conditions for {len(every)} indices")
        parts = [i.query(c, ordered=False) for i, c in zip(every, conditions * len(every) if len(conditions) == 1 else conditions, strict=True)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct() if distinct else out


def multi_index_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key_name, key_value, n) for several keys in one scan and one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value")) for k in keys])).alias("x")
    return df.select(pairs).groupBy("x.key_name", "x.key_value").agg(F.count("*").alias("n"))


def lookup_join(probes: DataFrame, rows: DataFrame, by: Sequence[str], on: str, value: str, out: str) -> DataFrame:
    """For each probe, ``value`` of the row with the nearest strictly lower ``on``: a union and one sort within groups."""
    p = probes.withColumns({"_k": F.lit(0), "_v": F.lit(None).cast(rows.schema[value].dataType)})
    r = rows.select(*by, on, F.lit(1).alias("_k"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(on, "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(r, allowMissingColumns=True)
    return both.withColumn(out, F.last("_v", True).over(w)).where("_k = 0").drop("_k", "_v")
