"""A named set of indices and groups over the current version of a store, with what follows from its changes.

The store itself stays immutable; this object points at its current version.  Queries give child databases: a child keeps the rows it was
asked for when later rows arrive, and loses the rows that its parent sweeps or purges, and so do its own children, whether or not anybody still holds the databases
between.  A sweep without a prune condition drops nothing.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.session import shared_dir
from tidemark.plans.store import Expr, Index, IndexGroup, Store, column


class Database:
    def __init__(self, store: Store, archive: Callable[[DataFrame], object] | None = None, count_hits: bool = False, ancestors: Sequence[Database] = ()):
        """``archive`` gets what a sweep prunes.  ``count_hits``: remember which rows queries gave (see ``hits``).  ``ancestors``: databases whose sweeps and purges reach this one."""
        self.store, self.archive, self.count_hits = store, archive, count_hits
        self._specs: dict[str, dict] = {}
        self._groups: dict[str, list[str]] = {}
        self._heirs: weakref.WeakSet[Database] = weakref.WeakSet()
        self._ancestors = tuple(ancestors)  # held, so that a database lives as long as what was asked of it
        for a in self._ancestors:
            a._heirs.add(self)
        self._log: list[str] = []

    def create_index(self, name: str, key: Expr, populate: bool = True, **kw) -> Index:
        """``populate=False``: only rows that arrive from now on.  Other settings are those of ``Index``."""
        if name in self._specs or name in self._groups:
            raise ValueError(f"{name} is there already")
        if key is None:
            raise ValueError("an index needs a key")
        after = None if populate else self.store.df.agg(F.max(self.store.row_id)).first()[0]  # null for an empty store: all rows are later
        self._specs[name] = {"key": column(key), "after_row": after, "name": name, **kw}
        return self.index(name)

    def index(self, name: str) -> Index:
        """The index over the store's current version."""
        return Index(self.store, **self._specs[name])

    def create_group(self, name: str, *members: str) -> None:
        if name in self._specs or name in self._groups:
            raise ValueError(f"{name} is there already")
        for m in members:
            if m not in self._specs and m not in self._groups:
                raise ValueError(f"no index or group {m}")
        self._groups[name] = list(members)

    def group(self, name: str = "") -> IndexGroup:
        """A group by name; without a name, all indices that take all rows."""
        if not name:
            return IndexGroup(*[self.index(n) for n, s in self._specs.items() if s.get("takes_all", True)])
        return IndexGroup(*[self.group(m) if m in self._groups else self.index(m) for m in self._groups[name]])

    def names(self) -> list[str]:
        return [*self._specs, *self._groups]

    def delete(self, name: str) -> None:
        """Take an index or group out, of groups that hold it too."""
        self._specs.pop(name, None)
        self._groups.pop(name, None)
        for members in self._groups.values():
            members[:] = [m for m in members if m != name]

    def add(self, rows: DataFrame, routes: Sequence[str] | None = None) -> None:
        """``routes``: names of the indices and groups that get the rows, and no others do."""
        self.store = self.store.append(rows, None if routes is None else [n for r in routes for n in self._indices(r)])

    def _indices(self, name: str) -> list[str]:
        return [i for m in self._groups[name] for i in self._indices(m)] if name in self._groups else [name]

    def query(self, name: str, condition: Expr) -> Database:
        return self._child(self.index(name).query(condition, ordered=False))

    def eq(self, name: str, v) -> Database:
        return self._child(self.index(name).eq(v, ordered=False))

    def lt(self, name: str, v) -> Database:
        return self._child(self.index(name).lt(v, ordered=False))

    def gt(self, name: str, v) -> Database:
        return self._child(self.index(name).gt(v, ordered=False))

    def _child(self, rows: DataFrame) -> Database:
        if self.count_hits:
            path = f"{shared_dir(rows.sparkSession)}/hits-{uuid.uuid4().hex}"
            rows.select(self.store.row_id).write.parquet(path)
            self._log.append(path)
        return Database(Store(rows, self.store.row_id, self.store.prune), ancestors=(*self._ancestors, self))

    def hits(self) -> DataFrame:
        """The store's rows and ``_query_count``: how many queries of this database gave each."""
        df, id_ = self.store.df, self.store.row_id
        if not self._log:
            return df.withColumn("_query_count", F.lit(0).cast("long"))
        log = df.sparkSession.read.schema(df.select(id_).schema).parquet(*self._log).groupBy(id_).agg(F.count("*").alias("_query_count"))
        return df.join(log, id_, "left").withColumn("_query_count", F.coalesce("_query_count", F.lit(0)))

    def set_prune(self, condition: Expr | Callable[[dict], bool]) -> None:
        self.store = self.store.set_prune(condition)

    def sweep(self) -> DataFrame:
        """Drop the pruned rows here and in all children, and give them (to the archive too)."""
        kept, gone = self.store.sweep()
        if self.archive is not None:
            self.archive(gone)
        if self.store.prune is not None:
            for d in self._heirs:
                d.store = replace(d.store.set_prune(self.store.prune).sweep()[0], prune=d.store.prune)
        self.store = kept
        return gone

    def purge(self) -> None:
        for d in [*self._heirs, self]:
            d.store = d.store.purge()
