"""How far the sources of a language differ in their words: an exact audit over all documents.

Terms are runs of letters and of bytes from 0x80 on, A-Z lower-cased.  A language keeps the terms that at least ``least_docs`` of its documents hold.
Kept terms are encoded as integers: range partitions give sorted stretches of at most ``width`` kept terms of one language (chunks), ``searchsorted`` gives a term's place in its chunk,
and ``bincount`` the counts of each source.  Chunk numbers and places follow the UTF-8 order of the terms, so ties need no strings.  With N the count of
a group over kept terms and V the number of kept terms of its language, a count c is the share p = 1 + floor(10**9 * (c + 1) / (N + V)); two shares differ by
floor((p - q)**2 / q).  All of it is in integers.

A task counts the terms of about ``flush`` bytes of text before anything is shuffled, so a frequent term or a hot source is a few rows for each task.  A source's row
of a chunk meets the others' in blocks of about ``BLOCK`` sources; what a task holds is two blocks of one chunk, whatever the number of documents, terms or sources.

Defined cases: null text, lang and source are empty strings, and those are a language and a source like any other; repeated rows are documents of their own, whatever their ids; a group without
terms is compared too; a language without kept terms has differences of 0 and no terms; a language with one source has no pairs; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._spark import spread_join, stored, trim
from tidemark.llm._text import _FOLD, Words

FLUSH = 8 << 20
WIDTH = 4096
BLOCK = 64
ONE = 10**9
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, d): occurrences and documents of each term in each group of some documents."""
    w = Words(text, table=LETTER)
    lengths = w.end - w.start
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    letters = _FOLD.astype(np.uint8)[w.data[LETTER[w.data]]]
    terms = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
    size = max(len(terms.dictionary), 1)
    doc = np.repeat(np.arange(len(text)), np.diff(w.first))
    pairs, n = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
    keys, where = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
    of, term = np.divmod(keys, size)
    of = np.divmod(of, max(len(sources.dictionary), 1))
    columns = [langs.dictionary.take(pa.array(of[0])), sources.dictionary.take(pa.array(of[1])), terms.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(np.bincount(where, n, len(keys)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(keys)))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])


def strings(column: pa.ChunkedArray) -> np.ndarray:
    """As Python objects, whose order is that of UTF-8 (numpy's own strings are found wrongly by its searchsorted)."""
    return column.to_numpy()


def _count(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(2).nbytes
            if size >= flush:
                yield counted(*pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns)
                held, size = [], 0
        if held:
            yield counted(*pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns)
        trim()

    return run


def _encode(wide: int):
    """Sorted (lang, term, source, n) to chunks of at most ``wide`` terms: a row of terms and their totals (without a source), and a row of each source that has any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def chunk(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            text = strings(t["term"])
            kept = text[np.concatenate([[True], text[1:] != text[:-1]])]
            ids, n = np.searchsorted(kept, text), t["n"].to_numpy()
            sources = t["source"].combine_chunks().dictionary_encode()
            s = sources.indices.to_numpy()
            order = np.lexsort([ids, s])
            cut = np.searchsorted(s[order], np.arange(len(sources.dictionary) + 1))
            total = np.zeros(len(kept), np.int64)
            np.add.at(total, ids, n)
            k = len(cut) - 1
            offs = pa.array(np.concatenate([[0], [len(kept)], len(kept) + cut[1:]]).astype(np.int32))
            places = pa.ListArray.from_arrays(offs, pa.array(np.concatenate([np.arange(len(kept)), ids[order]]).astype(np.int32)))
            counts = pa.ListArray.from_arrays(offs, pa.array(np.concatenate([total, n[order]]).astype(np.int64)))
            terms = pa.array([kept.tolist(), *[None] * k], pa.list_(pa.string()))
            number = (part << 32) + made
            made += 1
            names = ["lang", "chunk", "width", "source", "ids", "counts", "terms"]
            return pa.RecordBatch.from_arrays([pa.array([t["lang"][0].as_py()] * (k + 1)), pa.array([number] * (k + 1), pa.int64()), pa.array([len(kept)] * (k + 1), pa.int64()), pa.array([None, *sources.dictionary.to_pylist()], pa.string()), places, counts, terms], names=names)

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole chunks of what is held; the last, unfinished one stays."""
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            lang, term = strings(t["lang"]), strings(t["term"])
            other = np.concatenate([[True], lang[1:] != lang[:-1]])
            new = np.flatnonzero(other | np.concatenate([[True], term[1:] != term[:-1]]))
            starts = np.flatnonzero(other[new])
            cuts = [new[x] for a, b in zip(starts, [*starts[1:], len(new)], strict=True) for x in range(a, b, wide)] + [t.num_rows]
            for a, b in zip(cuts[: None if last else -1], cuts[1 : None if last else -1], strict=False):
                yield chunk(t.slice(a, b - a))
            held = [] if last else t.slice(cuts[-2]).to_batches()

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= 8 * wide:
                yield from ready(False)
                rows = -sum(x.num_rows for x in held) // 2  # a chunk longer than this is looked at again once it has grown
        if held:
            yield from ready(True)
        trim()

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (counts + 1) / total), in whole numbers of any size."""
    if counts.size and counts.max() >= (1 << 63) // ONE - 1:
        counts, total = counts.astype(object), np.asarray(total).astype(object)
    return (1 + ONE * (counts + 1) // total).astype(np.int64)


def _differences(top: int):
    """Rows sorted by (lang, chunk, a, b) to sums of pairs of sources (terms null) and the first ``top`` terms of each source in the chunk."""

    def group(rows: list[dict]) -> pa.RecordBatch:
        words = next((r for r in rows if r["source"] is None), None)
        rows = [r for r in rows if r["source"] is not None]
        width = rows[0]["width"]
        dense = np.zeros((len(rows), width), np.int64)
        for x, r in zip(dense, rows, strict=True):
            if r["ids"] is not None:
                x[r["ids"]] = r["counts"]
        p = shares(dense, np.array([[r["total"] + r["v"]] for r in rows], np.int64))
        names = [r["source"] for r in rows]
        out: list[tuple] = []
        side = np.array([r["block"] for r in rows])
        a, b = rows[0]["a"], rows[0]["b"]
        for i, own in enumerate(names):
            others = np.flatnonzero((side == (b if side[i] == a else a)) & (np.arange(len(rows)) != i))
            d = p[i] - p[others]
            out += [(own, None, names[j], int(v)) for j, v in zip(others, (d * d // p[others]).sum(1), strict=True)]
        if words is not None:  # one of the groups (lang, chunk, a, a): all sources of a block
            q = shares(np.array(words["counts"], np.int64), words["total"] + words["v"])
            d = p - q
            value = d * d // q
            for i, own in enumerate(names):
                at = np.flatnonzero((dense[i] > 0) & (d[i] > 0))
                at = at[np.argsort(-value[i, at], kind="stable")[:top]]  # places follow the terms' order
                out += [(own, int(x), words["terms"][x], int(value[i, x])) for x in at]
        k = len(out)
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["lang"]] * k, pa.string()), pa.array([rows[0]["chunk"]] * k, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["lang", "chunk", "source", "place", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for r in b.to_pylist():
                now = (r["lang"], r["chunk"], r["a"], r["b"])
                if held and now != key:
                    yield group(held)
                    held = []
                key = now
                held.append(r)
        if held:
            yield group(held)
        trim()

    return run


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, width: int = WIDTH, flush: int = FLUSH) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language (``pair``) by difference, and the first ``top`` terms that it uses more than its language (``term``)."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = d.mapInArrow(_count(flush), "lang string, source string, term string, n long, d long")
    # Both sums and the window use this one shuffle.
    terms = terms.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = terms.withColumn("df", F.sum("d").over(Window.partitionBy("lang", "term"))).where(F.col("df") >= least_docs)
    kept = stored(kept.select("lang", "term", "source", "n"), "kept_terms")
    chunks = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_encode(width), "lang string, chunk long, width long, source string, ids array<int>, counts array<long>, terms array<string>")
    chunks = stored(chunks, "chunks")

    # Groups: N of each, and V, N and the number of blocks of its language.
    n = chunks.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))
    groups = d.select("lang", "source").distinct().join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    v = chunks.where("source IS NULL").groupBy("lang").agg(F.sum("width").alias("v"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(v, "lang", "left").select("lang", "whole", "blocks", F.coalesce("v", F.lit(0)).alias("v"))
    groups = stored(groups.join(whole, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")

    has = chunks.where("source IS NULL").select("lang", "chunk", "width")
    cells = spread_join(has, groups.select("lang", "source", "total", "v", "block", "blocks"), ["lang"], ["chunk"], "inner", 64)
    cells = cells.join(chunks.where("source IS NOT NULL").select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    cells = cells.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "_y"), "b": F.greatest("block", "_y"), "terms": F.lit(None).cast("array<string>")})
    words = spread_join(chunks.where("source IS NULL"), whole, ["lang"], ["chunk"], "inner", 64).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    words = words.withColumns({"b": F.col("a"), "block": F.col("a"), "total": F.col("whole")})
    columns = ["lang", "chunk", "a", "b", "source", "block", "width", "total", "v", "ids", "counts", "terms"]
    rows = cells.select(columns).union(words.select(columns)).repartition("lang", "chunk", "a", "b").sortWithinPartitions("lang", "chunk", "a", "b")
    found = stored(rows.mapInArrow(_differences(top), "lang string, chunk long, source string, place int, item string, value long"), "differences")

    pairs = found.where("place IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("v = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    ranked = pairs.union(none).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "place")
    best = found.where("place IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(best.select("lang", "source", F.lit("term"), "item", "value", "rank"))
