"""WARC archives of page captures: written, indexed and merged into one globally ordered history.

1. Write: payload digests are compared across all pages; of equal payloads the capture with the
   largest id is a response and the others become revisit records.  Records are text rows of
   Spark's own writer (its line end is the last byte of a record), so real ``.warc.gz`` files land on any
   file system that Spark knows, and lost executors are made good by its commit protocol.
2. Read: files are read back whole, at most ``RECORDS`` records each, and parsed by Content-Length.  Each file is
   a capture run: its index rows, sorted by URL key, timestamp, id, file and offset, stored in the shared folder.
3. Merge: runs are dealt by range of the same key, ``RANGE`` rows a range or so.  The key names one record, so even a URL with a third of all
   captures, or with captures that look the same, is spread.  The shuffle gives a range its runs one after the other, each in its order;
   a loser tree with one cursor in each run merges them.  The result is globally ordered across partitions.

Defined cases: a null payload is empty; a null url has an empty key; a null id comes first among captures of one time, and is
a revisit where an equal payload has an id (without any, all are responses); repeated rows are written once each, and rows that repeat the largest id are responses all; captures that are equal in key, time and id are in the order of their place in the
archives; an empty table gives an empty index; columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import shared_dir, spread_join, trim
from tidemark.llm.url_filter import host_and_path

RECORDS, RANGE = 4000, 50_000
ORDER = ("urlkey", "ts", "id", "file", "offset")
INDEX = "urlkey string, ts string, id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def url_key(url: str | Column) -> Column:
    """Reversed host labels, then path and query, as capture indexes sort them."""
    host, path = host_and_path(url)
    u = F.col(url) if isinstance(url, str) else url
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), path, F.coalesce(F.regexp_extract(u, "[?][^#]*", 0), F.lit("")))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for id_, url, ts, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
            body = html.encode()
            kind = "response" if refers is None else "revisit"
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (body if refers is None else b"")
            head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(id_))}>".encode(), b"WARC-Date: " + ts.encode(), b"WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or "").encode(), b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)), f"X-Capture-Id: {id_}".encode(), f"X-Payload-Length: {len(body)}".encode()]
            if refers is not None:
                head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(refers))}>".encode(), f"X-Refers-To-Id: {refers}".encode()]
            head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
            out.append(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])
    trim()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts: Column | None = None, least_bytes: int = 0) -> None:
    """``ts``: the capture time as ISO text; by default the epoch of 2024 plus the id in seconds, as pages have no time."""
    when = ts if ts is not None else F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col(id_col), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), when.alias("ts"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    newest = pages.select(F.col(id_col).cast("long").alias("id"), html.alias("html")).where(F.octet_length("html") >= least_bytes).groupBy(F.sha1(F.col("html").cast("binary")).alias("digest")).agg(F.max("id").alias("top"), F.count("*").alias("k")).where("k > 1").select("digest", "top")
    told = spread_join(rows, newest, ["digest"], ["id", "url"]).select("id", "url", "ts", "html", "digest", F.when(~F.col("top").eqNullSafe(F.col("id")), F.col("top")).alias("refers"))
    told.mapInArrow(_records, "value string").write.option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + size + 4


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            raw = zlib.decompress(content.as_buffer(), 47)
            rows = []
            for at, head, body in parse(raw):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"digest of the record at {at} in {path} is wrong")
                id_, refers = head["X-Capture-Id"], head.get("X-Refers-To-Id")
                rows.append((head["WARC-Target-URI"], head["WARC-Date"], None if id_ == "None" else int(id_), int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers and int(refers), path.as_py(), at))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["url", "ts", "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """An index row for each record of the archives; those of a file are together and sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    rows = files.mapInArrow(_runs, "url string, ts string, id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")
    rows = rows.select(url_key("url").alias("urlkey"), "ts", "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset")
    return rows.sortWithinPartitions("file", *ORDER)


class LoserTree:
    """The k-way merge of sorted iterators of tuples: each inner node keeps the run that lost there, so a step replays one path of log2 k matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        for r in range(self.k):
            self._replay(r)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, r: int) -> None:
        node = (r + self.k) // 2
        while node:
            if self.losers[node] == -1:  # the first to come here waits for its opponent
                self.losers[node] = r
                return
            if self._beats(self.losers[node], r):
                self.losers[node], r = r, self.losers[node]
            node //= 2
        self.losers[0] = r

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _cursor(t: pa.Table, at: int, end: int) -> Iterator[tuple]:
    """(key..., row) of the rows of one run."""
    for lo in range(at, end, 1000):
        part = t.slice(lo, min(1000, end - lo))
        cols = [part[c].to_pylist() for c in ORDER]
        for i, (url, ts, id_, file, offset) in enumerate(zip(*cols, strict=True)):
            yield url, ts, id_ is not None, id_ or 0, file, offset, lo + i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    run = t["file"].combine_chunks().dictionary_encode()
    code = (run.combine_chunks() if isinstance(run, pa.ChunkedArray) else run).indices.to_numpy()
    cuts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)]
    rows: list[int] = []
    for *_, row in LoserTree([_cursor(t, a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]):
        rows.append(row)
        if len(rows) == 10_000:
            yield from t.take(pa.array(rows, pa.int64())).combine_chunks().to_batches()
            rows = []
    if rows:
        yield from t.take(pa.array(rows, pa.int64())).combine_chunks().to_batches()
    trim()


def merge(runs: DataFrame) -> DataFrame:
    """Capture histories ordered by URL key, timestamp and id, across partitions too.  The rows are counted first."""
    ranges = max(1, ceil(runs.count() / RANGE))
    return runs.repartitionByRange(ranges, *ORDER).sortWithinPartitions("file", *ORDER).mapInArrow(_merge, INDEX)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write, read back and merge; the index, with file and offset of every record."""
    spark = pages.sparkSession
    place = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, f"{place}/archive", id_col, url_col, payload_col, least_bytes=least_bytes)
    read(spark, f"{place}/archive").write.parquet(f"{place}/runs")
    return merge(spark.read.schema(T._parse_datatype_string(INDEX)).parquet(f"{place}/runs"))
