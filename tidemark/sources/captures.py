"""Packet captures and flow exports as rows.

Two ways in, one record reader behind both.  ``read`` and ``stream`` go through Spark's binaryFile source: any store that Spark
reaches, files under 2 GB, one file in memory at a time.  ``CaptureSource`` is a data source that cuts captures of any size into parts of ``split`` bytes, a task each,
on stores that Arrow's file systems reach.  Damaged stretches are stepped over, and told by the kind ``damage``.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PACKETS = "file string, record long, ts_us long, incl_len long, orig_len long, packet binary"
FLOWS = "file string, record long, export_secs long, first_ms long, last_ms long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, packets long, octets long, tcp_flags int, src_as int, dst_as int"
ROWS = 4096
#: No capture holds a longer packet; a larger length means damage.
LONGEST = 1 << 26
SPLIT = 128 << 20
#: Bytes of a written capture, but for its last record: ``read`` holds one file in memory.
ROLL = 16 << 20

# Fixed values of the capture format: magic number -> (byte order, ticks a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}


class Bytes:
    """Random access to a capture: a buffer, or a file read in pieces of ``STEP`` bytes.  ``size``: where it ends."""

    STEP = 1 << 20

    def __init__(self, f: BinaryIO):
        self.f, self.at, self.held = f, 0, b""
        self.size = f.seek(0, 2)

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, self.STEP))
        return self.held[at - self.at : at - self.at + n]


class Capture:
    """Records of a capture between two offsets; what is damaged is stepped over and told.

    A record belongs to the part of the file that its header starts in.  Records begin where a chain of headers, each where the record before it ends, goes on for ``CHAIN`` times the largest
    record, or to the very end: no packet holds such a chain, and one that begins wrongly has met the right one by then or broken off.  A part that does not begin the file takes up the chain as far
    before its first byte, and passes it.  The same search finds where a file goes on after damage."""

    CHAIN = 8

    def __init__(self, f: BinaryIO):
        self.bytes = Bytes(f)
        head = self.bytes.get(0, 24)
        self.empty = len(head) < 24
        if self.empty:
            return
        if head[:4] not in MAGIC:
            raise ValueError("not a packet capture")
        self.order, self.ticks = MAGIC[head[:4]]
        self.form = struct.Struct(f"{self.order}IIII")
        snap = struct.unpack(f"{self.order}I", head[16:20])[0]
        self.longest = snap if 0 < snap <= LONGEST else LONGEST
        self.reach = self.CHAIN * ((snap if 0 < snap <= 1 << 20 else 1 << 18) + 16)

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """The header at an offset, if there can be one: its record ends in the file, and its parts fit each other."""
        h = self.bytes.get(at, 16)
        if len(h) < 16:
            return None
        sec, part, kept, full = self.form.unpack(h)
        return (sec, part, kept, full) if part < self.ticks and kept <= min(full, LONGEST) and at + 16 + kept <= self.bytes.size else None

    def chained(self, at: int) -> bool:
        to = at
        while to - at <= self.reach and to < self.bytes.size:
            h = self.header(to)
            if h is None or h[2] > self.longest:
                return False
            to += 16 + h[2]
        return to > at

    def find(self, at: int) -> int:
        """The first offset from ``at`` on where records begin again (the file's size, if none)."""
        while at < self.bytes.size:
            window = self.bytes.get(at, min(Bytes.STEP, self.bytes.size - at))
            if len(window) < 16:
                break
            x = np.frombuffer(window, np.uint8).astype(np.uint32)
            shift = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
            n = len(window) - 15
            number = lambda k: sum(x[k + i : k + i + n] << s for i, s in enumerate(shift))  # noqa: E731, B023
            for i in np.flatnonzero((number(4) < self.ticks) & (number(8) <= np.minimum(number(12), LONGEST))).tolist():
                if self.chained(at + i):
                    return at + i
            at += n
        return self.bytes.size

    def records(self, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, int, bytes | None]]:
        """(offset, length, ts_us, incl_len, orig_len, packet) of the records that start from ``begin`` on and before ``end``; damage is (offset, length, 0, 0, 0, None)."""
        if self.empty:
            if not begin and self.bytes.size:
                yield 0, self.bytes.size, 0, 0, 0, None
            return
        end = self.bytes.size if end is None else end
        at = 24 if begin <= 24 + self.reach else self.find(begin - self.reach)
        while at < min(end, self.bytes.size):
            h = self.header(at)
            if h is None:
                to = self.find(at + 1)
                if at >= begin:
                    yield at, to - at, 0, 0, 0, None
                at = to
                continue
            sec, part, kept, full = h
            if at >= begin:
                yield at, 16 + kept, sec * 10**6 + part * 10**6 // self.ticks, kept, full, self.bytes.get(at + 16, kept)
            at += 16 + kept


def packets(f: BinaryIO, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(record, ts_us, incl_len, orig_len, packet) of a capture, or of a part of it; ``record`` is the offset of its header, which grows along the file."""
    yield from ((at, *r) for at, _, *r in Capture(f).records(begin, end) if r[-1] is not None)


def damage(f: BinaryIO, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(offset, length) of what is no record: damaged headers up to where records begin again, and a record that is cut at the end."""
    yield from ((at, size) for at, size, *r in Capture(f).records(begin, end) if r[-1] is None)


def flows(f: BinaryIO, begin: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Version 5 flow export datagrams, one after another: a 24-byte header, then 48 bytes for each record.  Always a whole file."""
    n = 0
    while len(h := f.read(24)) == 24:
        version, count, _, secs = struct.unpack(">HHII", h[:12])
        if version != 5:
            raise ValueError("not a version 5 flow export")
        for _ in range(count):
            if len(r := f.read(48)) < 48:
                return
            src, dst, _, _, _, pk, octets, first, last, sp, dp, _, flags, proto, _, sa, da, _, _, _ = struct.unpack(">IIIHHIIIIHHBBBBHHBBH", r)
            yield n, secs, first, last, src, dst, sp, dp, proto, pk, octets, flags, sa, da
            n += 1


KINDS = {"packets": (packets, PACKETS), "damage": (damage, "file string, offset long, length long"), "flows": (flows, FLOWS)}


def _batches(name: str, rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append((name, *r))
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])


def records(files: DataFrame, kind: str = "packets") -> DataFrame:
    """Rows of binaryFile's (path, content)."""
    parse, schema = KINDS[kind]
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                yield from _batches(path.as_py(), parse(io.BytesIO(content.as_buffer())), arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, kind: str = "packets", glob: str = "*") -> DataFrame:
    return records(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), kind)


def stream(spark: SparkSession, path: str, kind: str = "packets", glob: str = "*", files_a_trigger: int = 100) -> DataFrame:
    """Captures as they are dropped into a folder."""
    return records(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_trigger).load(path), kind)


@dataclass
class Part(InputPartition):
    """Bytes of a file; the records that start in them are a task's."""

    path: str
    begin: int
    end: int | None

    def __post_init__(self) -> None:
        super().__init__((self.path, self.begin, self.end))


class _Files(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        self.path, self.kind, self.split = path, kind, split

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        files = [i for i in found if i.is_file and not i.base_name.startswith(("_", "."))]
        if self.kind == "flows":
            return [Part(i.path, 0, None) for i in files]
        return [Part(i.path, a, min(a + self.split, i.size)) for i in files for a in range(0, max(i.size, 1), self.split)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        parse, schema = KINDS[self.kind]
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            yield from _batches(partition.path, parse(f, partition.begin, partition.end), _arrow(schema))


class CaptureSource(DataSource):
    """``spark.dataSource.register(CaptureSource)``, then ``spark.read.format("capture").option("kind", "packets").option("split", 1 << 27).load("file:///...")``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "packets")][1]

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], self.options.get("kind", "packets"), int(self.options.get("split", SPLIT)))


def _packed(us: int, p: bytes) -> bytes:
    return struct.pack("<IIII", us // 10**6, us % 10**6, len(p), len(p)) + p


HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)


def write(df: DataFrame, folder: str, ts_us: str = "ts_us", packet: str = "packet", roll: int = ROLL) -> int:
    """Write captures, for each partition one after another of about ``roll`` bytes, in order of time if the partition is; returns the number of packets.  Null packets are left out.

    ``df.orderBy(ts_us)`` gives files that follow each other in time when sorted by name.  A file gets its name when its task is known to have
    ended; what lost or repeated tasks leave ends in ``.part`` and is never read as a capture.  The folder must be one that all executors and Arrow's file systems reach."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(at)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        packets_ = ((us, p) for b in batches for us, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        names, counts, left = [], [], True
        while left:  # a partition without packets has a capture without any
            names.append(f"{part:08d}-{len(names):08d}-{own}")
            size = n = 0
            with store.open_output_stream(f"{at}/{names[-1]}.part") as f:
                f.write(HEADER)
                left = False
                for us, p in packets_:
                    record = _packed(us, p)
                    f.write(record)
                    size += len(record)
                    n += 1
                    if size >= roll:
                        left = True
                        break
            counts.append(n)
        yield pa.RecordBatch.from_pydict({"name": names, "n": counts})

    from pyarrow import fs

    done = df.where(f"{packet} IS NOT NULL").select(ts_us, packet).mapInArrow(run, "name string, n long").collect()  # one row for each file
    store, at = fs.FileSystem.from_uri(uri)
    for r in done:
        store.move(f"{at}/{r['name']}.part", f"{at}/{r['name']}.pcap")
    return sum(r["n"] for r in done)


def dump(rows: list[tuple[int, bytes]]) -> bytes:
    """A little-endian capture of (ts_us, packet), for exports of bounded size and tests."""
    return HEADER + b"".join(_packed(us, p) for us, p in rows)
