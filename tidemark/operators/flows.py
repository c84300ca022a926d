"""TCP conversations: sequence numbers to offsets, release of acknowledged bytes, and how each conversation ends.

One state machine serves batch and stream.  It holds only bytes that are not acknowledged yet.  In batch the packets of a partition are
sorted by conversation and time and pass by once, so a conversation of any length takes bounded memory.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.packets import FLAG_BITS

EVENTS = "conversation string, kind string, direction int, ts_us long, offset long, data binary, reason string"
IDLE_US = 10_000_000
#: The largest window that TCP's scaling allows: a sequence number this far below the last one has wrapped.
WRAP, LARGEST_WINDOW = 1 << 32, 65535 << 14


@dataclass
class Side:
    """One direction: its first sequence number, and segments that wait, sorted and without overlaps."""

    first: int | None = None
    high: int = 0
    start: int = 0
    finished: bool = False
    finish_acked: bool = False
    waiting: list[tuple[int, bytes]] = field(default_factory=list)

    def offset(self, seq: int) -> int:
        """Offset from the first byte; of the numbers that are equal modulo 2**32, the one nearest to the highest seen."""
        at = (seq - self.first) % WRAP
        at += (self.high - at + WRAP // 2) // WRAP * WRAP if self.high > at else 0
        return at - WRAP if at - self.high > LARGEST_WINDOW else at

    def add(self, at: int, data: bytes) -> None:
        """Newer bytes replace older ones; bytes that are already released are dropped."""
        data, at = data[max(self.start - at, 0) :], max(at, self.start)
        if not data:
            return
        end, kept = at + len(data), []
        for o, d in self.waiting:
            if o + len(d) <= at or o >= end:
                kept.append((o, d))
                continue
            if o < at:
                kept.append((o, d[: at - o]))
            if o + len(d) > end:
                kept.append((end, d[end - o :]))
        kept.insert(bisect_left(kept, (at,)), (at, data))
        self.waiting = sorted(kept)
        self.high = max(self.high, end)

    def release(self, limit: int) -> tuple[int, bytes]:
        """The contiguous segments that end at or before ``limit``."""
        begun, out = self.start, []
        while self.waiting and self.waiting[0][0] == self.start and self.start + len(self.waiting[0][1]) <= limit:
            out.append(self.waiting.pop(0)[1])
            self.start += len(out[-1])
        return begun, b"".join(out)


@dataclass
class Conversation:
    name: str
    last_us: int = 0
    begun: bool = False
    ended: bool = False
    sides: tuple[Side, Side] = field(default_factory=lambda: (Side(), Side()))

    def _end(self, us: int, reason: str) -> tuple:
        self.ended = True
        return (self.name, "end", None, us, None, None, reason)

    def expire(self) -> list[tuple]:
        return [self._end(self.last_us, "TIMEOUT")] if self.begun and not self.ended else []

    def packet(self, us: int, direction: int, seq: int, ack: int, flags: int, data: bytes) -> list[tuple]:
        """Events of one packet.  After the end nothing more comes until an idle gap begins a new conversation."""
        out = []
        if self.begun and us - self.last_us > IDLE_US:
            out += self.expire()
            self.begun, self.ended, self.sides = False, False, (Side(), Side())
        self.last_us = us
        if self.ended:
            return out
        if not self.begun:
            self.begun = True
            out.append((self.name, "start", direction, us, None, None, None))
        if flags & FLAG_BITS["RST"]:
            return [*out, self._end(us, "RST")]
        own, other = self.sides[direction], self.sides[1 - direction]
        syn = bool(flags & FLAG_BITS["SYN"])
        if own.first is None:
            own.first = (seq + syn) % WRAP
        if flags & FLAG_BITS["ACK"] and other.first is not None:
            limit = other.offset(ack)
            at, ready = other.release(limit)
            if ready:
                out.append((self.name, "data", 1 - direction, us, at, ready, None))
            if own.first is not None and limit > 1 and limit > other.start + other.finished:
                return [*out, self._end(us, "MISSING_PACKET")]
            other.finish_acked |= other.finished and limit > other.start
            if own.finish_acked and other.finish_acked:
                return [*out, self._end(us, "FIN")]
        own.finished |= bool(flags & FLAG_BITS["FIN"])
        if data and not syn:
            own.add(own.offset(seq), data)
        return out


def keyed(packets: DataFrame, ts_us: str = "ts_us", order: str = "record", signature: str = "sig") -> DataFrame:
    """(conversation, direction, ts_us, order, seq, ack, flags, data) of the TCP packets: both directions share one key."""
    s = lambda n: F.col(f"{signature}.{n}")
    end = lambda a, p: F.concat(F.hex(s(a)), F.lit(":"), F.lpad(s(p).cast("string"), 5, "0"))
    a, b = end("src", "sport"), end("dst", "dport")
    tcp = packets.where((s("l4_type") == 6) & s("src").isNotNull())
    return tcp.select(F.concat_ws("-", F.least(a, b), F.greatest(a, b)).alias("conversation"), (a < b).cast("int").alias("direction"), F.col(ts_us).alias("ts_us"), F.col(order).alias("order"), s("seq").alias("seq"), s("ack").alias("ack"), s("flags").alias("flags"), F.coalesce(s("rest"), F.lit(b"")).alias("data"))


def conversations(packets: DataFrame) -> DataFrame:
    """Events of ``keyed`` rows: start, data (released bytes with their offset) and end with FIN, RST, TIMEOUT or MISSING_PACKET."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        columns = [c.split()[0] for c in EVENTS.split(", ")]
        for b in batches:
            out = []
            for name, direction, us, seq, ack, flags, data in zip(*(b[c] for c in ("conversation", "direction", "ts_us", "seq", "ack", "flags", "data")), strict=True):
                if now is None or now.name != name:
                    out += now.expire() if now else []
                    now = Conversation(name)
                out += now.packet(int(us), int(direction), int(seq), int(ack), int(flags), bytes(data))
            yield pd.DataFrame(out, columns=columns).astype({"direction": "Int32", "offset": "Int64"})
        if now:
            yield pd.DataFrame(now.expire(), columns=columns).astype({"direction": "Int32", "offset": "Int64"})

    near = packets.repartition("conversation").sortWithinPartitions("conversation", "ts_us", "order")
    return near.select("conversation", "direction", "ts_us", "seq", "ack", "flags", "data").mapInPandas(run, EVENTS)


# Record codes of a flow's start by address family, of data and of ends.
START, DATA, ENDS = {8: 4, 32: 6}, 1, {"FIN": 256, "RST": 257, "TIMEOUT": 258, "MISSING_PACKET": 259}


def records(events: DataFrame) -> DataFrame:
    """Events as typed records: (code, conversation, low and high address and port, direction, length, secs, micros, data)."""
    end = lambda i: F.split("conversation", "-")[i]
    part = lambda i, j: F.split(end(i), ":")[j]
    family = F.length(part(0, 0))
    code = F.when(F.col("kind") == "data", DATA)
    for width, c in START.items():
        code = code.when((F.col("kind") == "start") & (family == width), c)
    for reason, c in ENDS.items():
        code = code.when((F.col("kind") == "end") & (F.col("reason") == reason), c)
    us = F.col("ts_us")
    return events.select(code.alias("code"), "conversation", part(0, 0).alias("low_addr"), part(0, 1).cast("int").alias("low_port"), part(1, 0).alias("high_addr"), part(1, 1).cast("int").alias("high_port"), "direction", F.octet_length("data").cast("long").alias("length"), F.expr("ts_us div 1000000").alias("secs"), F.pmod(us, F.lit(1_000_000)).alias("micros"), "data")


def write(events: DataFrame, folder: str, append: bool = True) -> None:
    """A sink of records, a folder for each code: a reader of ends opens no data."""
    records(events).write.partitionBy("code").mode("append" if append else "overwrite").parquet(folder)
