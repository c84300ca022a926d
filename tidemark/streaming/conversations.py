"""TCP conversations on streams: the batch state machine with its state in Spark's store.

A conversation's counters are one value; the bytes that wait for an acknowledgement are entries of a map, and a micro-batch writes those alone that came or went.  A timer ends it once it
idles past the timeout by event time.  Packets of a micro-batch are taken chunk by chunk; a chunk waits for the next one only if that begins before it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.flows import EVENTS, IDLE_US, Conversation, Side

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIDE = ("first", "high", "start", "finished", "finish_acked")
COUNTERS = "last_us long, begun boolean, ended boolean, timer long, " + ", ".join(f"{n}{i} {'long' if n in SIDE[:3] else 'boolean'}" for i in (0, 1) for n in SIDE)


def in_order(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks sorted by (ts_us, order), each from where the one before it ends; chunks that overlap become one."""
    key = ["ts_us", "order"]
    held: pd.DataFrame | None = None
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = chunk.sort_values(key, kind="stable")
        if held is not None and tuple(chunk[key].iloc[0]) >= tuple(held[key].iloc[-1]):
            yield held
            held = None
        held = chunk if held is None else pd.concat([held, chunk]).sort_values(key, kind="stable")
    if held is not None:
        yield held


class Conversations(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", COUNTERS)
        self.waiting = handle.getMapState("waiting", "side int, offset long", "data binary")

    def _load(self, name: str) -> tuple[Conversation, int | None, dict[tuple[int, int], bytes]]:
        talk = Conversation(name)
        if not self.counters.exists():
            return talk, None, {}
        c = self.counters.get()
        talk.last_us, talk.begun, talk.ended, timer = c[:4]
        held = {(k[0], k[1]): bytes(v[0]) for k, v in self.waiting.iterator()}
        for i in (0, 1):
            rest = sorted((o, d) for (side, o), d in held.items() if side == i)
            talk.sides[i].__dict__.update(zip(SIDE, c[4 + 5 * i : 9 + 5 * i], strict=True), waiting=rest)
        return talk, timer, held

    def _store(self, talk: Conversation, timer: int, held: dict[tuple[int, int], bytes]) -> None:
        now = {(i, o): d for i, side in enumerate(talk.sides) for o, d in side.waiting}
        for k in held.keys() - now.keys():
            self.waiting.removeKey(k)
        for k, d in now.items():
            if held.get(k) != d:
                self.waiting.updateValue(k, (d,))
        self.counters.update((talk.last_us, talk.begun, talk.ended, timer, *(getattr(s, n) for s in talk.sides for n in SIDE)))

    @staticmethod
    def _events(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"direction": "Int32", "offset": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        talk, timer, held = self._load(key[0])
        for chunk in in_order(rows):
            out = []
            for us, direction, seq, ack, flags, data in zip(*(chunk[c] for c in ("ts_us", "direction", "seq", "ack", "flags", "data")), strict=True):
                out += talk.packet(int(us), int(direction), int(seq), int(ack), int(flags), bytes(data))
            yield self._events(out)
        if timer is not None:
            self.handle.deleteTimer(timer)
        due = max((talk.last_us + IDLE_US) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self._store(talk, due, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        talk, _, _ = self._load(key[0])
        self.counters.clear()
        self.waiting.clear()
        yield self._events(talk.expire())

    def close(self) -> None:
        pass


def conversations(packets: DataFrame, ts: str, late: str = "10 seconds") -> DataFrame:
    """Events of ``flows.keyed`` rows with an event time ``ts``: those of the batch form, as their packets arrive.

    A conversation that idles past the timeout by event time ends with TIMEOUT and its state goes.  The state needs the store that ``PROVIDER`` names, which is set for the session where none is."""
    conf = packets.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(name, ""):
        conf.set(name, PROVIDER)
    return packets.withWatermark(ts, late).groupBy("conversation").transformWithStateInPandas(Conversations(), StructType.fromDDL(EVENTS), "append", "EventTime")
