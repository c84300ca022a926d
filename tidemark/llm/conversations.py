"""Damaged conversations, repaired at the least cost.

A conversation is an input acceptor over its rows in order (by turn, nulls first, then role, the text's first ``PREFIX`` characters and a hash of role and text).  An edit transducer keeps (0), gives another
role to (2), deletes (3) or inserts (2) rows; an undeleted truncated row costs 1 more; blank rows and repeats can only be deleted.  A role grammar accepts what ``(s?(ua)+)?`` says of role initials.
Their composition is built lazily, state by state in topological order: more than two insertions in a row only lead back to a state that is reached
cheaper, so the transducer counts them and the composition has no cycle.  The shortest path is over weights (cost, edit initials), the lexicographically least.

Rows without texts, sorted into range partitions, become segments: a conversation's rows in one Arrow batch.  A segment's weights from each grammar state to each other are computed where it lies,
so a conversation of any length is dealt to many tasks; products of these small matrices give its path.  Repeats are found by a join on hashes that Spark can split.  The texts are shuffled once,
to meet the edits of their conversation in order; they pass by as a stream.  A conversation's edits are one value of a letter a row; sixteen such are held at most.

Defined cases: a null conversation id is one conversation; null roles, texts, and ids and turns in the damage's key are one space; rows of equal turn, role and text are repeats of the first; a conversation without rows needs
no edits; a role that begins with none of s, u, a (or is empty) fits nowhere and is changed or deleted; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import stored, trim
from tidemark.llm._text import offsets

PREFIX = 40
#: White space of a blank row: 0x20 and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The role grammar: state 0 is the start, 1 follows s, 2 follows u, 3 follows a.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
Weight = tuple[int, str]


def arcs(inserted: int, row: str) -> Iterator[tuple[int, str, str, bool, int]]:
    """The edit transducer's arcs before a row (empty: after the last): cost, label, role initial put out (empty: none), whether the row is consumed, next state.

    A row is b or d (blank, repeat), else the initial of its role (o: any other), upper case if it is truncated."""
    if inserted < 2:
        yield from ((INSERT, "I", r, False, inserted + 1) for r in NAMES)
    if not row:
        return
    yield DELETE, "D", "", True, 0
    if row not in "bd":
        more = TRUNCATED * row.isupper()
        yield KEEP + more, "K", row.lower(), True, 0
        yield from ((REROLE + more, "R", r, True, 0) for r in NAMES)


def from_state(rows: str, start: int) -> dict[int, Weight]:
    """The least weight from a grammar state to each that some edits of ``rows`` reach."""
    layer: dict[tuple[int, int], Weight] = {(0, start): (0, "")}
    for row in [*rows, ""]:
        after: dict[tuple[int, int], Weight] = {}
        for inserted in range(3):
            for (_, g), (cost, label) in [x for x in layer.items() if x[0][0] == inserted]:
                for c, edit, role, consumed, then in arcs(inserted, row):
                    to = GRAMMAR[g].get(role) if role else g
                    if to is not None:
                        into = after if consumed else layer
                        w = (cost + c, label + edit)
                        if (then, to) not in into or w < into[then, to]:
                            into[then, to] = w
        if row:
            layer = after
    best: dict[int, Weight] = {}
    for (_, g), w in layer.items():
        best[g] = min(w, best.get(g, w))
    return best


_remembered = lru_cache(1 << 14)(from_state)


def weights(rows: str, start: int) -> dict[int, Weight]:
    """``from_state``, piece by piece: labels stay short while they grow, and short pieces are remembered."""
    if len(rows) <= 64:
        return _remembered(rows, start)
    return product({start: weights(rows[:64], start)}, _lazy(rows[64:])).get(start, {})


def _lazy(rows: str) -> dict[int, dict[int, Weight]]:
    """The matrix of a segment, halved until pieces are short."""
    if len(rows) <= 64:
        return {g: _remembered(rows, g) for g in range(4)}
    at = len(rows) // 2
    return product(_lazy(rows[:at]), _lazy(rows[at:]))


def product(a: dict[int, dict[int, Weight]], b: dict[int, dict[int, Weight]]) -> dict[int, dict[int, Weight]]:
    """What paths through ``a`` and then ``b`` weigh; labels are joined only where costs are equal."""
    out: dict[int, dict[int, Weight]] = {}
    for i, row in a.items():
        out[i] = {}
        for j in range(4):
            via = [(w[0] + b[m][j][0], m) for m, w in row.items() if j in b.get(m, {})]
            if via:
                least = min(via)[0]
                out[i][j] = least, min(row[m][1] + b[m][j][1] for c, m in via if c == least)
    return out


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(``conv:turn``) % 20 names: 0 drops a row, 1 empties it, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), k.alias("_k")).where("_k != 0")
    t, r = F.col("text"), F.col("role")
    rows = rows.withColumns({"text": F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(t, "[.!?]", "")).otherwise(t), "role": F.when(F.col("_k") == 4, "user").otherwise(r)})
    return rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _keys() -> dict[str, Column]:
    """What orders rows of one turn; equal rows have equal keys."""
    return {"_p": F.substring("text", 1, PREFIX), "_h": F.xxhash64("role", "text"), "_h2": F.xxhash64(F.lit(1), "role", "text")}


ORDER = ["turn", "role", "_p", "_h", "_h2"]


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows without texts: conv_id, turn, the keys, and in a letter each the role's initial (``_i``) and what the edits may do with it (``_row``)."""
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    whole = F.substring(rest, -1, 1).isin(".", "!", "?")
    narrow = rows.withColumns(_keys()).select("conv_id", "turn", "role", "_p", "_h", "_h2", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("_i"), (rest == "").alias("_blank"), whole.alias("_whole"))
    narrow = stored(narrow.withColumn("_id", F.monotonically_increasing_id()), "narrow")
    at = F.struct(F.col("turn").isNotNull(), "turn", "_id")
    first = narrow.groupBy(F.col("conv_id").alias("_c"), F.col("_h").alias("_g"), F.col("_h2").alias("_g2")).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    marked = narrow.join(first, (F.col("_h") == F.col("_g")) & (F.col("_h2") == F.col("_g2")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    again = F.coalesce(F.col("_first")["_id"] != F.col("_id"), F.lit(False))
    letter = F.when(F.col("_blank"), "b").when(again, "d").when(F.col("_whole"), F.col("_i")).otherwise(F.upper("_i"))
    return marked.select("conv_id", "turn", "role", "_p", "_h", "_h2", again.alias("_again"), "_i", letter.alias("_row"))


SEGMENT = "conv_id {}, part int, seq int, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long, start int, costs array<long>, labels array<string>"
_LEGAL = np.zeros((256, 256), bool)
for _x, _y in ("su", "ua", "au"):
    _LEGAL[ord(_x), ord(_y)] = True


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments, one row for each and each grammar state that it may begin in (only one that may have begun in another batch begins elsewhere than at the start)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for seq, b in enumerate(b for b in batches if b.num_rows):
        n = b.num_rows
        conv = b.column(0).dictionary_encode(null_encoding="encode")
        ids = conv.indices.to_numpy()
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        at = [*np.flatnonzero(new), n]
        none = b.column(1).is_null().to_numpy(zero_copy_only=False)
        turns = b.column(1).fill_null(0).to_numpy()
        initials, rows = (offsets(b.column(i))[0] for i in (2, 3))
        wrong = np.concatenate([[0], ~_LEGAL[initials[:-1], initials[1:]]]) * ~new
        told = ~none & (new | np.concatenate([[True], none[:-1] | (turns[1:] != turns[:-1])]))
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (rows == ord("b"), rows == ord("d"), (rows >= 65) & (rows <= 90), wrong, told)]
        letters = rows.tobytes().decode()
        out: list[tuple] = []
        for x, y in zip(at[:-1], at[1:], strict=True):
            known = np.flatnonzero(~none[x:y])
            lo, hi = (int(turns[x + known[i]]) if len(known) else None for i in (0, -1))
            common = (part, seq, *(int(s[y] - s[x]) for s in sums), chr(initials[x]), chr(initials[y - 1]), lo, hi)
            for g in range(4 if x == 0 else 1):
                w = weights(letters[x:y], g)
                out.append((int(ids[x]), *common, g, [w[j][0] if j in w else None for j in range(4)], [w[j][1] if j in w else None for j in range(4)]))
        cols = list(zip(*out, strict=True))
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())]
        names = ["conv_id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high", "start", "costs", "labels"]
        yield pa.RecordBatch.from_arrays([conv.dictionary.take(pa.array(cols[0])), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], names=names)
    trim()


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """(key, its rows) of sorted rows, as a stream; a key's rows must be taken before the next key."""
    from itertools import groupby

    return groupby((r for b in batches for r in b.to_pylist()), lambda r: r[key])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation in order to its counts and its cheapest edits.  Matrices are multiplied like the digits of a binary counter, so labels are copied seldom."""
    out: list[tuple] = []
    ids: list = []

    def batch() -> pa.RecordBatch:
        cols = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:6]]
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        done = pa.RecordBatch.from_arrays([pa.array(ids, kind), *cols, pa.array([r[6] for r in out], pa.string())], names=["conv_id", *names])
        out.clear(), ids.clear()
        return done

    kind = None
    for conv, rows in _by_key((b for b in batches if (kind := b.schema.field(0).type) is not None), "conv_id"):
        total, stack = [0] * 5, []
        low = high = last = None
        held: list[dict] = []

        def add(matrix: dict[int, dict[int, Weight]], stack: list = stack) -> None:
            size = 1
            while stack and stack[-1][0] == size:
                matrix, size = product(stack.pop()[1], matrix), 2 * size
            stack.append((size, matrix))

        def matrix(held: list[dict]) -> dict[int, dict[int, Weight]]:
            return {r["start"]: {j: (c, s) for j, (c, s) in enumerate(zip(r["costs"], r["labels"], strict=True)) if c is not None} for r in held}

        for r in rows:
            if r["part"] < 0:  # says that there is such a conversation
                continue
            if held and (held[0]["part"], held[0]["seq"]) != (r["part"], r["seq"]):
                add(matrix(held))
                held = []
            if not held:
                total = [a + r[c] for a, c in zip(total, ("blank", "duplicate", "truncated", "illegal", "turns"), strict=True)]
                total[3] += last is not None and not _LEGAL[ord(last), ord(r["first"])]
                if r["low"] is not None:
                    total[4] -= high == r["low"]
                    low, high = r["low"] if low is None else low, r["high"]
                last = r["last"]
            held.append(r)
        if held:
            add(matrix(held))
        all_ = stack.pop()[1] if stack else {0: {0: (0, "")}}
        while stack:
            all_ = product(stack.pop()[1], all_)
        cost, audit = min(all_[0][g] for g in FINAL if g in all_[0])
        ids.append(conv)
        out.append((high - low + 1 - total[4] if low is not None else 0, *total[:4], cost, audit))
        if len(out) >= 1000:
            yield batch()
    if out:
        yield batch()
    trim()


def edits(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations (conv_id, turn, role, text): what is wrong, and the cheapest edits.

    ``every``: conversation ids that get a row even if they have no rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", *ORDER, "_again"]
    schema = SEGMENT.format(kind)
    segments = _symbols(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "_i", "_row").mapInArrow(_segments, schema)
    if every is not None:
        ids = every.select(F.col("conv_id").cast(kind)).distinct().withColumn("part", F.lit(-1))
        segments = segments.unionByName(ids, allowMissingColumns=True)
    found = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "start")
    return found.mapInArrow(_joined, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited(rows: DataFrame, edits: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` over conversations as streams: their edits, then their rows in order."""
    told = edits.select("conv_id", "audit")
    both = rows.withColumns(_keys()).unionByName(told, allowMissingColumns=True)
    sorted_ = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc(F.col("audit").isNotNull()), *ORDER)
    return sorted_.select("conv_id", "audit", "turn", "role", "text").mapInArrow(fn, schema)


def repaired_rows(rows: Iterator[dict]) -> Iterator[tuple[str, str, str, int | None]]:
    """(edit, role, text, turn) of what is left of a conversation: its edits come first, then its rows."""
    audit, k, g = next(rows)["audit"], 0, 0

    def made() -> str:
        nonlocal g
        r = next(r for r in GRAMMAR[g] if r in NAMES)
        g = GRAMMAR[g][r]
        return NAMES[r]

    for row in rows:
        while audit[k] == "I":
            k += 1
            yield "I", made(), "", None
        if audit[k] == "K":
            g = GRAMMAR[g][row["role"][0]]
            yield "K", row["role"], row["text"], row["turn"]
        elif audit[k] == "R":
            yield "R", made(), row["text"], row["turn"]
        k += 1
    for _ in audit[k:]:
        yield "I", made(), "", None


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired conversations, rows numbered from 0."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # one look at the type
            break
        else:
            return
        from itertools import chain

        out: list[tuple] = []
        ids: list = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["conv_id", "place", "edit", "turn", "role", "text"])
            out.clear(), ids.clear()
            return done

        size = 0
        for conv, part in _by_key(chain([b], batches), "conv_id"):
            for place, (edit, role, text, turn) in enumerate(repaired_rows(part)):
                ids.append(conv)
                out.append((place, edit, turn, role, text))
                size += len(text) + 64
                if size > 1 << 22:
                    yield batch()
                    size = 0
        if out:
            yield batch()
        trim()

    return _edited(rows, edits, run, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of ``role:text`` of the repaired rows, joined by newlines."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = None
        ids, out = [], []
        for conv, part in _by_key((b for b in batches if (type_ := b.schema.field(0).type) is not None), "conv_id"):
            h = hashlib.sha256()
            for place, (_, role, text, _) in enumerate(repaired_rows(part)):
                h.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
            ids.append(conv)
            out.append(h.hexdigest())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(out)], names=["conv_id", "repaired_sha256"])
                ids, out = [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(out)], names=["conv_id", "repaired_sha256"])
        trim()

    return _edited(rows, edits, run, f"conv_id {kind}, repaired_sha256 string")


def repair(df: DataFrame) -> DataFrame:
    """The damaged conversations of ``df``, their faults, edits and the digest of what the edits make of them: one row for each conversation of ``df``."""
    rows = damage(df)
    found = stored(edits(rows, df), "edits")
    return found.join(digests(rows, found).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
