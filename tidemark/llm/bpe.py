"""BPE encoding with content-defined chunks, and decoding.

A rolling hash over 16 bytes cuts each text where its content says so, so passages that
documents share fall into equal chunks.  A chunk is encoded once and kept in a bounded cache for the task's other documents.

Joins are then repaired.  A cut may fall anywhere, also inside a word, so the text around it is encoded anew, from a white space
before it to one after it.  The result replaces the tokens of both sides if it agrees with them exactly at its ends: its first tokens, over
a whole word at least, are those that the left chunk has there, its last tokens those of the right chunk.  If it doesn't,
more words are taken; where that fails too, or where the repairs of two cuts would meet, the chunks are joined into one and encoded as such,
until every cut agrees.  A text without white space ends as one chunk.

Most of the library's time goes into normalising and splitting, not into merges.  For tokenizers that do both as ``NORMALIZER`` and ``SPLIT``
say, a plain chunk (characters below U+0300 that no composition, control or change of length touches, and no added token) is lower-cased
and split by Python, and its words' ids are put together; the library encodes each word once and a bounded dictionary keeps it for the
task.  Other chunks, and all chunks of other tokenizers, are encoded by the library as they are.

Limits of caches and of tokens looked at near a cut change time alone.  Chunks are shared inside a task: to share them between tasks
would shuffle all texts and ids.

Defined cases: null or empty text has no ids and decodes to the empty string; null ids of documents and repeated
rows are kept as they are; an empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import trim
from tidemark.llm._text import mix, offsets, pieces, powers

#: Cuts are 1024 bytes apart on average; those less than ``LEAST`` bytes after another, or from an end, don't count.
CHUNK_BITS, LEAST = 10, 256
MAX_CHUNKS = 8_000
#: Bytes of text encoded at a time, tokens looked at on each side of a cut, and how many words a repair takes on each side.
PART, NEAR, WORDS = 1 << 20, 24, (1, 4)
#: Words remembered in a task, and the longest of them in characters.
MAX_WORDS, LONGEST_WORD = 250_000, 64
U = np.uint64

#: What a tokenizer must do with texts before its merges, so that plain texts are split here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Below U+0300 nothing composes.  U+001C to U+001F are spaces to Python alone, and U+0130 becomes two characters in lower case.
NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u02ff]")


def _split() -> re.Pattern:
    """``SPLIT`` over plain texts in lower case."""
    lower = {chr(c).lower() for c in range(0x300) if not NOT_PLAIN.match(chr(c))}
    letter, number = ("".join(sorted(x for x in lower if unicodedata.category(x)[0] == k)) for k in "LN")
    return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^\\t-\\r \x85\xa0{letter}{number}]+")


@dataclass
class Chunk:
    """A text, its ids, and where its first and last ``NEAR`` tokens start and end, in characters."""

    text: str
    ids: array
    head: tuple[array, array]
    tail: tuple[array, array]

    def before(self, at: int) -> int | None:
        """How many tokens end by ``at``, if no token crosses it; None also if it is too far from the end."""
        starts, ends = self.tail
        k = len(starts)
        while k and starts[k - 1] >= at:
            k -= 1
        if k and ends[k - 1] > at or not k and len(starts) < len(self.ids):
            return None
        return len(self.ids) - len(starts) + k

    def after(self, at: int) -> int | None:
        """The first token that starts at ``at`` or later, if no token crosses it; None also if it is too far from the start."""
        starts, ends = self.head
        k = 0
        while k < len(ends) and ends[k] <= at:
            k += 1
        if k < len(ends) and starts[k] < at or k == len(ends) < len(self.ids):
            return None
        return k


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.split: re.Pattern | None = None
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.added = [x["content"].lower() for x in conf["added_tokens"]]
        if conf["normalizer"] == NORMALIZER and conf["pre_tokenizer"] == SPLIT and not conf["post_processor"] and not conf["model"].get("dropout") and not any(x["normalized"] for x in conf["added_tokens"]):
            self.split = _split()
            self.single = Tokenizer.from_file(path)  # for words in lower case with a space between
            self.single.no_truncation()
            self.single.no_padding()
            self.single.normalizer = None
            self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.long: list[str] = []
        self.chunks: dict[str, Chunk] = {}
        self.names: list[str] | None = None
        self.encoded = self.repaired = self.joined = 0

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where the content cuts: between characters, after 16 bytes whose hash ends in ``CHUNK_BITS`` zeros."""
        n = len(data)
        up, down = powers(1, n)
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
        m = max(n - 16, 0)
        at = np.flatnonzero(mix((total[16:n] - total[:m]) * down[:m]) >> U(64 - CHUNK_BITS) == 0) + 16
        return at[data[at] & 0xC0 != 0x80]

    @staticmethod
    def _bounds(offs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where chunks start, and the end: every text's start, and the cuts that count, each text on its own."""
        out, d, edges = [], 0, np.unique(offs).tolist()
        last = edges[0]
        for c in cuts.tolist():
            while c >= edges[d + 1]:
                d += 1
                last = edges[d]
            if c - last >= LEAST and edges[d + 1] - c >= LEAST:
                out.append(c)
                last = c
        return np.unique(np.r_[offs, np.array(out, np.int64)])

    def _apart(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Plain texts, and those that the library has to normalise and split."""
        good = [self.split is not None and not NOT_PLAIN.search(x) and not any(a in x.lower() for a in self.added) for x in texts]
        return [x for x, g in zip(texts, good, strict=True) if g], [x for x, g in zip(texts, good, strict=True) if not g]

    def _put(self, texts: list[str]) -> list[array]:
        """Ids of plain texts from those of their words.  Long words are forgotten by the next call."""
        for w in self.long:
            del self.words[w]
        if len(self.words) > MAX_WORDS:
            self.words = {}
        parts = [self.split.findall(x.lower()) for x in texts]
        fresh = list(set(chain.from_iterable(parts)).difference(self.words))
        for i in range(0, len(fresh), 512):
            part = fresh[i : i + 512]
            e = self.single.encode(" ".join(part), add_special_tokens=False)
            ids, at = array("I", e.ids).tobytes(), (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            self.words |= {w: ids[a:b] for w, a, b in zip(part, at[:-1], at[1:], strict=True)}
        self.long = [w for w in fresh if len(w) > LONGEST_WORD]
        return [array("I", b"".join(map(self.words.__getitem__, p))) for p in parts]

    def _near(self, low: str) -> tuple[tuple[array, array], tuple[array, array]]:
        """Where the tokens of a plain text's first and last words start and end, after ``_put``; each has its whole word's place."""
        n = max(WORDS) + 2
        first, last = low.split(None, n), low.rsplit(None, n)
        to, from_ = len(low) - len(first[-1]) if len(first) > n else len(low), len(last[0]) if len(last) > n else 0
        out = []
        for a, b in ((0, to), (from_, len(low))):
            starts, ends = [], []
            for w in self.split.finditer(low, a, b):
                k = len(self.words[w[0]]) // 4
                starts += [w.start()] * k
                ends += [w.end()] * k
            out.append((array("I", starts), array("I", ends)))
        return out[0], out[1]

    def learn(self, texts: list[str]) -> dict[str, Chunk]:
        """Chunks of texts: those that are known, and the others encoded."""
        out = {x: self.chunks[x] for x in texts if x in self.chunks}
        fresh = list({x for x in texts if x not in out})
        if len(self.chunks) > MAX_CHUNKS:
            self.chunks = {}
        plain, rest = self._apart(fresh)
        for x, ids in zip(plain, self._put(plain), strict=True):
            out[x] = Chunk(x, ids, *self._near(x.lower()))
        for i in range(0, len(rest), 256):
            part = rest[i : i + 256]
            for x, e in zip(part, self.t.encode_batch(part, add_special_tokens=False), strict=True):
                n = len(e)
                ends = [[e.token_to_chars(k) for k in r] for r in (range(min(n, NEAR)), range(max(n - NEAR, 0), n))]
                out[x] = Chunk(x, array("I", e.ids), *((array("I", [a for a, _ in r]), array("I", [b for _, b in r])) for r in ends))
        self.encoded += len(fresh)
        self.chunks |= {x: out[x] for x in fresh if len(x) <= 16 << CHUNK_BITS}
        return out

    def _regions(self, cuts: list[tuple[Chunk, Chunk, bool, bool]], words: int) -> list[tuple[int, int, array] | None]:
        """For each cut between two chunks: tokens kept of the left one, the first kept of the right one, and the ids between; or None."""
        ends = []
        for left, right, first, last in cuts:
            parts = left.text.rsplit(None, words + 1)
            a = len(parts[0]) if len(parts) == words + 2 else 0
            parts = right.text.split(None, words + 1)
            b = len(right.text[: len(right.text) - len(parts[-1])].rstrip()) if len(parts) == words + 2 else len(right.text)
            kept, next_ = left.before(a), right.after(b)
            good = kept is not None and next_ is not None and (a > 0 or first) and (b < len(right.text) or last)
            ends.append((a, b, kept, next_) if good else None)
        asked = [left.text[e[0] :] + right.text[: e[1]] for (left, right, _, _), e in zip(cuts, ends, strict=True) if e]
        plain, rest = self._apart(asked)
        got = dict(zip(plain, self._put(plain), strict=True)) | {x: array("I", e.ids) for x, e in zip(rest, self.t.encode_batch(rest, add_special_tokens=False), strict=True)}
        out: list[tuple[int, int, array] | None] = []
        for (left, right, _, _), e in zip(cuts, ends, strict=True):
            if e is None:
                out.append(None)
                continue
            a, b, kept, next_ = e
            ids, cut = got[left.text[a:] + right.text[:b]], len(left.text) - a
            n = len(ids)
            # The tokens of whole words on either side of the cut must come out as they are in the chunks.
            word = len(left.text[a:].split(None, 1)[0]) + len(left.text[a:]) - len(left.text[a:].lstrip()) if a else 0
            m = sum(s < a + word for s in left.tail[0][kept - (len(left.ids) - len(left.tail[0])) :]) if a else 0
            good = word < cut and ids[:m] == left.ids[kept : kept + m] and (m > 0 or not a)
            if good and b < len(right.text):
                tail = right.text[:b].rsplit(None, 1)
                from_ = b - len(tail[-1])
                m = sum(t > from_ for t in right.head[1][:next_])
                good = len(tail) == 2 and m > 0 and ids[n - m :] == right.ids[next_ - m : next_]
            out.append((kept, next_, ids) if good else None)
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        data, offs = offsets(column)
        raw = data.tobytes()
        bounds = self._bounds(offs, self.cuts(data))
        first = np.searchsorted(bounds, offs).tolist()
        at = bounds.tolist()
        texts = [[raw[at[k] : at[k + 1]].decode() for k in range(first[d], first[d + 1])] for d in range(len(offs) - 1)]
        done: list[bytes | None] = [b"" if not t else None for t in texts]
        open_ = [d for d, x in enumerate(done) if x is None]
        while open_:
            known = self.learn([x for d in open_ for x in texts[d]])
            units = {d: [known[x] for x in texts[d]] for d in open_}
            where = [(d, k) for d in open_ for k in range(len(units[d]) - 1)]
            found: dict[tuple[int, int], tuple[int, int, array]] = {}
            for words in WORDS:
                left = [x for x in where if x not in found]
                # At a text's ends a repair may take all there is.
                made = self._regions([(units[d][k], units[d][k + 1], k == 0, k + 2 == len(units[d])) for d, k in left], words)
                found |= {x: r for x, r in zip(left, made, strict=True) if r}
            self.repaired += len(found)
            for d in open_:
                n = len(units[d])
                whole = [(d, k) in found for k in range(n - 1)]
                for k in range(1, n - 1):  # the repairs on both sides of a chunk must not meet
                    if whole[k - 1] and whole[k] and found[d, k - 1][1] > found[d, k][0]:
                        whole[k] = False
                if all(whole):
                    ids = array("I")
                    for k, u in enumerate(units[d]):
                        lo = found[d, k - 1][1] if k else 0
                        ids += u.ids[lo : found[d, k][0] if k < n - 1 else len(u.ids)]
                        if k < n - 1:
                            ids += found[d, k][2]
                    done[d] = np.frombuffer(ids, np.uintc).astype("<u4").tobytes()
                else:
                    self.joined += whole.count(False)
                    starts = [0, *(k + 1 for k in range(n - 1) if whole[k]), n]
                    texts[d] = ["".join(texts[d][i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            open_ = [d for d in open_ if done[d] is None]
        return done

    def forget(self) -> None:
        """At a task's end: workers outlive it, and other operators' tasks need the memory."""
        self.chunks, self.words, self.long = {}, {}, []
        trim()

    def decode(self, ids: bytes) -> str:
        if self.t.decoder is not None:
            return self.t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        if self.names is None:
            self.names = [self.t.id_to_token(i) or "" for i in range(self.t.get_vocab_size(with_added_tokens=True))]
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, with its caches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with(df: DataFrame, fields: list[T.StructField], rows) -> DataFrame:
    names = [f.name for f in fields]
    rest = df.select(*[c for c in df.columns if c not in names])
    return rest.mapInArrow(rows, T.StructType([*rest.schema.fields, *fields]))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """All columns, ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit); these replace columns of their names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            for b in pieces(batch, text_col, PART):
                ids = e.encode(b.column(b.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*b.schema.names, "n_tokens", "ids"])
        e.forget()

    return _with(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], rows)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            for b in pieces(batch, ids_col, 1 << 20):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e.decode(x.as_py() or b"") for x in b.column(b.schema.get_field_index(ids_col))], pa.string())], names=[*b.schema.names, "decoded"])
        e.forget()

    return _with(encoded, [T.StructField("decoded", T.StringType())], rows)


def encode_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    both = decode(encode(docs.select(F.col(id_col), F.col(text_col)), tokenizer, text_col).drop(text_col), tokenizer)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
