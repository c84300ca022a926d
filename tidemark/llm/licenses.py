"""Licence statements in texts: phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser.

Words are runs of digits, letters (A-Z lower-cased) and bytes from 0x80 on.  The words of a piece of documents, with one space between them, go once through an automaton of
phrases, notices and tags.  A tag ("SPDX-License-Identifier", "licensed under", ...) is followed by an expression of licence names with and, or, with and brackets, to the end of its line or sentence.
With binds most, then and, then or; ``/`` says or.  An expression's restriction is the highest of what ``and`` joins and the lowest of what ``or`` leaves to choose; a known exception after ``with`` lowers it.

A document's score is its restriction: the highest of its expressions and of notices outside of them, 0 without any, 1 for reserved rights.

Defined cases: a null text is empty, has no words and no statement; a phrase is found across any characters that belong to no word, never across documents; names that stand after no tag
are no statement; an expression without a known name says nothing, operators that miss an operand are left out, and unmatched brackets are closed or ignored; repeated rows are judged
one by one; only the two named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import trim
from tidemark.llm._text import _FOLD, Words, pieces

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

# Licences with their restriction, names and notices, as words.
RESTRICTION = {
    "public-domain": 0.05, "cc0": 0.05, "unlicense": 0.05, "mit": 0.2, "isc": 0.2, "zlib": 0.2, "bsl": 0.2, "bsd": 0.2, "apache": 0.25, "cc-by": 0.3, "cc-by-sa": 0.6, "mpl": 0.5, "epl": 0.5,
    "lgpl": 0.55, "gfdl": 0.65, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.85, "cc-by-nc": 0.85, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95, "proprietary": 1.0, "reserved": 1.0,
}
NAMES = {
    "mit": "mit", "expat": "mit", "isc": "isc", "zlib": "zlib", "bsl 1 0": "bsl", "boost software license": "bsl", "bsd": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "0bsd": "bsd",
    "apache": "apache", "apache 2 0": "apache", "apache license": "apache", "apache license 2 0": "apache", "mpl": "mpl", "mpl 2 0": "mpl", "mozilla public license": "mpl", "epl": "epl", "epl 2 0": "epl",
    "eclipse public license": "epl", "gpl": "gpl", "gplv2": "gpl", "gplv3": "gpl", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "gpl 2 0 only": "gpl", "gpl 3 0 only": "gpl", "gpl 2 0 or later": "gpl", "gpl 3 0 or later": "gpl",
    "general public license": "gpl", "gnu general public license": "gpl", "gnu gpl": "gpl", "lgpl": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "lgpl 2 1 only": "lgpl", "lgpl 2 1 or later": "lgpl",
    "lgpl 3 0 only": "lgpl", "lgpl 3 0 or later": "lgpl", "lesser general public license": "lgpl", "gnu lesser general public license": "lgpl", "agpl": "agpl", "agpl 3 0": "agpl", "agpl 3 0 only": "agpl", "agpl 3 0 or later": "agpl",
    "affero general public license": "agpl", "gnu affero general public license": "agpl", "gfdl": "gfdl", "gnu free documentation license": "gfdl", "cc0": "cc0", "cc0 1 0": "cc0", "unlicense": "unlicense",
    "cc by": "cc-by", "cc by 4 0": "cc-by", "cc by sa": "cc-by-sa", "cc by sa 4 0": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nc 4 0": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nd 4 0": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nc nd 4 0": "cc-by-nc-nd", "creative commons attribution": "cc-by", "public domain": "public-domain", "proprietary": "proprietary",
}
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "isc license": "isc", "permission to use copy modify and or distribute": "isc", "zlib license": "zlib", "boost software license": "bsl",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "apache license": "apache", "mozilla public license": "mpl", "eclipse public license": "epl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "gnu free documentation license": "gfdl", "cc0": "cc0", "released into the public domain": "public-domain", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
}
TAGS = ("spdx license identifier", "license expression", "licensed under", "released under", "distributed under", "available under", "published under")
FILLERS = frozenset("a an any at either both its license licence licenses of option terms the this under version v your 1 2 3 4 0".split())
LATER = (("or", "later"), ("or", "any", "later", "version"), ("or", "newer"), ("only",))
EXCEPTIONS = frozenset("classpath llvm gcc autoconf bison font linking openssl qt".split())
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

BINDS = {"or": 1, "and": 2, "with": 3}
#: What an exception takes off a restriction.
EXCEPTED = 0.2

Value = tuple[frozenset, float]


def evaluated(tokens: Sequence[str | tuple[str, ...] | Value]) -> Value | None:
    """The licences and the restriction that an expression comes to: operands (Value), and, or, with, brackets.  Shunting-yard: values and waiting operators on two stacks."""
    values: list[Value] = []
    waiting: list[str] = []

    def apply() -> None:
        op = waiting.pop()
        if len(values) < 2:
            return
        (b, y), (a, x) = values.pop(), values.pop()
        values.append((a | b, max(x - EXCEPTED * bool(y), 0.0) if op == "with" else max(x, y) if op == "and" else min(x, y)))

    operand = False  # whether one has just been read
    for t in tokens:
        if t == "(" and not operand:
            waiting.append("(")
        elif t == ")" and operand and "(" in waiting:
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif isinstance(t, tuple) and not operand:
            values.append(t)
            operand = True
        elif t in BINDS and operand:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[t]:
                apply()
            waiting.append(t)
            operand = False
    if not operand and waiting and waiting[-1] != "(":
        waiting.pop()
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        else:
            apply()
    return values[0] if values else None


@lru_cache(1)
def _names() -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """Names by their first word, longest first."""
    out: dict[str, list] = {}
    for name, label in NAMES.items():
        words = tuple(name.split())
        out.setdefault(words[0], []).append((words, label))
    return {k: sorted(v, key=lambda x: -len(x[0])) for k, v in out.items()}


def read(words: Sequence[str], gaps: Sequence[str]) -> tuple[list, int]:
    """The tokens of an expression and how many words it takes.  ``gaps[i]`` is what stands before word i."""
    tokens: list = []
    i, end, operand = 0, 0, False
    while i < len(words):
        gap = gaps[i]
        if i and ("\n" in gap or ";" in gap or "!" in gap or "?" in gap or (gap.startswith(".") and len(gap) > 1)):
            break
        for c in gap:
            if c in "()":
                tokens.append(c)
            elif c == "/" and operand:
                tokens.append("or")
                operand = False
        if operand and (later := next((x for x in LATER if tuple(words[i : i + len(x)]) == x), None)):
            i += len(later)
            end = i
            continue
        found = next((x for x in _names().get(words[i], ()) if tuple(words[i : i + len(x[0])]) == x[0]), None)
        if found:
            if operand:
                break
            tokens.append((frozenset([found[1]]), RESTRICTION[found[1]]))
            i += len(found[0])
            end, operand = i, True
        elif words[i] in BINDS and operand:
            tokens.append(words[i])
            operand = False
            i += 1
            if tokens[-1] == "with":  # the exception, up to the word that says so
                j = next((j for j in range(i, min(i + 6, len(words))) if words[j] == "exception"), None)
                known = j is not None and bool(EXCEPTIONS & set(words[i:j]))
                if j is None:
                    tokens.pop()
                    break
                tokens.append((frozenset(), float(known)))
                i, end, operand = j + 1, j + 1, True
        elif words[i] in FILLERS:
            i += 1
        else:
            break
    if i < len(gaps) and ")" in gaps[i]:
        tokens += [")"] * gaps[i].count(")")
    return tokens, end


@lru_cache(4)
def _automaton(base: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Words between spaces, a character for each byte; a pattern's value is its number of words, bytes, and kinds with their labels."""
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", base), ("notice", NOTICES.items()), ("tag", [(t, "") for t in TAGS])):
        for phrase, label in phrases:
            kinds.setdefault(phrase, []).append((kind, label))
    a = ahocorasick.Automaton()
    for phrase, what in kinds.items():
        key = f" {phrase} ".encode().decode("latin-1")
        a.add_word(key, (len(phrase.split()), len(key), what))
    a.make_automaton()
    return a


def places(column: pa.Array, base: Mapping[str, str]) -> tuple[np.ndarray, dict[int, list[tuple[str, bool, int, int]]], dict[int, float]]:
    """Words of each document; (label, whether of ``base``, first word, words) of its statements; its score, where there are any."""
    w = Words(column, table=WORD)
    n, letters = len(w.start), _FOLD.astype(np.uint8)[w.data]
    lengths = w.end - w.start
    begin = np.cumsum(lengths) - lengths + np.arange(n) + 1
    line = np.full(int(lengths.sum()) + n + 1, 32, np.uint8)
    line[np.arange(int(lengths.sum())) + np.repeat(np.arange(n), lengths) + 1] = letters[WORD[w.data]]
    out: dict[int, list] = {}
    tags: list[tuple[int, int, int]] = []
    for end, (k, size, kinds) in _automaton(tuple(base.items())).iter(line.tobytes().decode("latin-1")):
        at = int(np.searchsorted(begin, end - size + 2))
        doc = int(np.searchsorted(w.first, at, side="right")) - 1
        if at + k > w.first[doc + 1]:
            continue
        for kind, label in kinds:
            if kind == "tag":
                tags.append((doc, at, k))
            else:
                out.setdefault(doc, []).append((label, kind == "base", at - int(w.first[doc]), k))
    scores: dict[int, float] = {}
    inside: dict[int, list[tuple[int, int]]] = {}
    for doc, at, k in tags:
        stop = int(w.first[doc + 1])
        text = lambda a, b: letters[a:b].tobytes().decode(errors="replace")
        size = 64
        while True:  # as many words as the expression takes
            last = min(at + k + size, stop)
            words = [text(w.start[i], w.end[i]) for i in range(at + k, last)]
            gaps = [text(w.end[i - 1], w.start[i] if i < last or last < stop else w.offs[doc + 1]) for i in range(at + k, last + (last == stop))]
            tokens, taken = read(words, gaps)
            if taken < size - 16 or last == stop:
                break
            size *= 4
        value = evaluated(tokens)
        if value:
            first = at - int(w.first[doc])
            out.setdefault(doc, []).extend((label, False, first, k + taken) for label in sorted(value[0]))
            inside.setdefault(doc, []).append((first, first + k + taken))
            scores[doc] = max(scores.get(doc, 0.0), value[1])
    for doc, found in out.items():
        spans = inside.get(doc, [])
        for label, _, first, k in found:
            if not any(a <= first and first + k <= b for a, b in spans):
                scores[doc] = max(scores.get(doc, 0.0), RESTRICTION.get(label, 1.0))
    return np.diff(w.first), out, scores


PLACES = "array<struct<label: string, base: boolean, first: int, words: int>>"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int32()), ("words", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Mapping[str, str] = BASE) -> DataFrame:
    """(id, n_words, places, score) of each row: where phrases of ``base`` and other statements stand, in words from 0, and how much they restrict."""
    base = dict(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "_text"):
                n, found, scores = places(p.column(1), base)
                rows = pa.array([[dict(zip(("label", "base", "first", "words"), x, strict=True)) for x in sorted(found.get(d, ()), key=lambda x: (x[2], x[0], not x[1]))] for d in range(len(n))], _PLACE)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(n.astype(np.int64)), rows, pa.array([scores.get(d, 0.0) for d in range(len(n))])], names=[id_col, "n_words", "places", "score"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, places {PLACES}, score double")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): labels distinct, sorted and joined by commas."""
    base = F.filter("places", lambda p: p["base"])
    first = F.transform(base, lambda p: p["first"].cast("long"))
    joined = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    return found.select(id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), "score")
