"""Conversation repair, licence statements and source divergence against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import conversations, divergence, licenses, queries
from tidemark.llm._spark import table

SF = "/root/testdata/sf0.001"
EXTRA = ", audit string, n_words long, places string, chunk long, rank int"


def plain(rows):
    """What becomes of one conversation's rows (turn, role, text) after damage: the contract, word for word."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    n, go = len(rows), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, g, inserts):
        ways = [(0, "", ())] if i == n and g in (0, 3) else []
        for r in "ua" if inserts < 3 else "":
            if r in go[g] and (w := best(i, go[g][r], inserts + 1)):
                ways.append((w[0] + 2, "I" + w[1], ((names[r], ""), *w[2])))
        if i < n:
            _, role, text = rows[i]
            if w := best(i + 1, g, 0):
                ways.append((w[0] + 3, "D" + w[1], w[2]))
            more = faults[i] == "truncated"
            if faults[i] not in ("blank", "duplicate"):
                for r, edit, cost, name in [(role[:1], "K", 0, role), ("u", "R", 2, "user"), ("a", "R", 2, "assistant")]:
                    if r and r in go[g] and (w := best(i + 1, go[g][r], 0)):
                        ways.append((w[0] + cost + more, edit + w[1], ((name, text), *w[2])))
        return min(ways) if ways else None

    for i in range(n, -1, -1):
        for g in range(4):
            best(i, g, 0)
    cost, audit, left = best(0, 0, 0)
    turns = [r[0] for r in rows if r[0] is not None]
    f = Counter(faults)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    body = "\n".join(f"{r}:{t}" for r, t in left)
    return (gaps, f["blank"], f["duplicate"], f["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest()), left


def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        blank = lambda v: " " if v is None else v
        role, text, k = blank(role), blank(text), zlib.crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20
        out[c] += [(turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def talk(rng, c, n):
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None, "ux"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "What?\n", "a. b"]
    return [(c, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice([*texts, f"say {rng.random()}.", f"word {rng.random()}"]), "x", 1, "y", 2, 3) for _ in range(n)]


@pytest.mark.parametrize("records", ["3", "10000"])
def test_conversations(spark, records):
    """Also with a conversation that many batches and tasks share."""
    rng = random.Random(3)
    rows = [r for c in (None, *range(60)) for r in talk(rng, c, rng.randrange(1, 14))] + talk(rng, 99, 300)
    rows += [(100, i, ("system", "user", "assistant")[min(i, 1 + (i + 1) % 2)], f"part {i}.", "x", 1, "y", 2, 3) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + EXTRA).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = {r[0]: tuple(r)[1:] for r in conversations.repair(df).collect()}
        some = conversations.damage(df)
        left = defaultdict(list)
        for r in sorted(conversations.repaired(some, conversations.edits(some)).collect(), key=lambda r: r.place):
            left[r.conv_id].append((r.role, r.text))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    after = damaged(rows)
    want = {c: plain(x) for c, x in after.items()}
    assert got == {c: w[0] for c, w in want.items()}
    assert {c: tuple(x) for c, x in left.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == {c: plain(x)[0] for c, x in damaged(rows).items()} and len(got) == len({r[0] for r in rows})


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(df).count() == 0


def test_weights_of_parts():
    """A segment's weights are those of its parts, whatever the cut."""
    rng = random.Random(9)
    for _ in range(40):
        rows = "".join(rng.choices("uasoUASObd", k=rng.randrange(1, 150)))
        at = rng.randrange(len(rows) + 1)
        for g in range(4):
            whole = conversations.weights(rows, g)
            assert whole == conversations.from_state(rows, g)
            assert whole == conversations.product({g: conversations.weights(rows[:at], g)}, {x: conversations.weights(rows[at:], x) for x in range(4)})[g]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def base_of(text):
    w = re.findall(WORD, lower(text))
    found = [(i, label) for phrase, label in licenses.BASE.items() for k in [phrase.split()] for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


LICENSED = {
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR MIT\nx": ("gpl,mit", 0.2),
    "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": ("gpl", 0.5),
    "SPDX-License-Identifier: MIT AND (Apache-2.0 OR MPL-2.0)": ("apache,mit,mpl", 0.25),
    "SPDX-License-Identifier: MIT OR Apache-2.0 AND MPL-2.0": ("apache,mit,mpl", 0.2),
    "Licensed under either the MIT license or the Apache License, Version 2.0.": ("apache,mit", 0.2),
    "released under MIT/LGPL-2.1-or-later": ("lgpl,mit", 0.2),
    "Licensed under (MIT and GPL-3.0-or-later": ("gpl,mit", 0.7),
    "Licensed under MIT and\nApache": ("mit", 0.2),
    "SPDX-License-Identifier: MIT. Apache-2.0": ("mit", 0.2),
    "licensed under nothing at all": ("", 0.0),
    "CC BY-NC 4.0": ("cc-by,cc-by-nc", 0.85),
    "mit Apache gpl": ("", 0.0),
    "Released under the MIT License. All rights reserved.": ("mit,reserved", 1.0),
    "This work is licensed under the GNU General Public License, version 3.": ("gpl", 0.7),
}


def test_licenses(spark):
    rng = random.Random(2)
    pieces = ["CC", "by", "cc-by", "general", "public", "license", "General\nPublic, License", "all rights", "reserved", "écc", "by-nc", "Ä", "\x00", "a1", "licensed under", "MIT", "or", "(", ")", "SPDX-License-Identifier:"]
    texts = [None, "", " .. ", *LICENSED, *["".join(rng.choice(pieces) + rng.choice([" ", "-", "", "\n"]) for _ in range(rng.randrange(40))) for _ in range(300)], "cc", "by nd"]
    texts += ["filler words " * 60_000 + "CC BY", "word licensed under " + "(" * 300 + "MIT or GPL-3.0" + ")" * 300 + " or LGPL-3.0"] + ["Licensed under MIT" + " or MIT" * 400 + " or GPL-2.0 end"]
    rows = [(i, t, "x", 1, "y", 2, 3) for i, t in enumerate(texts)] + [(None, "cc by", "x", 1, "y", 2, 3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)
    got = licenses.digest(licenses.scan(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "cc by"
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
        if text in LICENSED:
            assert (r.labels, pytest.approx(r.score)) == LICENSED[text], text
    long = {r.doc_id: r for r in got}
    assert long[len(texts) - 2].labels == "gpl,lgpl,mit" and long[len(texts) - 1].labels == "gpl,mit"
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_of_the_table(spark):
    """Every row of the query: base columns by regular expressions, labels and score by searching each statement of these tables."""
    lines = {"licensed under the gnu general public license": ("gpl", 0.7), "all rights reserved": ("reserved", 1.0), "released under the mit license": ("mit", 0.2), "licensed under cc by nc": ("cc-by,cc-by-nc", 0.85), "licensed under the apache license": ("apache", 0.25)}
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    some = 0
    for r in queries.op12_licenses(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text[r.doc_id])
        words = " ".join(re.findall(WORD, lower(text[r.doc_id])))
        found = [v for k, v in lines.items() if f" {k} " in f" {words} "]
        assert set(",".join(x for x, _ in found).split(",")) == set(r.labels.split(",")) and r.score == pytest.approx(max((s for _, s in found), default=0))
        some += bool(found)
    assert some > 3


def test_expressions():
    """The shunting-yard parser against recursive descent, on random expressions."""
    rng = random.Random(1)

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            v = (frozenset([str(rng.random())]), rng.choice([0.1, 0.5, 0.9]))
            return [v], v
        parts = [expression(depth - 1) for _ in range(2)]
        op = rng.choice(["and", "or"])
        value = (parts[0][1][0] | parts[1][1][0], (max if op == "and" else min)(parts[0][1][1], parts[1][1][1]))
        return ["(", *parts[0][0], op, *parts[1][0], ")"], value

    for _ in range(300):
        tokens, value = expression(5)
        assert licenses.evaluated(tokens) == value
    a, b, c = ((frozenset(x), s) for x, s in (("a", 0.9), ("b", 0.1), ("c", 0.5)))
    assert licenses.evaluated([a, "or", b, "and", c])[1] == 0.5 and licenses.evaluated(["(", a, "or", b, ")", "and", c])[1] == 0.5
    assert licenses.evaluated([a, "and"]) == a and licenses.evaluated(["(", "(", a]) == a and licenses.evaluated(["or", ")"]) is None


def audited(rows, least=3, top=200):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(x for g, _, w in docs if g == lang for x in set(w))
        kept = [x for x, k in df.items() if k >= least]
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, w in docs:
            if g == lang:
                counts[s].update(x for x in w if df[x] >= least)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept), o.encode()) for o in counts if o != s]
            terms = [(-((p[s][x] - q[x]) ** 2 // q[x]), x.encode()) for x in kept if counts[s][x] and p[s][x] > q[x]]
            out += [(lang, s, part, o.decode(), -v, i + 1) for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for i, (v, o) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("width", "block", "flush"), [(4096, 64, 1 << 24), (7, 2, 200)])
def test_divergence(spark, monkeypatch, width, block, flush):
    """Nulls, empty and long texts, repeated rows, ties, a language without kept terms; also in many chunks, blocks and flushes."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(4)
    vocabulary = ["Été", "ß", "漢字", "a", "Zz", "zZ", "x-y", "n0t", "é" * 300, *["".join(rng.choices("abcé", k=3)) for _ in range(40)]]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(60))), rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "é", None, "Z", "s10"])) for _ in range(150)]
    rows += [rows[0]] * 5 + [(None, "en", "none"), ("", "fr", "empty"), ("only here", "xx", "a"), ("other words", "xx", "b"), ("lonely", "yy", "b"), ("long " * 60_000, "fr", "s1")]
    df = spark.createDataFrame([(1, *r, "x", 1, "y", 2, 3) for r in rows], "doc_id long, text string, lang string, source string" + EXTRA).repartition(3)
    assert sorted(map(tuple, divergence.divergence(df, width=width, flush=flush).collect())) == audited(rows)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_are_exact():
    big = np.array([[0, 10**11, 3 * 10**12]])
    total = np.array([[4 * 10**12 + 7]])
    assert divergence.shares(big, total).tolist() == [[1 + 10**9 * (int(c) + 1) // (4 * 10**12 + 7) for c in big[0]]]


def test_counted_is_by_group():
    got = divergence.counted(pa.array(["g", "g", "h"]), pa.array(["s", "s", "s"]), pa.array(["a A b", "a", "a"])).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == [("g", "s", "a", 3, 2), ("g", "s", "b", 1, 1), ("h", "s", "a", 1, 1)]
