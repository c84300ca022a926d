"""The pipeline's stages against brute force, each on its own input, and with nulls, repeats, ties, long texts, empty tables and clashing columns."""

import random
import re
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, quality, queries

SF = "/root/testdata/sf0.001"
STAGE = dict(pipeline.STAGES)
EXTRA = "lang string, source string, n_chars long, score double, kept long, leaks string, spans string, ids string, _kept int, _spans int, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    text = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    base = [text(60) for _ in range(6)]
    texts = [None, "", "  ", *base, base[0], base[1] + " tail", text(20) + " " + bench[0] + " " + text(20), bench[1], "mail a.b@example.com or +1 (988) 555-2485 now", text(100_000) + " 1.2.3.4"]
    rows = [(i, t, "en", "s", -1, 0.5, 1, "x", "y", "z", 2, 3, "w") for i, t in enumerate(texts)]
    rows += [rows[3], (None, base[2], *rows[0][2:]), (None, text(30), *rows[0][2:])]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


@pytest.mark.parametrize("name", list(STAGE))
def test_columns_and_empty_tables(spark, docs, name):
    out = STAGE[name](spark, docs, SF)
    want = [c for c in docs.columns if name != "tokens" or c not in ("n_tokens", "ids")] + (["n_tokens", "ids"] if name == "tokens" else [])
    assert out.columns == want and out.count() <= docs.count()
    kept = [c for c in docs.columns if c not in ("text", "n_chars", "ids")]
    assert not Counter(rows(out.select(*kept))) - Counter(rows(docs.select(*kept)))
    none = STAGE[name](spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == want


def test_quality_stage(spark, docs):
    """A text stays if the model gives it the threshold or more, by its lookup tables added up one by one."""
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    want = []
    for r in docs.collect():
        x = quality.features(pa.array([r.text], pa.string()))[0]
        z = model.base + sum(t[int((c <= x[j]).sum())] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True))) + sum(t[int((a <= x[i]).sum()), int((b <= x[j]).sum())] for i, j, a, b, t in model.pairs)
        if 1 / (1 + np.exp(-z)) >= queries.PREDICT_AT:
            want.append(tuple(r))
    assert rows(STAGE["quality"](spark, docs, SF)) == sorted(want, key=repr)


def test_near_duplicates_stage(spark, docs):
    every = docs.collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r.text)) else None for r in every]
    root = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    kept = set()
    for g in set(root):
        ids = [r.doc_id for r, x in zip(every, root, strict=True) if x == g]
        kept.add(min((i for i in ids if i is not None), default=None))
    want = [tuple(r) for r in every if r.doc_id in kept]
    assert rows(STAGE["near_duplicates"](spark, docs, SF)) == sorted(want, key=repr) and len(want) < len(every)


def test_decontaminate_stage(spark, docs):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set()
    for r in docs.collect():
        w = words(r.text)
        for x in items:
            five = set(bag(x))
            for s in range(max(len(w) - len(x), 0) + 1) if len(x) >= 5 and len(w) >= 5 and any(tuple(w[i : i + 5]) in five for i in range(len(w) - 4)) else ():
                a, b = bag(w[s : s + len(x)]), bag(x)
                if (a & b).total() >= (0.8 - 1e-12) * (a | b).total():
                    gone.add(r.doc_id)
    want = [tuple(r) for r in docs.collect() if r.doc_id not in gone]
    assert gone and rows(STAGE["decontaminate"](spark, docs, SF)) == sorted(want, key=repr)


def test_personal_data_stage(spark, docs):
    model = pii.fit(docs)
    said = {(r.doc_id, r.text): r.found for r in pii.find(docs, model, out="found").collect()}
    want = []
    for r in docs.collect():
        t, spans = r.text, sorted((s.start, pii.KINDS.index(s.kind), s.end, s.kind) for s in said[r.doc_id, r.text])
        if t is not None:
            out, at = "", 0
            for s, _, e, kind in spans:
                out += t[at:s] + f"[{kind.upper()}]" if s >= at else ""
                at = max(at, e)
            t = out + t[at:]
        want.append(tuple((r.asDict() | {"text": t, "n_chars": None if t is None else len(t)}).values()))
    got = rows(STAGE["personal_data"](spark, docs, SF))
    assert got == sorted(want, key=repr) and any("[EMAIL] or [PHONE] now" in (r[1] or "") for r in got) and any((r[1] or "").endswith(" [IP]") for r in got)


def test_tokens_stage(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    got = STAGE["tokens"](spark, docs, SF).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens * 4 == len(r.ids)


def test_run_is_its_stages(spark):
    """The whole pipeline over the smallest tables: each document that stays passed every stage, and no other did."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in pipeline.STAGES:
        step = stage(spark, step, SF).cache()
        if name != "tokens":
            assert step.columns == docs.columns
    digest = lambda df: rows(df.select("doc_id", "text", "n_chars", "n_tokens", F.sha2("ids", 256)))
    assert digest(pipeline.run(spark, SF)) == digest(step) and 0 < step.count() < docs.count()
