"""The quality query against a plain version of it, word by word and bin by bin."""

import math
import re
import zlib

import pytest
from tidemark.llm import quality, queries

SF = "/root/testdata/sf0.01"


def plain_features(t):
    b = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, k = max(len(b), 1), max(len(w), 1)
    of = lambda chars: sum(b.count(c.encode()) for c in chars)
    classes = [sum(65 <= c <= 90 for c in b), of("!"), of("|"), of("#$%&*@^~<>{}[]\\_=+"), of("0123456789"), of(".,;:?"), sum(c >= 128 for c in b), of("\n")]
    caps = sum(65 <= x <= 90 and 65 <= y <= 90 for x, y in zip(b[:-1], b[1:], strict=True)) if b else 0
    same = sum(x == y for x, y in zip(w[:-1], w[1:], strict=True)) if w else 0
    log = math.log1p
    return [log(len(b)), log(len(w)), sum(map(len, w)) / k, *(c / n for c in classes), caps / n, same / k, *map(log, classes[1:4]), log(caps), log(same), log(max(map(len, w), default=0))]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")


def test_query(spark, tables):
    docs, labels = tables
    m = quality.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    assert len(got) == docs.count()
    place = lambda edges, v: sum(e <= v for e in edges)
    for r in docs.collect():
        x = plain_features(r.text)
        z = m.base + sum(t[place(c, v)] for c, t, v in zip(m.cuts, m.tables, x, strict=True)) + sum(t[place(a, x[i]), place(b, x[j])] for i, j, a, b, t in m.pairs)
        g = got[r.doc_id]
        assert g.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and g.predicted == (g.score >= 0.3)


def test_held_out_rows(spark, tables):
    """Rows that trained nothing: what the labels say comes first in the order of scores, and the threshold tells them apart."""
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).where("held_out").collect()}
    y = [(got[r.doc_id].score, got[r.doc_id].predicted, r.quality) for r in tables[1].collect() if r.doc_id in got]
    good, bad = [s for s, _, q in y if q], [s for s, _, q in y if not q]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    right = sum(p == q for _, p, q in y) / len(y)
    print(len(y), "rows, area", auc, "right", right)
    assert auc > 0.97 and right > 0.93


def test_labels_of_the_held_out_fold_change_nothing(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.base == b.base and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_repeats_ties_and_bounds(spark, tables):
    docs, labels = tables
    m = quality.fit(docs, labels, sample_rows=50)
    rows = [(1, "The same text."), (1, "The same text."), (2, "The same text."), (3, None), (4, "")]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    assert len(got) == 5 and len({r.score for r in got[:3]}) == 1 and got[3].score == got[4].score
    one = quality.fit(docs, labels.where("quality = 1"))
    assert not one.tables and quality.score(docs.limit(1), one).first().score > 0.9
