"""Scans over ranges against plain loops, with nulls, ties, frequent keys and empty tables."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans


def test_ranges_follow_the_order(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000).alias("v"))
    rows = scans.in_ranges(df, ["v", "id"], 13).collect()
    rows.sort(key=lambda r: (r.v is not None, r.v, r.id))
    at = [r["_range"] for r in rows]
    assert at == sorted(at) and len(set(at)) == 13 and max(map(at.count, set(at))) < 3 * 5000 / 13  # a third of the rows have one key
    assert scans.in_ranges(df.limit(0), ["v"], 5).count() == 0 and set(r["_range"] for r in scans.in_ranges(df, ["v"], 1).collect()) == {0}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_and_neighbours(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1, 1, 2, 5, 9, rng.randrange(50)]), rng.choice([None, rng.randrange(-5, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, x long").repartition(4)
    rows.sort(key=lambda r: (r[1] is not None, r[1], r[0]))
    got = {r.id: r for r in scans.running(df, ["k", "id"], {"total": "x", "n": F.lit(1)}, parts).collect()}
    near = {r.id: (r.prev_id, r.prev_x, r.next_id, r.next_x) for r in scans.neighbours(df, ["k", "id"], ["id", "x"], parts).collect()}
    total = 0
    for i, (id_, k, x) in enumerate(rows):
        total += x or 0
        assert (got[id_].k, got[id_].total, got[id_].n) == (k, total, i + 1)
        before, after = rows[i - 1] if i else (None,) * 3, rows[i + 1] if i + 1 < len(rows) else (None,) * 3
        assert near[id_] == (before[0], before[2], after[0], after[2])
    assert scans.running(df.limit(0), ["k"], {"total": "x"}).count() == scans.neighbours(df.limit(0), ["k"], ["x"]).count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize(("by", "tolerance", "parts"), [((), 4, 30), (("g",), None, 7)])
def test_asof(spark, direction, strict, by, tolerance, parts):
    rng = random.Random(f"{direction}{strict}{by}")
    group = lambda: rng.choice(["a", "a", "a", "b", None, "c"])
    probes = [(i, group(), rng.choice([None, 50, 50, rng.randrange(200)])) for i in range(150)]
    rows = [(i, group(), rng.choice([None, 50, rng.randrange(200)]), rng.choice([None, f"x{i}"])) for i in range(60)]
    p, r = spark.createDataFrame(probes, "id long, g string, t long"), spark.createDataFrame(rows, "row long, g string, t long, x string")
    r = r if by else r.drop("g")
    got = {q.id: (q.row, q.x) for q in scans.asof(p, r, "t", ["row", "x"], by, direction, strict, tolerance, "row", parts).collect()}
    assert len(got) == len(probes)
    for id_, g, t in probes:
        at = {}
        for i, h, s, x in rows:
            if s is not None and t is not None and (not by or h == g) and not (strict and s == t):
                at.setdefault(s, (i, x))
        places = sorted(at)
        low = places[: bisect_right(places, t)] if t is not None else []
        high = places[bisect_left(places, t) :] if t is not None else []
        near = [s for s in {"backward": low[-1:], "forward": high[:1], "nearest": low[-1:] + high[:1]}[direction] if tolerance is None or abs(s - t) <= tolerance]
        assert got[id_] == (at[min(near, key=lambda s: (abs(s - t), s))] if near else (None, None)), (id_, g, t)


def test_asof_of_times_and_empty_tables(spark):
    p = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:10' AS t UNION ALL SELECT 2, timestamp'2024-01-01 00:00:30'")
    r = spark.sql("SELECT 7 AS row, timestamp'2024-01-01 00:00:08.5' AS t")
    assert {q.id: q.row for q in scans.asof(p, r, "t", ["row"], direction="nearest", tolerance=1.5).collect()} == {1: 7, 2: None}
    assert [q.row for q in scans.asof(p, r.limit(0), "t", ["row"]).collect()] == [None, None] and scans.asof(p.limit(0), r, "t", ["row"]).count() == 0
    with pytest.raises(ValueError):
        scans.asof(p, r, "t", ["row"], direction="sideways")


def test_ranges_do_not_grow_with_the_table(spark, monkeypatch):
    """Unless told how many ranges there are, none holds many more than ROWS rows, and scans over them give the same."""
    monkeypatch.setattr(scans, "ROWS", 100)
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 1000).alias("k"))
    largest = [scans.in_ranges(df.limit(n), ["k", "id"]).groupBy("_range").count().agg(F.max("count")).first()[0] for n in (500, 3000)]
    assert max(largest) < 300, largest
    got = {r.id: (r.n, r.prev_id) for r in scans.neighbours(scans.running(df, ["k", "id"], {"n": F.lit(1)}), ["k", "id"], ["id"]).collect()}
    order = [i for _, i in sorted((i * 7919 % 1000, i) for i in range(3000))]
    assert got == {i: (n + 1, order[n - 1] if n else None) for n, i in enumerate(order)}
    near = scans.asof(df, df.where("k % 10 = 0").withColumn("row", F.col("id")), "k", ["row"], direction="nearest", strict=False, tolerance=4, tie="id")
    at = {}
    for i in sorted(order, reverse=True):
        at[i * 7919 % 1000] = i
    want = {i: next((at[p] for p in sorted(range(0, 1000, 10), key=lambda p: (abs(p - k), p)) if abs(p - k) <= 4), None) for i, k in ((i, i * 7919 % 1000) for i in order)}
    assert {r.id: r.row for r in near.collect()} == want
