import gc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import anomaly, intervals, mergers, segments
from tidemark.plans.database import Database
from tidemark.plans.store import IndexGroup, Store
from tidemark.sources import interval_files


@pytest.fixture(scope="module")
def numbers(spark):
    return Store(spark.range(100).select(F.col("id"), (F.col("id") * 37 % 50 - 20).alias("v")), "id")


@pytest.mark.parametrize("indirect", [False, True])
@pytest.mark.parametrize("drop", [False, True])
def test_sweep_filter_reindex(spark, numbers, indirect, drop):
    """The same answer whatever the store and index are: sweep evens, keep negatives, sweep multiples of three."""
    s = Store.indirect(numbers.df, "id") if indirect else numbers
    kept, gone = s.set_prune("v % 2 = 0").sweep()
    assert kept.size() + gone.count() == 100
    again, _ = kept.query("v < 0").set_prune("v % 3 = 0").sweep()
    got = [r.v for r in again.index("v", descending=True, drop_duplicates=drop).ordered().collect()]
    want = [i * 37 % 50 - 20 for i in range(100)]
    want = [v for v in want if v % 2 and v < 0 and v % 3]
    assert got == sorted(set(want) if drop else want, reverse=True)


def test_index(numbers):
    i = numbers.index("v")
    assert i.lookup(0, -1).first().v == -1 and i.lookup(0, 1).first().v == 1 and i.lookup(0).first().v == 0
    assert i.verify() and not Store(numbers.df, "id").index("v", descending=True).rows().exceptAll(i.rows()).count()
    assert numbers.purge().size() == 0 and numbers.remove([1, 2]).size() == 98
    g = IndexGroup(i, IndexGroup(numbers.index("id")))
    assert g.query("v < 0").count() == 2 * i.query("v < 0").count() and g.query("v < 0", distinct=True).count() == i.query("v < 0").count()
    g.delete(i.luid)
    assert g.size() == 1
    with pytest.raises(ValueError):
        g.add(Store(numbers.df, "id").index("v"))


def test_null_prune_keeps(spark):
    s = Store(spark.createDataFrame([(1, None), (2, 4)], "id int, v int"), "id").set_prune("v > 3")
    assert [r.id for r in s.sweep()[0].df.collect()] == [1]


def test_statistics(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string").withColumn("g", F.lit(1))
    assert stats.entropy(df, ["g"], "k").first().entropy == 1.5
    v = [1.0, 1.0, 2.0, 5.0]
    s = np.cumsum(v) / 4
    want = 1 - sum((a + b) / 4 for a, b in zip(np.r_[0, s[:-1]], s, strict=True)) / s[-1]
    assert stats.gini(spark.createDataFrame([(x,) for x in v], "v double"), "v").first().gini == pytest.approx(want, abs=1e-6)


def test_neighbours_and_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = anomaly.knn(df, "id", "v", 5)
    got = {(r.id, r["rank"]): r.neighbour for r in near.collect()}
    order = d.argsort(1)
    assert all(got[i, k + 1] == order[i, k] for i in range(60) for k in range(5))
    kd = np.sort(d, 1)[:, 4]
    lrd = np.array([5 / sum(max(d[i, o], kd[o]) for o in order[i, :5]) for i in range(60)])
    lof = {r.id: r.lof for r in anomaly.lof(near, 5).collect()}
    assert all(lof[i] == pytest.approx(np.mean(lrd[order[i, :5]] / lrd[i])) for i in range(60))
    wide = df.select("id", *[F.col("v")[i].alias(f"c{i}") for i in range(4)])
    p = np.array([r[1:] for r in anomaly.pca(wide, "id", ["c0", "c1", "c2", "c3"]).orderBy("id").collect()])
    c = x - x.mean(0)
    w, v = np.linalg.eigh(c.T @ c)
    assert np.allclose(np.abs(p), np.abs(c @ v[:, ::-1]))


def test_components_of_large_means(spark):
    rng = np.random.default_rng(6)
    x = 1e8 + rng.normal(size=(500, 3)) * (3, 2, 1)
    df = spark.createDataFrame([(i, *r.tolist()) for i, r in enumerate(x)] + [(900, None, 1.0, 2.0)], "id long, a double, b double, c double").repartition(7)
    n, mean, scatter = anomaly.moments(df, ["a", "b", "c"])
    c = x - x.mean(0)
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(scatter, c.T @ c, rtol=1e-6, atol=1e-3)
    rows = anomaly.pca(df, "id", ["a", "b", "c"]).orderBy("id").collect()
    assert tuple(rows[-1]) == (900, None, None, None)
    assert np.allclose((np.array([r[1:] for r in rows[:-1]]) ** 2).sum(0), np.linalg.eigvalsh(c.T @ c)[::-1])
    assert anomaly.pca(df.limit(0), "id", ["a", "b"]).count() == 0


def test_assembly(spark):
    rng = np.random.default_rng(3)
    for start in (0, 7):
        rows = [(1, int(rng.integers(0, 60)), bytes(rng.integers(1, 255, int(rng.integers(1, 15))).tolist()), a) for a in range(8)]
        image = {}
        for _, o, d, _ in rows:
            image.update({o + i: b for i, b in enumerate(d) if o + i >= start})
        got = {}
        for r in segments.assemble(spark.createDataFrame(rows, "s int, o int, d binary, a int"), "s", "o", "d", "a", start).collect():
            got.update({r.start + i: b for i, b in enumerate(r.data)})
        assert got == image


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_assembly_at_far_offsets(spark, width):
    """Overlaps over bins, a segment at 10**12, duplicates, empty and null rows, equal arrivals."""
    rng = np.random.default_rng(width)
    rows = [(int(k), int(o), bytes(rng.integers(1, 255, int(rng.integers(0, 11))).tolist()), int(a)) for k, o, a in zip(rng.integers(0, 3, 60), rng.integers(0, 90, 60), rng.permutation(60), strict=True)]
    rows += [(0, 10**12, b"far", 5), (0, 10**12 + 2, b"XY", 4), (1, None, b"x", 1), (1, 3, None, 1), (1, 3, b"", 99), (2, 200, b"aa", 7), (2, 201, b"bb", 7)]
    image = {}
    for k, o, d, a in sorted((r for r in rows if r[1] is not None and r[2]), key=lambda r: (r[3], r[1], r[2])):
        image.setdefault(str(k), {}).update({o + i: b for i, b in enumerate(d) if o + i >= 7})
    df = spark.createDataFrame(rows, "s int, o long, d binary, a int").repartition(3)
    got = [(r.stream, r.start, bytes(r.data)) for r in segments.assemble(df, "s", "o", "d", "a", 7, width=width).collect()]
    assert {k: {s + i: b for x, s, d in got if x == k for i, b in enumerate(d)} for k in image} == image
    assert not any(k == x and s + len(d) == y for k, s, d in got for x, y, _ in got)  # whole runs
    assert segments.assemble(df.limit(0), "s", "o", "d", "a").count() == 0


def test_mergers(spark):
    df = spark.range(300_000).select("id", F.when(F.col("id") % 3 != 0, F.lit("hot")).alias("k"), (F.col("id") % 1000).alias("v")).repartition(5)
    want = {"hot": 7, None: 7}
    for i in range(300_000):
        k = "hot" if i % 3 else None
        want[k] = (want[k] * 33 + i % 1000) % 99991
    got = mergers.fold(df, "k", "id", "v", 7, lambda kept, v: (kept * 33 + v) % 99991, "long").collect()
    assert {r.key: r.merged for r in got} == want
    texts = mergers.fold(df.where("id < 12"), "k", "id", "cast(id AS string)", list, lambda kept, v: [*kept, v], "array<string>").collect()
    assert {r.key: r.merged for r in texts} == {None: ["0", "3", "6", "9"], "hot": ["1", "2", "4", "5", "7", "8", "10", "11"]}
    sums = mergers.merge(df, "k", "v", lambda v: v, lambda a, b: a + b, "long").collect()
    assert {r.key: r.merged for r in sums} == {k: sum(i % 1000 for i in range(300_000) if (i % 3 == 0) == (k is None)) for k in want}
    assert mergers.merge(df.limit(0), "k", "v", lambda v: v, max, "long").count() == mergers.fold(df.limit(0), "k", "id", "v", 0, max, "long").count() == 0


def test_python_pruner(numbers):
    kept, gone = numbers.set_prune(lambda r: r["v"] % 7 == 0).sweep()
    assert gone.where("v % 7 != 0").count() == 0 < gone.count() and kept.size() + gone.count() == 100


def test_restart_interval(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((0, 5, 10, 11, 30, 41))], "id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.start_us // 10**6, r.n_events) for r in intervals.restart_at_event(df, "ts", "id", 10).orderBy("interval").collect()]
    assert got == [(0, 3), (11, 1), (30, 1), (41, 1)]


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_restart_interval_over_ranges(spark, parts):
    """Long chains, ties and gaps over many ranges; null keys and times."""
    rng = np.random.default_rng(parts)
    rows = [(i, k, int(t)) for i, (k, t) in enumerate(zip(rng.choice(["a", "a", "a", "b", "", "c"], 400), rng.integers(0, 900, 400) ** 2 // 300, strict=True))]
    rows += [(500, None, 5), (501, None, 5), (502, None, 16), (503, "a", None)]
    df = spark.createDataFrame(rows, "id int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for key in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == key and r[2] is not None)
        start, n = None, -1
        for x in times:
            if start is None or x - start > 10:
                start, n = x, n + 1
                want[key, n] = [x * 10**6, 0]
            want[key, n][1] += 1
    got = {(r.key, r.interval): [r.start_us, r.n_events] for r in intervals.restart_at_event(df, "ts", "id", 10, "k", parts).collect()}
    assert got == want
    assert intervals.restart_at_event(df.limit(0), "ts", "id", 10).count() == 0


def test_single_step_interval(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((0, 10, 11, 50, 51, 52, 53, 60, 61, 95, None))], "id int, s long").withColumns({"ts": F.timestamp_seconds("s"), "k": F.lit("a")})
    got = [(r.interval, r.start_us // 10**6, r.n_events) for r in intervals.single_step(df, "ts", "id", 10, "k").orderBy("interval").collect()]
    want, start, n = [], 0, 0
    for s in (0, 10, 11, 50, 51, 52, 53, 60, 61, 95):
        if s - start > 10 and n:
            want.append((start // 10, start, n))
            start, n = start + 10, 0
        n += 1
    assert got == [*want, (start // 10, start, n)]
    assert intervals.single_step(df.limit(0), "ts", "id", 10, "k").count() == 0


def test_interval_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"d{i}", i) for i in range(30)], "interval long, name string, n int")
    at = str(tmp_path / "s")
    interval_files.write(df, at, "name")
    interval_files.write(df.where("interval = 1 AND n < 9"), at, "name")
    got = interval_files.read(spark, at, df.schema)
    assert sorted(map(tuple, got.select("interval", "name", "n").collect())) == sorted((i % 3, f"d{i}", i) for i in range(30) if i % 3 != 1 or i < 9)
    assert interval_files.read(spark, at, df.schema, [2]).count() == 10


def test_orders_and_ties(spark, numbers):
    rows = lambda df: [(r.v, r.id) for r in df.collect()]
    every = [(i * 37 % 50 - 20, i) for i in range(100)]
    i = numbers.index("v")
    assert rows(i.lt(0)) == sorted([x for x in every if x[0] < 0], key=lambda x: (-x[0], x[1])) and rows(i.gt(0)) == sorted(x for x in every if x[0] > 0)
    assert rows(i.query("v % 2 = 0")) == sorted(x for x in every if x[0] % 2 == 0)
    assert rows(numbers.index("v", newest_first=True).ordered()) == sorted(every, key=lambda x: (x[0], -x[1]))
    assert numbers.index("v", descending=True).verify()
    names = Store(spark.createDataFrame([(1, "ab"), (2, "b"), (3, "ab"), (4, "c")], "id int, k string"), "id").index("k")
    assert (names.lookup("b", -1).first().id, names.lookup("b", 1).first().id, names.lookup("a", -1).count()) == (1, 4, 0)
    assert [r.id for r in names.prefix("a").collect()] == [1, 3]


def test_pop(numbers):
    taken, left = numbers.index("v").pop()
    assert [(r.v, r.id) for r in taken.collect()] == [min((i * 37 % 50 - 20, i) for i in range(100))] and left.size() == 99
    taken, left = left.index("v").pop(last=True)
    assert taken.first().v == 29 and left.size() == 98 and numbers.purge().index("v").pop()[0].count() == 0


def test_group_conditions(numbers):
    g = IndexGroup(numbers.index("v"), numbers.index("id"), numbers.index("v"))
    with pytest.raises(ValueError):
        g.query("v < 0", "id < 3")
    with pytest.raises(ValueError):
        IndexGroup().query("v < 0")
    assert g.query("id < 1", "id < 2", "id < 3").count() == 6


def test_database(spark, numbers, tmp_path):
    gone = []
    d = Database(numbers, archive=gone.append, count_hits=True)
    d.create_index("v", "v")
    d.create_index("later", "v", populate=False)
    d.create_index("own", "v", takes_all=False)
    d.create_group("g", "v", "own")
    child = d.query("v", "v < 0")
    child.create_index("v", "v")
    grandchild = child.gt("v", -10)
    n = child.store.size()
    d.add(spark.createDataFrame([(200, -5)], "id long, v long"))
    d.add(spark.createDataFrame([(201, -7), (202, 4)], "id long, v long"), ["own"])
    size = lambda name: d.index(name).rows().count()
    assert (size("v"), size("later"), size("own"), d.group("g").query("id >= 200").count(), d.group().query("id >= 200").count()) == (101, 1, 2, 3, 2)
    assert child.store.size() == n  # later rows are not seen
    assert {r["_query_count"] for r in d.hits().where("v < 0 AND id < 100").collect()} == {1} and d.hits().agg(F.sum("_query_count")).first()[0] == n
    d.set_prune("v % 2 = 0")
    assert d.sweep().count() == gone[0].count() > 0
    assert child.store.df.where("v % 2 = 0").count() == grandchild.store.df.where("v % 2 = 0").count() == 0 and grandchild.store.size() > 0
    d.delete("own")
    assert d.names() == ["v", "later", "g"] and d.group("g").size() == 1
    d.purge()
    assert d.store.size() == child.store.size() == grandchild.store.size() == 0
    with pytest.raises(ValueError):
        d.create_index("v", "v")


def test_sweeps_reach_every_descendant(spark, numbers):
    d = Database(numbers)
    d.create_index("v", "v")
    child = d.query("v", "v < 0")
    n = child.store.size()
    assert d.sweep().count() == 0 and child.store.size() == n > 0  # no prune condition
    child.create_index("v", "v")
    grandchild = child.gt("v", -10)
    del child
    gc.collect()
    d.set_prune("v % 2 = 0")
    d.sweep()
    assert grandchild.store.df.where("v % 2 = 0").count() == 0 < grandchild.store.size()
    d.purge()
    assert grandchild.store.size() == 0


def test_ids_of_any_kind(spark):
    d = Database(Store(spark.createDataFrame([], "id long, v long"), "id"))
    d.create_index("v", "v", populate=False)
    d.add(spark.createDataFrame([(-7, 1), (-9, 1), (-3, 5)], "id long, v long"))
    assert d.index("v").rows().count() == 3 and d.index("v").lookup(5, -1).first().id == -9
    named = Store(spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "id string, v long"), "id").index("v")
    assert named.lookup(2, -1).first().id == named.lookup(0, 1).first().id == "a"


def test_equal_points_and_zero_keys(spark):
    near = anomaly.knn(spark.createDataFrame([(i, [0.0, 0.0] if i < 8 else [0.5, 0.0] if i == 8 else [float(i), 1.0]) for i in range(12)], "id long, v array<double>"), "id", "v", 3)
    lof = {r.id: r.lof for r in anomaly.lof(near, 3).collect()}
    assert all(lof[i] == 1 for i in range(8)) and lof[8] == float("inf")
    assert stats.gini(spark.createDataFrame([(0.0,), (0.0,)], "v double"), "v").first().gini is None
    v = anomaly.scaled(spark.createDataFrame([(1, 2.0, 0, 65535), (2, -4.0, 0, None)], "id int, a double, z int, p int"), "id", ["a", "z"], ["p"])
    assert [r.vector for r in v.orderBy("id").collect()] == [[0.5, 0.0, 1.0], [-1.0, 0.0, 0.0]]


def test_micros_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.5' AS a, timestamp'2024-03-10 00:00:00Z' AS b").select(intervals.micros("a"), intervals.micros("b")).first()
        assert tuple(r) == (1710037800500000, 1710028800000000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_merge_sorted(spark):
    parts = [spark.createDataFrame([(i, i * k % 7) for i in range(20)], "id int, ts int") for k in (3, 5)]
    got = [(r.ts, r.source, r.id) for r in intervals.merge_sorted(parts, "ts", "id").collect()]
    assert got == sorted((i * k % 7, s, i) for s, k in enumerate((3, 5)) for i in range(20))


def test_python_predicates_and_index_removal(spark, numbers):
    assert numbers.query(lambda r: r["v"] % 7 == 0).df.exceptAll(numbers.query("v % 7 = 0").df).count() == 0
    i = numbers.index("v").remove(spark.range(10))
    assert i.rows().count() == 90 and numbers.size() == 100 and i.lt(0).where("id < 10").count() == 0
