"""Named queries on the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import filters, packets, stats
from tidemark.operators import anomaly, dns, flows, intervals, mergers, segments
from tidemark.operators.nearest import nearest
from tidemark.plans.database import Database
from tidemark.plans.session import shared_dir
from tidemark.plans.store import IndexGroup, Store, lookup_join, multi_index_count
from tidemark.sources import archive, captures, flow_csv, interval_files, synthetic
from tidemark.streaming import intervals as live
from tidemark.streaming import late

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Store:
    return Store(t(spark, sf_dir, "events"), "event_id")


LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
US = "epoch_us(ts)"
BUCKET = "CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 3600000000) AS BIGINT)"
HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
ENT = "round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6)"
DOMAIN = "array_to_string(ls[1:least(len(ls) - 1, coalesce(list_position(list_transform(range(1, len(ls) + 1), lambda k: list_sum(list_transform(ls[1:k], lambda x: length(x) + 1)) >= 7), true), len(ls)))], '.')"
NAMES = f"names AS (SELECT page_id, {HOST} AS host, list_reverse(string_split({HOST}, '.')) AS ls FROM pages)"


@query("SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 100")
def scan_ordered_desc(spark, sf_dir):
    top = events(spark, sf_dir).index("value", descending=True).ordered().select("event_id", "value").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 10")
def filter_condition(spark, sf_dir):
    return Store(t(spark, sf_dir, "lineitem"), "l_orderkey").query("l_discount > 0.05 AND l_quantity < 10").df.select(*LINE)


@query("SELECT event_id, event_type, value FROM events WHERE value < 5 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'error'")
def group_union_all(spark, sf_dir):
    s = events(spark, sf_dir)
    return IndexGroup(s.index("value"), s.index("event_type")).query("value < 5", "event_type = 'error'").select("event_id", "event_type", "value")


def _line(spark, sf_dir):
    return Store(t(spark, sf_dir, "lineitem"), "l_orderkey").index("l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity = 10")
def query_eq(spark, sf_dir):
    return _line(spark, sf_dir).eq(10, ordered=False).select(*LINE)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity < 10")
def query_lt(spark, sf_dir):
    return _line(spark, sf_dir).lt(10, ordered=False).select(*LINE)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 10")
def query_gt(spark, sf_dir):
    return _line(spark, sf_dir).gt(10, ordered=False).select(*LINE)


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id")
def lookup_exact(spark, sf_dir):
    return events(spark, sf_dir).index(F.col("event_type")).lookup("view", 0, by=["user_id"]).select("user_id", "event_id")


@query("SELECT user_id, event_id, value FROM events WHERE value < 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def lookup_lower(spark, sf_dir):
    return events(spark, sf_dir).index("value").lookup(50.0, -1, by=["user_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, value FROM events WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1")
def lookup_higher(spark, sf_dir):
    return events(spark, sf_dir).index("value").lookup(50.0, 1, by=["user_id"]).select("user_id", "event_id", "value")


@query("WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, p.user_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts")
def lookup_lower_batch(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view"))
    return lookup_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "view", "view_id").select("event_id", "user_id", "view_id")


@query("SELECT event_id, user_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def cursor_neighbours(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.index("ts").neighbours(["user_id"], ["event_id"]).select("event_id", "user_id", "prev_event_id", "next_event_id")


@query("SELECT event_id, value, lag(event_id) OVER w AS prev_event_id, lag(value) OVER w AS prev_value, lead(event_id) OVER w AS next_event_id, lead(value) OVER w AS next_value FROM events WINDOW w AS (ORDER BY value NULLS FIRST, event_id)")
def cursor_neighbours_all(spark, sf_dir):
    return events(spark, sf_dir).index("value").neighbours(columns=["event_id", "value"]).select("event_id", "value", "prev_event_id", "prev_value", "next_event_id", "next_value")


#: Parts by their price, looked up by line prices: no group key.
PRICED = "p AS (SELECT p_retailprice AS price, min(p_partkey) AS part FROM part GROUP BY 1), l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem)"


def _priced(spark, sf_dir, direction, **kw):
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    parts = Store(t(spark, sf_dir, "part").withColumn("part", F.col("p_partkey")), "p_partkey").index("p_retailprice")
    return parts.nearest(lines, "price", ["part"], direction=direction, **kw).select("l_orderkey", "l_linenumber", "part")


@query(f"WITH {PRICED} SELECT l_orderkey, l_linenumber, part FROM l ASOF LEFT JOIN p ON l.price > p.price")
def asof_backward(spark, sf_dir):
    return _priced(spark, sf_dir, -1)


@query(f"WITH {PRICED} SELECT l_orderkey, l_linenumber, part FROM l ASOF LEFT JOIN p ON l.price < p.price")
def asof_forward(spark, sf_dir):
    return _priced(spark, sf_dir, 1)


@query(f"""WITH {PRICED}, b AS (SELECT l.*, p.price AS low, part AS low_part FROM l ASOF LEFT JOIN p ON l.price >= p.price), f AS (SELECT b.*, p.price AS high, part AS high_part FROM b ASOF LEFT JOIN p ON b.price <= p.price)
SELECT l_orderkey, l_linenumber, CASE WHEN low IS NOT NULL AND (high IS NULL OR abs(price - low) <= abs(price - high)) THEN CASE WHEN abs(price - low) <= 0.25 THEN low_part END WHEN abs(price - high) <= 0.25 THEN high_part END AS part FROM f""")
def asof_nearest(spark, sf_dir):
    return _priced(spark, sf_dir, 0, strict=False, tolerance=0.25)


@query("""WITH v AS (SELECT event_type, ts, min(event_id) AS seen FROM events WHERE value > 90 GROUP BY ALL) SELECT e.event_id, e.event_type, v.seen FROM events e ASOF LEFT JOIN v ON e.event_type = v.event_type AND e.ts < v.ts""")
def asof_groups_forward(spark, sf_dir):
    """A few groups that hold all rows."""
    e = t(spark, sf_dir, "events")
    high = Store(e.where("value > 90").withColumn("seen", F.col("event_id")), "event_id").index("ts")
    return high.nearest(e.select("event_id", "event_type", "ts"), "ts", ["seen"], ["event_type"], 1).select("event_id", "event_type", "seen")


@query("WITH a AS (SELECT * FROM lineitem WHERE l_quantity < 10) SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM a WHERE l_discount > 0.05 AND l_quantity > 3")
def requery(spark, sf_dir):
    first = Store(t(spark, sf_dir, "lineitem"), "l_orderkey").query("l_quantity < 10")
    return first.query("l_discount > 0.05").index("l_quantity").gt(3, ordered=False).select(*LINE)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedup_first(spark, sf_dir):
    return events(spark, sf_dir).index("user_id", drop_duplicates=True).rows().select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id")
def merge_count(spark, sf_dir):
    return events(spark, sf_dir).index("user_id", merge=(F.count("*").alias("n"),)).rows()


@query("SELECT l_suppkey AS key, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY l_suppkey")
def merge_sum(spark, sf_dir):
    return Store(t(spark, sf_dir, "lineitem"), "l_orderkey").index("l_suppkey", merge=(F.round(F.sum("l_quantity"), 6).alias("total"),)).rows()


@query("SELECT event_type AS key, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def merge_minmax(spark, sf_dir):
    return events(spark, sf_dir).index("event_type", merge=(F.min("value").alias("low"), F.max("value").alias("high"))).rows()


@query("SELECT user_id AS key, string_agg(event_id, ',' ORDER BY event_id) AS ids, count(*) AS n FROM events GROUP BY user_id")
def merge_collect(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return events(spark, sf_dir).index("user_id", merge=(ids.alias("ids"), F.count("*").alias("n"))).rows()


@query("SELECT user_id AS key, CAST(arg_max(event_type, event_id) AS VARCHAR) AS merged FROM events GROUP BY user_id")
def merge_fold(spark, sf_dir):
    return mergers.fold(t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", None, lambda kept, new: new, "string")


@query("""WITH RECURSIVE e AS (SELECT event_type AS key, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
r AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s FROM (SELECT DISTINCT key FROM e) UNION ALL SELECT r.key, r.i + 1, (r.s * 31 + e.v) % 1000003 FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT key, arg_max(s, i) AS merged FROM r GROUP BY key""")
def merge_ordered(spark, sf_dir):
    """A merger that depends on the order, over a few keys that hold all rows."""
    return mergers.fold(t(spark, sf_dir, "events"), "event_type", "event_id", "cast(floor(coalesce(value, 0)) AS long)", 1, lambda kept, v: (kept * 31 + v) % 1000003, "long")


@query("SELECT event_type AS key, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def merge_custom(spark, sf_dir):
    """A user's associative merger, with partial states in each task."""
    lift = lambda v: {"n": 1, "low": v, "high": v}
    least = lambda f, a, b: b if a is None else a if b is None else f(a, b)
    join = lambda a, b: {"n": a["n"] + b["n"], "low": least(min, a["low"], b["low"]), "high": least(max, a["high"], b["high"])}
    return mergers.merge(t(spark, sf_dir, "events"), "event_type", "value", lift, join, "struct<n: long, low: double, high: double>").select("key", "merged.n", "merged.low", "merged.high")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def merge_rows(spark, sf_dir):
    """The kept row of each key takes later ones' values."""
    merger = lambda new, kept: {**kept, "value": (kept["value"] or 0) + (new["value"] or 0)}
    s = Store(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    return s.index("user_id").folded(merger).select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))

COUNTED = ("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, count(*) AS n FROM lineitem GROUP BY {k}" for k in COUNTED))
def multi_index_counts(spark, sf_dir):
    return multi_index_count(t(spark, sf_dir, "lineitem"), COUNTED)


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events")
def index_size(spark, sf_dir):
    return events(spark, sf_dir).index("user_id").size()


@query("SELECT event_type, arg_min(event_id, (value, event_id)) AS first_id, arg_max(event_id, (value, event_id)) AS last_id FROM events GROUP BY event_type")
def pop_first_last(spark, sf_dir):
    return events(spark, sf_dir).index("value").ends(["event_type"])


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) > 1")
def pop_remaining(spark, sf_dir):
    return events(spark, sf_dir).index("value").pop(by=["event_type"])[1].df.select("event_id", "event_type", "value")


def _first(df, n: int, *columns: str):
    """The first rows of an ordered result and their places in it."""
    top = df.limit(n).withColumn("_at", F.monotonically_increasing_id())
    return top.select(*columns, F.row_number().over(Window.orderBy("_at")).cast("long").alias("position"))  # at most n rows


@query("SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS position FROM events WHERE value < 50 QUALIFY position <= 100")
def nearest_lower(spark, sf_dir):
    return _first(events(spark, sf_dir).index("value").lt(50), 100, "event_id", "value")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS position FROM events WHERE value > 50 QUALIFY position <= 100")
def nearest_higher(spark, sf_dir):
    return _first(events(spark, sf_dir).index("value").gt(50), 100, "event_id", "value")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id DESC) AS position FROM events WHERE value > 20 QUALIFY position <= 100")
def query_newest_first(spark, sf_dir):
    return _first(events(spark, sf_dir).index("event_type", newest_first=True).query("value > 20"), 100, "event_id", "event_type")


@query("SELECT event_id, event_type, ts, row_number() OVER (ORDER BY ts, event_type, event_id) AS position FROM events WHERE event_type IN ('error', 'signup') QUALIFY position <= 100")
def merge_first(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return _first(intervals.merge_sorted([e.where(F.col("event_type") == k) for k in ("error", "signup")], "ts", "event_id"), 100, "event_id", "event_type", "ts")


@query("SELECT event_id, row_number() OVER (ORDER BY value NULLS FIRST, event_id) AS position FROM events")
def order_positions(spark, sf_dir):
    """Every row's place in index order."""
    return events(spark, sf_dir).index("value").positions().select("event_id", "position")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id) AS position FROM events WHERE event_type IN ('error', 'signup', 'view')")
def merge_positions(spark, sf_dir):
    """Every row's place in the merge of three sources by time."""
    e = t(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return intervals.merge_positions([e.where(F.col("event_type") == k) for k in ("error", "signup", "view")], "ts", "event_id").select("event_id", "position")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS position FROM events QUALIFY position <= 100")
def scan_newest_first(spark, sf_dir):
    return _first(events(spark, sf_dir).scan(newest_first=True), 100, "event_id", "event_type")


@query("SELECT event_id, event_type, value FROM events WHERE event_id IN (0, 17, 411)")
def get_at(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.get_at(0).union(s.get_at(17)).union(s.get_at(411)).select("event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id >= 300 AND value > 20 GROUP BY event_type")
def index_of_later_rows(spark, sf_dir):
    """An index that does not take what was there before it."""
    e = t(spark, sf_dir, "events")
    d = Database(Store(e.where("event_id < 300"), "event_id"))
    d.create_index("later", "value", populate=False)
    d.add(e.where("event_id >= 300"))
    return d.gt("later", 20).store.df.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id, event_type FROM events WHERE value > 60")
def group_tree_distinct(spark, sf_dir):
    """A group in a group, one member deleted, each row once."""
    s = events(spark, sf_dir)
    by_value, by_time, by_type = s.index("value"), s.index("ts"), s.index("event_type")
    g = IndexGroup(by_value, IndexGroup(by_time, by_type))
    g.delete(by_type.luid)
    return g.query("value > 60", distinct=True).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'si%' OR event_type LIKE 'p%'")
def query_prefix(spark, sf_dir):
    i = events(spark, sf_dir).index("event_type")
    return i.prefix("si", ordered=False).union(i.prefix("p", ordered=False)).select("event_id", "event_type")


@query("""SELECT 'all' AS name, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS n FROM events UNION ALL SELECT 'errors', count(*) FILTER (event_type = 'error') FROM events
UNION ALL SELECT 'both', count(*) FILTER (event_type <> 'signup') FROM events""")
def routed_append(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    d = Database(Store(e.where("event_type NOT IN ('error', 'signup')"), "event_id"))
    d.create_index("all", "value")
    d.create_index("errors", "value", takes_all=False)
    d.create_index("both", "value")
    d.add(e.where("event_type = 'error'"), ["errors", "both"])
    d.add(e.where("event_type = 'signup'"), [])
    parts = [d.index(n).rows().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("all", "errors", "both")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT event_id FROM events WHERE value > 10 AND NOT coalesce(event_type = 'error', false) AND event_type <> 'view'")
def sweep_cascade(spark, sf_dir):
    d = Database(events(spark, sf_dir))
    d.create_index("value", "value")
    child = d.gt("value", 10)
    child.create_index("type", "event_type")
    grandchild = child.query("type", "event_type <> 'view'")
    d.set_prune("event_type = 'error'")
    d.sweep()
    return grandchild.store.df.select("event_id")


@query("SELECT event_type, CAST(sum((CASE WHEN value > 50 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)) AS BIGINT) AS hits, count(*) AS n FROM events GROUP BY event_type")
def query_hits(spark, sf_dir):
    d = Database(events(spark, sf_dir), count_hits=True)
    d.create_index("value", "value")
    d.create_index("type", "event_type")
    d.gt("value", 50)
    d.eq("type", "view")
    return d.hits().groupBy("event_type").agg(F.sum("_query_count").alias("hits"), F.count("*").alias("n"))


@query("SELECT user_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us, count(*) AS n FROM events GROUP BY user_id HAVING max(epoch_us(ts)) - min(epoch_us(ts)) > 86400000000")
def duration_key(spark, sf_dir):
    us = intervals.micros("ts")
    spans = t(spark, sf_dir, "events").groupBy("user_id").agg(F.min(us).alias("first"), F.max(us).alias("last"), F.count("*").alias("n"))
    return Store(spans, "user_id").index(F.col("last") - F.col("first")).gt(86_400_000_000, ordered=False).select("user_id", (F.col("last") - F.col("first")).alias("duration_us"), "n")


@query("WITH a AS (SELECT event_id, ((event_id * 1103515245 + 7 * 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 AS x FROM events) SELECT event_id, (x >> 8) % 1000 AS value FROM a")
def synthetic_numbers(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", synthetic.number(F.col("event_id"), 7).alias("value"))


@query("""WITH RECURSIVE r AS (SELECT CAST(-1 AS BIGINT) AS i, CAST(4711 AS HUGEINT) AS x UNION ALL SELECT i + 1, CAST(4294957665 AS HUGEINT) * (x % 4294967296) + x // 4294967296 FROM r WHERE i < (SELECT max(user_id) FROM events))
SELECT event_id, CAST(CASE WHEN x % 4294967296 >= 2147483648 THEN x % 4294967296 - 4294967296 ELSE x % 4294967296 END AS INTEGER) AS value FROM events JOIN r ON r.i = user_id""")
def carried_numbers(spark, sf_dir):
    """The number of each event's user in a sequence from a seed."""
    return t(spark, sf_dir, "events").select("event_id", synthetic.carried(F.col("user_id"), 4711).alias("value"))


@query("SELECT event_id, event_type FROM events WHERE NOT coalesce(event_type = 'error', false)")
def sweep_kept(spark, sf_dir):
    return events(spark, sf_dir).set_prune("event_type = 'error'").sweep()[0].df.select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def sweep_pruned(spark, sf_dir):
    return events(spark, sf_dir).set_prune("event_type = 'error'").sweep()[1].select("event_id", "event_type")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 100")
def archive_constraint(spark, sf_dir):
    return events(spark, sf_dir).set_prune("event_type = 'error'").sweep()[1].where("value > 100").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE false")
def purge(spark, sf_dir):
    return events(spark, sf_dir).purge().df.select("event_id", "value")


@query("SELECT CASE WHEN value >= 50 THEN 'valid' ELSE 'invalid' END AS route, count(*) AS n FROM events GROUP BY 1")
def route_valid_invalid(spark, sf_dir):
    parts = events(spark, sf_dir).route(valid="value >= 50", invalid="value < 50")
    valid, invalid = (parts[k].df.select(F.lit(k).alias("route")) for k in ("valid", "invalid"))
    return valid.union(invalid).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup')")
def remove_row(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.remove(s.query("event_type = 'signup'").df.select("event_id")).df.select("event_id")


@query("SELECT event_id, value FROM events")
def append_version(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.query("value < 50 OR value IS NULL").append(s.query("value >= 50").df).df.select("event_id", "value")


@query(f"SELECT bucket, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_keys, {ENT} AS entropy FROM (SELECT {BUCKET} AS bucket, user_id, count(*) AS c FROM events GROUP BY ALL) GROUP BY bucket")
def interval_entropy(spark, sf_dir):
    return stats.entropy(intervals.aligned(t(spark, sf_dir, "events"), "ts", 3600), ["bucket"], "user_id")


@query(f"SELECT {BUCKET} AS bucket, count(*) AS total, count(DISTINCT user_id) AS unique_keys, round(count(*) / count(DISTINCT user_id), 6) AS ratio FROM events GROUP BY 1")
def interval_ratio(spark, sf_dir):
    return stats.ratio(intervals.aligned(t(spark, sf_dir, "events"), "ts", 3600), ["bucket"], "user_id")


@query(f"SELECT greatest(CAST(ceil((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 600000000) AS BIGINT) - 1, 0) AS bucket, count(*) AS n FROM events GROUP BY 1")
def interval_strict(spark, sf_dir):
    return intervals.aligned(t(spark, sf_dir, "events"), "ts", 600, strict=True).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE u AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us FROM events),
r AS (SELECT key, 0 AS i, min(us) AS s FROM u GROUP BY key UNION ALL SELECT r.key, r.i + 1, (SELECT min(us) FROM u WHERE u.key = r.key AND u.us > r.s + 86400000000) FROM r WHERE EXISTS (SELECT 1 FROM u WHERE u.key = r.key AND u.us > r.s + 86400000000))
SELECT r.key, CAST(r.i AS BIGINT) AS interval, r.s AS start_us, (SELECT count(*) FROM u WHERE u.key = r.key AND u.us BETWEEN r.s AND r.s + 86400000000) AS n_events FROM r""")
def interval_restart(spark, sf_dir):
    return intervals.restart_at_event(t(spark, sf_dir, "events"), "ts", "event_id", 86_400, "user_id")


@query("""WITH RECURSIVE u AS (SELECT epoch_us(ts) AS us FROM events), r AS (SELECT 0 AS i, min(us) AS s FROM u UNION ALL SELECT r.i + 1, (SELECT min(us) FROM u WHERE u.us > r.s + 7200000000) FROM r WHERE EXISTS (SELECT 1 FROM u WHERE u.us > r.s + 7200000000))
SELECT '' AS key, CAST(r.i AS BIGINT) AS interval, r.s AS start_us, (SELECT count(*) FROM u WHERE u.us BETWEEN r.s AND r.s + 7200000000) AS n_events FROM r""")
def interval_restart_all(spark, sf_dir):
    return intervals.restart_at_event(t(spark, sf_dir, "events"), "ts", "event_id", 7200)


@query("""WITH RECURSIVE u AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events),
r AS (SELECT key, rn, us, t0, CAST(0 AS BIGINT) AS k FROM u WHERE rn = 1 UNION ALL SELECT u.key, u.rn, u.us, u.t0, r.k + CASE WHEN u.us - u.t0 > (r.k + 1) * 21600000000 THEN 1 ELSE 0 END FROM r JOIN u ON u.key = r.key AND u.rn = r.rn + 1)
SELECT key, k AS interval, CAST(min(t0) + k * 21600000000 AS BIGINT) AS start_us, count(*) AS n_events FROM r GROUP BY key, k""")
def interval_single_step(spark, sf_dir):
    return intervals.single_step(t(spark, sf_dir, "events"), "ts", "event_id", 21_600, "user_id")


@query(f"""SELECT bucket, feature, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_keys, {ENT} AS entropy FROM (
SELECT {BUCKET} AS bucket, 'user_id' AS feature, CAST(user_id AS VARCHAR) AS v, count(*) AS c FROM events GROUP BY ALL
UNION ALL SELECT {BUCKET} AS bucket, 'event_type' AS feature, event_type AS v, count(*) AS c FROM events GROUP BY ALL) GROUP BY bucket, feature""")
def interval_entropies(spark, sf_dir):
    return stats.entropies(intervals.aligned(t(spark, sf_dir, "events"), "ts", 3600), ["bucket"], ["user_id", "event_type"])


@query("""WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT user_id, us, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a)
SELECT user_id, session, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us FROM b GROUP BY ALL""")
def session_idle(spark, sf_dir):
    return intervals.idle_sessions(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


@query("""WITH a AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1), b AS (SELECT v, c, sum(c) OVER () AS n FROM a),
d AS (SELECT *, sum(c * v / n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS s FROM b), e AS (SELECT *, coalesce(lag(s) OVER (ORDER BY v), 0) AS p FROM d)
SELECT round(1 - sum(c * (p + s) / n) / max(s), 6) AS gini FROM e""")
def gini_quantity(spark, sf_dir):
    return stats.gini(t(spark, sf_dir, "lineitem"), "l_quantity")


@query("""WITH a AS (SELECT l_extendedprice AS v, count(*) AS c FROM lineitem GROUP BY 1), b AS (SELECT v, c, sum(c) OVER () AS n FROM a),
d AS (SELECT *, sum(c * v / n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS s FROM b), e AS (SELECT *, coalesce(lag(s) OVER (ORDER BY v), 0) AS p FROM d)
SELECT round(1 - sum(c * (p + s) / n) / max(s), 6) AS gini FROM e""")
def gini_price(spark, sf_dir):
    """Almost as many keys as rows."""
    return stats.gini(t(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(f"WITH {NAMES} SELECT page_id, host, array_to_string(ls, '.') AS tld_first, {DOMAIN} AS domain FROM names")
def registered_domain(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", stats.host("url").alias("host"))
    return p.select("page_id", "host", stats.tld_first(F.col("host")).alias("tld_first"), stats.registered_domain(F.col("host")).alias("domain"))


STATS = f"""{NAMES}, n AS (SELECT host, {DOMAIN} AS domain, page_id % 7 AS part, count(*) AS c, octet_length(encode(host)) AS len FROM names GROUP BY host, ls, part)"""
WEIGHTED = "round((sum(c * len) * log2(sum(c)) - sum(len * c * log2(c))) / sum(c), 6)"


@query(f"WITH {NAMES}, n AS (SELECT host, {DOMAIN} AS domain, count(*) AS c, octet_length(encode(host)) AS len FROM names GROUP BY host, ls) SELECT domain, CAST(sum(c) AS BIGINT) AS total_queries, count(*) AS subdomains, CAST(sum(c * len) AS BIGINT) AS total_length, {ENT} AS entropy, {WEIGHTED} AS weighted_entropy FROM n GROUP BY domain")
def domain_stats(spark, sf_dir):
    return stats.domain_stats(t(spark, sf_dir, "pages").select(stats.host("url").alias("host")), "host")


@query(f"WITH {NAMES}, n AS (SELECT host, {DOMAIN} AS domain, count(*) AS c, octet_length(encode(host)) AS len FROM names GROUP BY host, ls) SELECT domain, {WEIGHTED} AS weighted_entropy FROM n GROUP BY domain ORDER BY weighted_entropy DESC, domain LIMIT 10")
def top_domains(spark, sf_dir):
    return domain_stats(spark, sf_dir).select("domain", "weighted_entropy").orderBy(F.desc("weighted_entropy"), "domain").limit(10)


@query(f"WITH {STATS}, d AS (SELECT part, domain, sum(c) AS c, sum(c * len) AS bytes FROM n GROUP BY ALL) SELECT part, CAST(sum(c) AS BIGINT) AS total_queries, CAST(sum(bytes) AS BIGINT) AS total_length, {ENT} AS entropy, round((sum(bytes) * log2(sum(c)) - sum(bytes * log2(c))) / sum(c), 6) AS weighted_entropy FROM d GROUP BY part")
def interval_domain_entropy(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("part"), stats.host("url").alias("host"))
    return stats.interval_domain_entropy(stats.domain_stats(p, "host", ["part"]), ["part"])


@query(f"WITH {STATS} SELECT part AS interval, domain, CAST(sum(c) AS BIGINT) AS total_queries, count(*) AS subdomains, {ENT} AS entropy, {WEIGHTED} AS weighted_entropy FROM n GROUP BY part, domain")
def interval_file_round_trip(spark, sf_dir):
    folder = f"{shared_dir(spark)}/intervals-{uuid.uuid4().hex}"
    p = t(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("interval"), stats.host("url").alias("host"))
    found = stats.domain_stats(p, "host", ["interval"])
    interval_files.write(found, folder, "domain")
    return interval_files.read(spark, folder, found.schema).select("interval", "domain", "total_queries", "subdomains", "entropy", "weighted_entropy")


@query(f"WITH n AS (SELECT source, md5(text) AS h, any_value(n_chars) AS len, count(*) AS c FROM documents GROUP BY source, md5(text)) SELECT source, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_keys, {ENT} AS entropy, {WEIGHTED} AS weighted_entropy FROM n GROUP BY source")
def payload_entropy(spark, sf_dir):
    n = t(spark, sf_dir, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.first("n_chars").alias("len"), F.count("*").alias("c"))
    return n.groupBy("source").agg(F.sum("c").alias("total"), F.count("*").alias("unique_keys"), F.round(stats.entropy_of("c"), 6).alias("entropy"), F.round(stats.weighted_entropy_of("c", "len"), 6).alias("weighted_entropy"))


KNN = """d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 10)"""


@query(f"WITH {KNN} SELECT id, rank, round(distance, 6) AS distance FROM knn")
def knn(spark, sf_dir):
    return anomaly.knn(t(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {KNN}, kd AS (SELECT id, max(distance) AS kd FROM knn GROUP BY id),
lrd AS (SELECT k.id, count(*) / sum(greatest(k.distance, kd.kd)) AS lrd FROM knn k JOIN kd ON kd.id = k.neighbour GROUP BY k.id)
SELECT k.id, round(sum(o.lrd / p.lrd) / count(*), 6) AS lof FROM knn k JOIN lrd o ON o.id = k.neighbour JOIN lrd p ON p.id = k.id GROUP BY k.id""")
def lof(spark, sf_dir):
    return anomaly.lof(anomaly.knn(t(spark, sf_dir, "embeddings"), "vec_id", "embedding")).select("id", F.round("lof", 6).alias("lof"))


PRICES = "f AS (SELECT p_partkey AS vec_id, [p_size::DOUBLE, p_retailprice] AS embedding FROM part)"


@query(f"WITH {PRICES}, {KNN.replace('embeddings', 'f')} SELECT id, rank, round(distance, 6) AS distance FROM knn")
def knn_blocks(spark, sf_dir):
    """Small blocks, so that most pairs of them are pruned at every size."""
    p = t(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v"))
    return nearest(p, "p_partkey", "v", block=128)[0].select("id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("SELECT p_partkey, round(p_size / (SELECT max(p_size) FROM part), 6) AS p_size, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def distance_norm(spark, sf_dir):
    return stats.max_normalised(t(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


FLOW = "f AS (SELECT p_partkey AS vec_id, [p_size / (SELECT max(abs(p_size)) FROM part), p_retailprice / (SELECT max(abs(p_retailprice)) FROM part), (p_partkey % 60000) / 65535] AS embedding FROM part)"


@query(f"""WITH {FLOW}, {KNN.replace("embeddings", "f")}, kd AS (SELECT id, max(distance) AS kd FROM knn GROUP BY id),
lrd AS (SELECT k.id, count(*) / sum(greatest(k.distance, kd.kd)) AS lrd FROM knn k JOIN kd ON kd.id = k.neighbour GROUP BY k.id)
SELECT k.id, round(sum(o.lrd / p.lrd) / count(*), 6) AS lof FROM knn k JOIN lrd o ON o.id = k.neighbour JOIN lrd p ON p.id = k.id GROUP BY k.id""")
def flow_lof(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 60000).alias("port"))
    v = anomaly.scaled(p, "p_partkey", ["p_size", "p_retailprice"], ["port"])
    return anomaly.lof(anomaly.knn(v, "p_partkey", "vector")).select("id", F.round("lof", 6).alias("lof"))


def _features(spark, sf_dir):
    e = intervals.aligned(t(spark, sf_dir, "events"), "ts", 86_400).groupBy("bucket")
    return e.agg(*[F.sum((F.col("event_type") == k).cast("double")).alias(k) for k in ("click", "error", "purchase", "signup", "view")], F.sum("value").alias("total"))


@query()
def pca_features(spark, sf_dir):
    p = anomaly.pca(_features(spark, sf_dir), "bucket", ["click", "error", "purchase", "signup", "view", "total"])
    return p.select("bucket", *[F.round(c, 4).alias(c) for c in p.columns[1:]])


@query()
def spe(spark, sf_dir):
    return anomaly.spe(anomaly.pca(_features(spark, sf_dir), "bucket", ["click", "error", "purchase", "signup", "view", "total"]), "bucket")


#: Both components of two columns in closed form; the sign makes the larger loading positive.
PAIR = """c AS (SELECT p_partkey, p_size - (SELECT avg(p_size) FROM part) AS x, p_retailprice - (SELECT avg(p_retailprice) FROM part) AS y FROM part),
s AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d FROM c), l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS l2 FROM s),
v AS (SELECT b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS w1, b / sqrt(b * b + (l2 - a) * (l2 - a)) AS u2, (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) AS w2 FROM l),
p AS (SELECT p_partkey, (x * u1 + y * w1) * sign(CASE WHEN abs(u1) >= abs(w1) THEN u1 ELSE w1 END) AS pc1, (x * u2 + y * w2) * sign(CASE WHEN abs(u2) >= abs(w2) THEN u2 ELSE w2 END) AS pc2 FROM c, v)"""


@query(f"WITH {PAIR} SELECT p_partkey, round(pc1, 4) AS pc1, round(pc2, 4) AS pc2 FROM p")
def pca_pair(spark, sf_dir):
    p = anomaly.pca(t(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return p.select("p_partkey", *[F.round(c, 4).alias(c) for c in ("pc1", "pc2")])


@query(f"WITH {PAIR} SELECT p_partkey, round(pc2 * pc2, 3) AS spe, pc2 * pc2 > 100 AS alarm FROM p")
def spe_pair(spark, sf_dir):
    s = anomaly.spe(anomaly.pca(t(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"]), "p_partkey", last=1, limit=100)
    return s.select("p_partkey", F.round("spe", 3).alias("spe"), "alarm")


@query("""WITH s AS (SELECT event_type, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1),
o AS (SELECT event_type, lo, coalesce(sum(hi - lo + 1000000) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT event_id, event_type, CAST(epoch_us(ts) - lo + start AS BIGINT) AS offset_us FROM events JOIN o USING (event_type)""")
def ts_rebase(spark, sf_dir):
    return intervals.rebase(t(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").select("event_id", "event_type", "offset_us")


@query("""WITH s AS (SELECT user_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1),
o AS (SELECT user_id, lo, coalesce(sum(hi - lo + 1000000) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT event_id, CAST(epoch_us(ts) - lo + start AS BIGINT) AS offset_us FROM events JOIN o USING (user_id)""")
def ts_rebase_many(spark, sf_dir):
    """A file for each user."""
    return intervals.rebase(t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "offset_us")


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS position FROM events WHERE event_type IN ('error', 'signup')""")
def merge_sorted(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    both = e.where("event_type = 'error'").union(e.where("event_type = 'signup'"))
    return both.select("event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_type", "event_id")).cast("long").alias("position"))


SEGMENTS = "seg AS (SELECT l_orderkey AS stream, l_linenumber * 10 AS o, CAST(l_quantity AS BIGINT) % 25 AS n FROM lineitem)"


def _segments(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), (F.col("l_linenumber") * 10).cast("long").alias("o"), (F.col("l_quantity").cast("long") % 25).alias("n"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT *, o + n AS e, max(o + n) OVER (PARTITION BY stream ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM seg),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR o <= m THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY o RANGE UNBOUNDED PRECEDING) AS gaps FROM m)
SELECT stream, CAST(min(o) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS prefix_end, count(*) AS n_segments FROM g WHERE gaps = 0 GROUP BY stream""")
def contiguous_prefix(spark, sf_dir):
    return segments.contiguous_prefix(_segments(spark, sf_dir), "stream", "o", "n")


@query(f"WITH {SEGMENTS} SELECT stream, CAST(sum(greatest(least(o + n, 40) - o, 0)) AS BIGINT) AS kept, CAST(sum(n - greatest(least(o + n, 40) - o, 0)) AS BIGINT) AS dropped FROM seg GROUP BY stream")
def truncate_after(spark, sf_dir):
    return segments.truncate_after(_segments(spark, sf_dir), "stream", "o", "n", 40)


@query("""WITH b AS (SELECT l_orderkey AS stream, l_linenumber * 3 + i AS pos, arg_max(chr(CAST(97 + (l_partkey + i) % 26 AS INTEGER)), l_partkey * 1000 + l_quantity * 10 + l_linenumber) AS c
FROM lineitem, unnest(range(0, CAST(l_quantity AS BIGINT) % 5)) AS r(i) GROUP BY ALL), g AS (SELECT *, pos - row_number() OVER (PARTITION BY stream ORDER BY pos) AS run FROM b)
SELECT CAST(stream AS VARCHAR) AS stream, CAST(min(pos) AS BIGINT) AS start, string_agg(c, '' ORDER BY pos) AS data FROM g GROUP BY g.stream, run""")
def assembled(spark, sf_dir):
    o = F.sequence(F.lit(0), (F.col("l_quantity").cast("long") % 5 - 1).cast("int"))
    data = F.array_join(F.transform(o, lambda i: F.char(97 + (F.col("l_partkey") + i) % 26)), "").cast("binary")
    lines = t(spark, sf_dir, "lineitem").where("cast(l_quantity AS long) % 5 > 0")
    s = lines.select("l_orderkey", (F.col("l_linenumber") * 3).alias("o"), data.alias("d"), (F.col("l_partkey") * 1000 + F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("a"))
    return segments.assemble(s, "l_orderkey", "o", "d", "a").select("stream", "start", F.decode("data", "UTF-8").alias("data"))


@query("SELECT least(l_suppkey, l_partkey) AS low, greatest(l_suppkey, l_partkey) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2")
def flow_key(spark, sf_dir):
    zero = F.lit(0)
    low, high = segments.flow_key(F.col("l_suppkey"), zero, F.col("l_partkey"), zero)
    return t(spark, sf_dir, "lineitem").select(low.alias("a"), high.alias("b")).groupBy(F.col("a.addr").alias("low"), F.col("b.addr").alias("high")).agg(F.count("*").alias("n"))


def _hex(c, width: int):
    return F.lpad(F.hex(c.cast("long")), width, "0")


def _packets(spark, sf_dir):
    """A TCP packet for each line: supplier and part as addresses, the order's name as payload."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    body = F.concat(F.lit("order "), o.cast("string"))
    size = F.octet_length(body)
    ip = F.concat(F.lit("4500"), _hex(size + 40, 4), F.lit("0000000040060000"), _hex(F.col("l_suppkey"), 8), _hex(F.col("l_partkey"), 8))
    tcp = F.concat(_hex(F.lit(1024) + n, 4), F.lit("0050"), _hex(o, 8), _hex(n, 8), F.lit("5018FFFF00000000"))
    packet = F.unhex(F.concat(F.lit("0200000000010200000000020800"), ip, tcp, F.hex(body)))
    return t(spark, sf_dir, "lineitem").select(o.alias("l_orderkey"), n.alias("l_linenumber"), packet.alias("packet"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT) AS dst, 1024 + l_linenumber AS sport, 80 AS dport, l_orderkey AS seq, 24 AS flags, 'order ' || l_orderkey AS payload FROM lineitem")
def packet_fields(spark, sf_dir):
    s = _packets(spark, sf_dir).withColumn("sig", packets.parse()("packet"))
    number = lambda c: F.conv(F.hex(f"sig.{c}"), 16, 10).cast("long").alias(c)
    return s.select("l_orderkey", "l_linenumber", number("src"), number("dst"), "sig.sport", "sig.dport", "sig.seq", "sig.flags", F.decode("sig.rest", "UTF-8").alias("payload"))


@query("SELECT lpad(upper(to_hex(least(l_suppkey, l_partkey))), 8, '0') AS low, count(*) AS n FROM lineitem GROUP BY 1")
def packet_flows(spark, sf_dir):
    s = _packets(spark, sf_dir).select(F.lit(0).alias("ts_us"), F.col("l_linenumber").alias("record"), packets.parse(4)("packet").alias("sig"))
    return flows.keyed(s).groupBy(F.substring("conversation", 1, 8).alias("low")).agg(F.count("*").alias("n"))


FILTERS = {
    "tcp and dst port 80 and src net 0.0.0.0/27": "l_suppkey < 32",
    "host 0.0.0.7": "l_suppkey = 7 OR l_partkey = 7",
    "not portrange 1024-1027": "l_linenumber > 3",
    "udp or (tcp src port 1025 and not dst net 0.0.1.0/24)": "l_linenumber = 1 AND (l_partkey < 256 OR l_partkey > 511)",
    "!(src host 0.0.0.5 || vlan) && greater 64": "l_suppkey <> 5 AND length(CAST(l_orderkey AS VARCHAR)) >= 4",
}


@query(" UNION ALL ".join(f"SELECT '{f}' AS filter, l_orderkey, l_linenumber, 'order ' || l_orderkey AS payload FROM lineitem WHERE {w}" for f, w in FILTERS.items()))
def packet_filters(spark, sf_dir):
    parts = [filters.matching(_packets(spark, sf_dir), f).select(F.lit(f).alias("filter"), "l_orderkey", "l_linenumber", F.decode("sig.rest", "UTF-8").alias("payload")) for f in FILTERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""WITH w AS (SELECT *, 'order ' || l_orderkey AS body, 20 + length('order ' || l_orderkey) AS size FROM lineitem),
b AS (SELECT *, list_transform(string_split(body || CASE WHEN length(body) % 2 = 1 THEN chr(1) ELSE '' END, ''), lambda x: CASE WHEN x = chr(1) THEN 0 ELSE ascii(x) END) AS bytes FROM w),
s AS (SELECT *, (l_suppkey >> 16) + (l_suppkey & 65535) + (l_partkey >> 16) + (l_partkey & 65535) + 6 + size + 1024 + l_linenumber + 80 + (l_orderkey >> 16) + (l_orderkey & 65535) + l_linenumber + 20504 + 65535
  + CAST(list_sum(list_transform(bytes, lambda x, i: x * CASE WHEN i % 2 = 1 THEN 256 ELSE 1 END)) AS BIGINT) AS total FROM b),
f AS (SELECT *, (total & 65535) + (total >> 16) AS once FROM s)
SELECT l_orderkey, l_linenumber, (once & 65535) + (once >> 16) = 65535 AS right_as_sent, (65535 - ((once & 65535) + (once >> 16))) % 65535 AS short_by FROM f""")
def packet_checksums(spark, sf_dir):
    """Packets whose checksum field is 0: whether that is right, and what it should be."""
    s = _packets(spark, sf_dir).withColumn("sig", packets.parse()("packet"))
    right = s.withColumn("ok", packets.checksum_right("packet"))

    @F.pandas_udf("long")
    def due(src: pd.Series, dst: pd.Series, packet: pd.Series) -> pd.Series:
        return pd.Series([packets.tcp_checksum(a, b, p[34:]) for a, b, p in zip(src, dst, packet, strict=True)])

    return right.select("l_orderkey", "l_linenumber", F.col("ok").alias("right_as_sent"), (due("sig.src", "sig.dst", "packet") % 65535).alias("short_by"))


def _talks(spark, sf_dir):
    """Packets of a TCP conversation for each customer: opening, the numbers of the orders, each acknowledged, and one of four endings; of every fourth customer the second order is lost."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("body"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    c, k, n = F.col("c"), F.col("k"), F.col("n")

    def packet(ms, client: bool, seq, ack, flags: int, body=None):
        ends = [F.concat(_hex(c, 8), F.lit("FF000001")), F.lit("04000050")] if client else [F.concat(F.lit("FF000001"), _hex(c, 8)), F.lit("00500400")]
        data = F.hex(body) if body is not None else F.lit("")
        size = (F.length(data) / 2).cast("long") + 40
        ip = F.concat(F.lit("4500"), _hex(size, 4), F.lit("0000000040060000"), ends[0])
        tcp = F.concat(ends[1], _hex(seq, 8), _hex(ack, 8), F.lit(f"50{flags:02X}FFFF00000000"))
        bytes_ = F.unhex(F.concat(F.lit("0200000000010200000000020800"), ip, tcp, data))
        return F.struct((c * 1_000_000_000 + ms * 1000).cast("long").alias("ts_us"), bytes_.alias("packet"))

    zero, sent = F.lit(0), 1 + 8 * k
    opening = F.array(packet(zero, True, zero, zero, 2), packet(F.lit(1), False, zero, F.lit(1), 18))
    data = packet(10 * k, True, sent - 8, F.lit(1), 24, F.col("body"))
    ack = packet(10 * k + 5, False, F.lit(1), sent, 16)
    lost = (c % 4 == 3) & (k == 2)
    fin = F.array(packet(10 * n + 10, True, sent, F.lit(1), 17), packet(10 * n + 11, False, F.lit(1), sent + 1, 17), packet(10 * n + 12, True, sent + 1, F.lit(2), 16))
    none = F.array().cast("array<struct<ts_us: long, packet: binary>>")
    ending = F.when(k < n, none).when(c % 4 == 0, fin).when(c % 4 == 1, F.array(packet(10 * n + 10, True, sent, F.lit(1), 4))).otherwise(none)
    rows = o.select("c", F.explode(F.concat(F.when(k == 1, opening).otherwise(none), F.when(lost, F.array(ack)).otherwise(F.array(data, ack)), ending)).alias("p"))
    return rows.select("c", "p.ts_us", F.col("p.ts_us").alias("record"), packets.parse()("p.packet").alias("sig"))


@query("""WITH o AS (SELECT o_custkey AS c, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT c AS customer, CAST(1 AS BIGINT) AS starts, CASE WHEN c % 4 = 3 AND n > 1 THEN 1 ELSE n END AS n_data, string_agg(body, '' ORDER BY k) FILTER (c % 4 <> 3 OR k = 1) AS data,
  CASE WHEN c % 4 = 0 THEN 'FIN' WHEN c % 4 = 1 THEN 'RST' WHEN c % 4 = 3 AND n > 1 THEN 'MISSING_PACKET' ELSE 'TIMEOUT' END AS reason FROM o GROUP BY c, n""")
def conversation_events(spark, sf_dir):
    events = flows.conversations(flows.keyed(_talks(spark, sf_dir)))
    number = F.conv(F.substring("conversation", 1, 8), 16, 10).cast("long")
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "data", F.struct("offset", F.decode("data", "UTF-8").alias("d"))))), lambda x: x["d"]), "")
    counted = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return events.groupBy(number.alias("customer")).agg(counted("start").alias("starts"), counted("data").alias("n_data"), data.alias("data"), F.max("reason").alias("reason"))


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT c, CASE WHEN c % 4 = 3 AND n > 1 THEN 1 ELSE n END AS n_data, CASE WHEN c % 4 = 0 THEN 256 WHEN c % 4 = 1 THEN 257 WHEN c % 4 = 3 AND n > 1 THEN 259 ELSE 258 END AS code FROM o)
SELECT 4 AS code, count(*) AS n, CAST(NULL AS BIGINT) AS bytes FROM e UNION ALL SELECT 1, CAST(sum(n_data) AS BIGINT), CAST(8 * sum(n_data) AS BIGINT) FROM e UNION ALL SELECT code, count(*), NULL FROM e GROUP BY code""")
def flow_records(spark, sf_dir):
    """Typed records of starts, data and ends, written and read back."""
    folder = f"{shared_dir(spark)}/flows-{uuid.uuid4().hex}"
    flows.write(flows.conversations(flows.keyed(_talks(spark, sf_dir))), folder)
    return spark.read.parquet(folder).groupBy("code").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1)
SELECT c AS customer, CAST(2 AS BIGINT) AS syn, CAST(CASE WHEN c % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS fin, CAST(CASE WHEN c % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS rst,
  CAST(1 + 2 * n - CASE WHEN c % 4 = 3 AND n > 1 THEN 1 ELSE 0 END + CASE WHEN c % 4 = 0 THEN 3 ELSE 0 END AS BIGINT) AS ack FROM o""")
def packet_flags(spark, sf_dir):
    counted = lambda name: F.count(F.when(packets.has_flag(F.col("sig.flags"), name), 1)).alias(name.lower())
    return _talks(spark, sf_dir).groupBy(F.col("c").alias("customer")).agg(*map(counted, ("SYN", "FIN", "RST", "ACK")))


@query("SELECT l_orderkey AS seq, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(count(*) * length('order ' || l_orderkey) AS BIGINT) AS bytes, min(l_orderkey * 1000 + l_linenumber) AS first_us FROM lineitem GROUP BY l_orderkey")
def capture_round_trip(spark, sf_dir):
    """Packets written as captures and read back."""
    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    captures.write(_packets(spark, sf_dir).withColumn("ts_us", F.col("l_orderkey") * 1000 + F.col("l_linenumber")), folder)
    s = captures.read(spark, folder).withColumn("sig", packets.parse()("packet"))
    return s.groupBy(F.col("sig.seq").alias("seq")).agg(F.count("*").alias("n"), F.sum(F.col("sig.sport") - 1024).alias("lines"), F.sum(F.octet_length("sig.rest")).alias("bytes"), F.min("ts_us").alias("first_us"))


@query("""SELECT o_orderkey AS conn, CASE WHEN o_custkey % 7 < 4 THEN CAST(167772160 + o_custkey % 256 AS BIGINT) END AS a_addr, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS bytes_a2b, CASE WHEN o_orderkey % 5 <> 0 THEN 3 END AS syns_a2b, o_orderkey % 5 <> 0 AS valid FROM orders""")
def flow_csv_round_trip(spark, sf_dir):
    """Lines of flow statistics, some of them cut or with bad addresses, written and parsed."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    address = F.concat(F.when(c % 7 < 4, "10").otherwise("310"), F.lit(".0.0."), (c % 256).cast("string"))
    head = F.concat_ws(",", o, address, F.lit("10.0.0.1,80,81,1.5,2.5"), *[F.lit(str(i)) for i in range(7, 12)])
    rest = F.concat_ws(",", *[c.cast("string") if i == 25 else F.lit(str(i)) for i in range(12, 39)], F.lit("3/1"), F.lit("2/2"))
    t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, head).otherwise(F.concat_ws(",", head, rest)).alias("value")).write.text(folder)
    return flow_csv.read(spark, folder).select("conn", "a_addr", "bytes_a2b", "syns_a2b", "valid")


def _name_packets(spark, sf_dir):
    """A datagram for each page, a minute apart: of ten, six ask for its host, two answer, one is no name query, and one goes to another port."""
    p = t(spark, sf_dir, "pages").select("page_id", stats.host("url").alias("host")).where("host != ''")
    kind = F.col("page_id") % 10
    label = lambda x: F.concat(_hex(F.octet_length(x), 2), F.hex(x))
    question = F.concat(F.array_join(F.transform(F.split("host", "[.]"), label), ""), F.lit("0000010001"))
    answered = kind.isin(6, 7)
    message = F.concat(F.lit("0007"), F.when(answered, "8180").otherwise("0100"), F.lit("0001"), F.when(answered, "0001").otherwise("0000"), F.lit("00000000"), question, F.when(answered, "C00C000100010000003C000401020304").otherwise(""))
    body = F.when(kind < 8, message).otherwise(F.hex(F.concat(F.lit("junk"), (F.col("page_id") % 4).cast("string"))))
    size = (F.length(body) / 2).cast("long")
    ip = F.concat(F.lit("4500"), _hex(size + 28, 4), F.lit("00000000401100000A0000"), _hex(F.col("page_id") % 11, 2), F.lit("0A0001"), _hex(F.col("page_id") % 3, 2))
    packet = F.unhex(F.concat(F.lit("0200000000010200000000020800"), ip, F.lit("1388"), F.when(kind == 9, "0063").otherwise("0035"), _hex(size + 8, 4), F.lit("0000"), body))
    return p.select("page_id", (F.col("page_id") * 60_000_000).alias("ts_us"), packets.parse()(packet).alias("sig"))


STARTS = "CAST(page_id * 60000000 // 3600000000 * 3600000000 AS BIGINT)"


@query(f"WITH {NAMES} SELECT page_id, CASE WHEN page_id % 10 < 6 THEN 'valid' ELSE 'invalid' END AS route, CASE WHEN page_id % 10 < 6 THEN array_to_string(ls, '.') END AS query FROM names WHERE host <> '' AND page_id % 10 IN (0, 1, 2, 3, 4, 5, 8)")
def dns_dispatch(spark, sf_dir):
    return dns.dispatch(_name_packets(spark, sf_dir)).select("page_id", "route", F.col("sig.dns_query").alias("query"))


@query(f"WITH {NAMES}, n AS (SELECT {STARTS} AS start_us, host, {DOMAIN} AS domain, count(*) AS c, octet_length(encode(host)) AS len FROM names WHERE host <> '' AND page_id % 10 < 6 GROUP BY start_us, host, ls) SELECT start_us, domain, CAST(sum(c) AS BIGINT) AS total_queries, count(*) AS subdomains, CAST(sum(c * len) AS BIGINT) AS total_length, {ENT} AS entropy, {WEIGHTED} AS weighted_entropy FROM n GROUP BY start_us, domain")
def dns_interval_stats(spark, sf_dir):
    return dns.query_statistics(dns.dispatch(_name_packets(spark, sf_dir)), "ts_us", 3600)


@query(f"WITH {NAMES}, n AS (SELECT {STARTS} AS start_us, page_id % 4 AS k, count(*) AS c, 5 AS len FROM names WHERE host <> '' AND page_id % 10 = 8 GROUP BY ALL) SELECT start_us, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_keys, {ENT} AS entropy, {WEIGHTED} AS weighted_entropy FROM n GROUP BY start_us")
def dns_invalid_payloads(spark, sf_dir):
    return dns.payload_statistics(dns.dispatch(_name_packets(spark, sf_dir)), "ts_us", 3600)


@query(f"""WITH {NAMES}, n AS (SELECT {STARTS} AS start_us, 'src' AS side, '10.0.0.' || page_id % 11 AS v, count(*) AS c FROM names WHERE host <> '' GROUP BY ALL
UNION ALL SELECT {STARTS}, 'dst', '10.0.1.' || page_id % 3, count(*) FROM names WHERE host <> '' GROUP BY ALL) SELECT start_us, side, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_keys, {ENT} AS entropy FROM n GROUP BY start_us, side""")
def ip_interval_stats(spark, sf_dir):
    return dns.address_statistics(_name_packets(spark, sf_dir), "ts_us", 3600)


@query("SELECT props, count(*) AS n FROM events WHERE props IS NOT NULL AND NOT coalesce(value < 5, false) GROUP BY props")
def archive_round_trip(spark, sf_dir):
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.write(t(spark, sf_dir, "events").select("props", "value"), "props", folder, skip=F.col("value") < 5)
    return archive.read(spark, folder).groupBy(F.decode("payload", "UTF-8").alias("props")).agg(F.count("*").alias("n"))


def _live(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a stream takes a table that is one file by a glob only
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


#: Append mode gives what the watermark has closed: intervals that end no later than the last event less the delay.
CLOSED = "(SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 600000000"


@query(f"SELECT start_us, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_keys, {ENT} AS entropy FROM (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, user_id, count(*) AS c FROM events GROUP BY ALL) WHERE start_us + 3600000000 <= {CLOSED} GROUP BY start_us")
def stream_entropy(spark, sf_dir):
    return live.drain(live.entropy(_live(spark, sf_dir), "ts", "user_id", 3600, "10 minutes"), shared_dir(spark))


@query(f"""WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3600000000 THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(us) AS first_us, max(us) + 3600000000 AS end_us, count(*) AS n_events FROM b GROUP BY user_id, s HAVING max(us) + 3600000000 <= {CLOSED}""")
def stream_sessions(spark, sf_dir):
    return live.drain(live.sessions(_live(spark, sf_dir), "ts", "user_id", 3600, "10 minutes"), shared_dir(spark))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_of_key(spark, sf_dir):
    return live.drain(live.first_of_key(_live(spark, sf_dir), "ts", ["user_id", "event_type"], "40 days").select("user_id", "event_type"), shared_dir(spark))


DAY = "epoch_us(ts) // 86400000000"


@query(f"SELECT {DAY} AS interval, count(*) AS n FROM events WHERE {DAY} > (SELECT max({DAY}) FROM events) - 5 GROUP BY 1")
def stream_retained(spark, sf_dir):
    """A sink that keeps the last five days."""
    at = f"{shared_dir(spark)}/retained-{uuid.uuid4().hex}"
    df = _live(spark, sf_dir)
    live.retain(df, "ts", 86_400, 5, f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return live.retained(spark, f"{at}/rows", df.schema).groupBy("interval").agg(F.count("*").alias("n"))


@query(f"SELECT {DAY} AS interval, count(*) AS n FROM events WHERE ({DAY} + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000 GROUP BY 1")
def stream_closed(spark, sf_dir):
    """Rows of the days that the watermark has closed; late rows would be apart."""
    at = f"{shared_dir(spark)}/closed-{uuid.uuid4().hex}"
    df = _live(spark, sf_dir)
    late.apart(df, "ts", 86_400, 3600, f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return late.closed(spark, f"{at}/rows", df.schema, 86_400, 3600).groupBy("interval").agg(F.count("*").alias("n"))
