"""Running sums, neighbours and as-of matches over any order, without a task that sees all rows.

Rows are dealt to ranges of the order: bounds come from a bounded sample, a row's range from a binary search among them.  Each range is scanned in its own order; what it needs from
the ranges before or after it (a sum, a last row) is one row for each range.  Give an order that tells rows of a frequent key apart (a row id after the key), so that no range
is large.  The rows are shuffled once, by range.

Order columns sort as Spark sorts them: nulls first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.times import micros
from tidemark.plans.session import stored

#: Sampled rows for each range, and the most ranges: together what one task sees of the order.
SAMPLED, MOST = 64, 4096
#: Rows of a range: a table has as many ranges as shuffle partitions, and more where these would be larger.
ROWS = 1 << 20


def in_ranges(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_range`` (int), which follows the order: about ``parts`` ranges of equal size; unless told, as many as shuffle partitions, and no fewer than leave ``ROWS`` rows to each.

    The bounds are written to the shared folder, so every use of the result has the same ranges."""
    return _in_ranges(df, order, parts)[0]


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with their ranges dealt to tasks for a scan: where ranges outnumber shuffle partitions, to more tasks, so that none sorts many ranges at once."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(2 * parts, "_range") if parts > usual else rows


def _in_ranges(df: DataFrame, order: Sequence[str], parts: int | None) -> tuple[DataFrame, int]:
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("k"))
    n = keys.count()
    parts = min(parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), MOST)
    few = keys if n <= 2 * parts * SAMPLED else keys.sample(parts * SAMPLED / n, seed=7)
    places = F.sequence(F.lit(1), F.lit(max(parts - 1, 1)))
    at = lambda i: F.get("s", (i * F.size("s") / parts).cast("int"))
    bounds = few.agg(F.array_sort(F.collect_list("k")).alias("s")).select(F.array_distinct(F.array_compact(F.transform(places, at))).alias("_bounds"))
    # The number of bounds that are not above the row, by halving steps.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    step = lambda lo, k: F.when((lo + k <= F.size("_bounds")) & (F.get("_bounds", lo + k - 1) <= key), lo + k).otherwise(lo)
    return df.join(F.broadcast(stored(bounds, "bounds"))).withColumn("_range", F.aggregate(steps, F.lit(0), step)).drop("_bounds"), parts  # one row of at most MOST bounds


#: Windows over one row for each range: at most MOST rows.
BEFORE = lambda: Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
AFTER = lambda: Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column | str], parts: int | None = None) -> DataFrame:
    """``df`` with running sums in ``order``, each row's own value included.  Rows of equal order come in any order among them."""
    values = {f"_v{i}": F.expr(c) if isinstance(c, str) else c for i, c in enumerate(sums.values())}
    rows, parts = _in_ranges(df.withColumns(values), order, parts)
    carry = rows.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values]).select("_range", *[F.sum(v).over(BEFORE()).alias(f"_c{v}") for v in values])
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = dealt(rows, parts).withColumns({f"_s{v}": F.sum(v).over(w) for v in values}).join(F.broadcast(carry), "_range", "left")  # a row for each range
    total = lambda v: F.coalesce(F.col(f"_c{v}"), F.lit(0)) + F.coalesce(F.col(f"_s{v}"), F.lit(0))
    return scanned.select(*df.columns, *[total(v).alias(n) for v, n in zip(values, sums, strict=True)])


def neighbours(df: DataFrame, order: Sequence[str], columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``prev_c`` and ``next_c`` of each of ``columns``: those of the rows before and after in ``order``, null at the ends."""
    rows, parts = _in_ranges(df, order, parts)
    value, key = F.struct(*columns), F.struct(*order)
    one = Window.orderBy("_range")  # a row for each range
    carry = rows.groupBy("_range").agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last")).select("_range", F.lag("last").over(one).alias("_p"), F.lead("first").over(one).alias("_n"))
    w = Window.partitionBy("_range").orderBy(*order)
    scanned = dealt(rows, parts).withColumns({"_prev": F.lag(value).over(w), "_next": F.lead(value).over(w)}).join(F.broadcast(carry), "_range", "left")
    found = {"prev": F.coalesce("_prev", "_p"), "next": F.coalesce("_next", "_n")}
    return scanned.select(*df.columns, *[v[c].alias(f"{n}_{c}") for c in columns for n, v in found.items()])


def asof(probes: DataFrame, rows: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), direction: str = "backward", strict: bool = True, tolerance: float | None = None, tie: str | None = None, parts: int | None = None) -> DataFrame:
    """Each probe with ``values`` of the row whose ``on`` is next before it (``backward``), after it (``forward``), or nearer of these (``nearest``; the one before where both are as near).

    ``strict``: not of a row at the probe's own place.  ``by``: of rows of the same group only, nulls being a group; one group may hold most rows.  ``tolerance``: of no row farther away (times: in
    seconds).  ``tie``: of rows at one place, that with the smallest ``tie``; without it, the one with the smallest values.  A probe or row without a place matches nothing.
    Probes keep their columns, which have other names than ``values``; a probe without a match has nulls."""
    looks = {"backward": ["back"], "forward": ["ahead"], "nearest": ["back", "ahead"]}.get(direction)
    if not looks:
        raise ValueError(f"no direction {direction}")
    match = F.struct(*values)
    firsts = rows.where(F.col(on).isNotNull()).groupBy(*by, on).agg((F.min_by(match, tie) if tie else F.min(match)).alias("_m"))  # one row for each place
    # A look back sees what sorts before the probe, one ahead what sorts after it; rows at its place sort on the side that fits.
    side = {"back": 2 if strict else 0, "ahead": 0 if strict else 2}
    none = F.lit(None).cast(firsts.schema["_m"].dataType)
    both = probes.withColumns({"_kind": F.lit(1), "_id": F.monotonically_increasing_id(), "_m": none})
    for look in looks:
        both = both.unionByName(firsts.withColumns({"_kind": F.lit(side[look]), "_id": F.lit(0).cast("long")}), allowMissingColumns=True)
    order = [*by, on, "_kind", "_id"]
    key = F.struct(*order)
    hits = {look: F.when(F.col("_kind") == side[look], F.struct(*by, F.col(on).alias("_at"), "_m")) for look in looks}
    placed, parts = _in_ranges(both, order, parts)
    held = lambda rows: rows.withColumns({f"_h_{look}": h for look, h in hits.items()})
    ends = {"back": F.max_by("_h_back", F.when(F.col("_h_back").isNotNull(), key)), "ahead": F.min_by("_h_ahead", F.when(F.col("_h_ahead").isNotNull(), key))} if len(looks) == 2 else {looks[0]: (F.max_by if looks[0] == "back" else F.min_by)(f"_h_{looks[0]}", F.when(F.col(f"_h_{looks[0]}").isNotNull(), key))}
    carry = held(placed).groupBy("_range").agg(*[e.alias(look) for look, e in ends.items()])
    carry = carry.select("_range", *[F.last(look, True).over(BEFORE() if look == "back" else AFTER()).alias(f"_c_{look}") for look in looks])
    orders = {"back": order, "ahead": [F.desc(c) for c in order]}
    seen = {look: F.last(f"_h_{look}", True).over(Window.partitionBy("_range").orderBy(*orders[look]).rowsBetween(Window.unboundedPreceding, -1)) for look in looks}
    scanned = held(dealt(placed, parts)).withColumns({f"_s_{look}": s for look, s in seen.items()}).where("_kind = 1").join(F.broadcast(carry), "_range", "left")  # a row for each range
    kind = dict(probes.dtypes)[on]

    def away(a: Column, b: Column) -> Column:
        if kind.startswith("timestamp"):
            return F.abs(micros(a) - micros(b)) / 1_000_000
        return F.abs(F.datediff(a, b)) if kind == "date" else F.abs(a - b)

    found = {}
    for look in looks:
        hit = F.coalesce(f"_s_{look}", f"_c_{look}")
        fits = F.col(on).isNotNull()
        for c in by:
            fits &= hit[c].eqNullSafe(F.col(c))
        if tolerance is not None:
            fits &= away(F.col(on), hit["_at"]) <= tolerance
        found[look] = F.when(fits, hit)
    hit = found[looks[0]]
    if direction == "nearest":
        nearer = F.coalesce(away(F.col(on), found["ahead"]["_at"]) < away(F.col(on), found["back"]["_at"]), found["back"].isNull())
        hit = F.when(nearer, found["ahead"]).otherwise(found["back"])
    return scanned.withColumn("_hit", hit).select(*probes.columns, *[F.col("_hit")["_m"][c].alias(c) for c in values])
