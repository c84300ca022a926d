"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

Words are those of the lower-cased text between white space; shingles are five words.  A document leaks an item
if some window of exactly as many words as the item has a weighted shingle similarity of ``least`` or more with it: the
sum of the smaller counts over the sum of the larger ones.  A document with fewer words than the item is one window as a whole.

1. Windows: a window that is similar enough holds at least ceil(2 * least / (1 + least) * n) of an item's n
   shingles, so positions of item shingles in a document give every window worth a fingerprint, and no other.  A document of
   m < n shingles must hold least / (1 + least) * (m + n) of them; it is few pairs, which go to the proof without a fingerprint.
2. Fingerprints: 64-bit SimHash, each shingle weighted by its count, of these windows and of all items.
3. Index: a fingerprint is cut into ``radius`` + 1 blocks.  Two fingerprints within ``radius`` bits agree in a whole block (pigeonhole), so
   joining blocks of equal size finds all of them; the Hamming distance is then checked.
4. Proof: exact weighted similarity of window and item.

At similarity 0.8 two fingerprints differ in 9.7 bits on average (deviation 2.9); beyond the radius of 19
lies a chance of less than 0.1 %, and a leak has several windows.

Item shingles are broadcast up to ``MAX_BROADCAST`` of them (some 100 MB), which is counted first; beyond that, Spark shuffles both sides.
Items, wanted windows and fingerprinted windows are written once.  Where an item shares a common shingle with many others, each of its
places in a document is counted for each of them.

Defined cases: null or empty text has no windows; items of fewer than five words have no shingles and match
nothing; repeated rows are reported once; null ids are ordinary ids; repeated items are reported for each id; of equally similar windows the
first is named; empty tables give an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import IDENTITY, identified, renamed, same, stored


MAX_BROADCAST = 2_000_000


def words(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(t, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), "")


def shingles(w: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles of an array of words, in order."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def shingle_rows(df: DataFrame, w: str, k: int) -> DataFrame:
    """(pos, h) for each shingle of the words in column ``w`` beside the other columns: what ``shingles`` gives, as rows and in generated code."""
    rest = [c for c in df.columns if c != w]
    shifted = F.arrays_zip(*[F.slice(w, j + 1, F.greatest(F.size(w) - j, F.lit(0))).alias(f"w{j}") for j in range(k)])
    rows = df.select(*rest, F.size(w).alias("_words"), F.posexplode(shifted).alias("pos", "_x")).where(F.col("pos") <= F.col("_words") - k)
    return rows.select(*rest, "pos", F.xxhash64(*[F.col(f"_x.w{j}") for j in range(k)]).alias("h"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more shingles have it set than not.

    Four bits, 16 apart, are counted in the lanes of one long.  Up to 32,767 shingles, no lane's count
    can reach the next lane or the sign; longer windows are counted bit by bit."""
    one, zero, n = F.lit(1).cast("long"), F.lit(0).cast("long"), F.size(hashes)
    lanes = F.lit(0x0001000100010001)

    def lane_sums(k: int) -> Column:
        return F.aggregate(hashes, zero, lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(lanes))

    def set_bits(s: Column, k: Column) -> Column:
        out = zero
        for low in (0, 16, 32, 48):
            out = out.bitwiseOR(F.when(F.shiftrightunsigned(s, low).bitwiseAND(F.lit(0xFFFF)) * 2 > n, F.call_function("shiftleft", F.lit(1 << low).cast("long"), k)).otherwise(zero))
        return out

    packed = F.aggregate(F.transform(F.array(*map(lane_sums, range(16))), set_bits), zero, lambda f, x: f.bitwiseOR(x))
    bit_count = lambda b: F.aggregate(hashes, zero, lambda s, h: s + one.bitwiseAND(F.call_function("shiftright", h, b)))
    single = F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda f, b: f.bitwiseOR(F.when(bit_count(b) * 2 > n, F.call_function("shiftleft", one, b)).otherwise(zero)))
    return F.when(n <= 32767, packed).otherwise(single)


def blocks(fingerprint: Column, n: int) -> Column:
    """(block number, its bits) for n blocks of nearly equal width."""
    cut = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits")) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])


def _overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of two bags; where nothing comes twice, that is the size of the intersection."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    bags = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    return F.when((F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b)), F.size(F.array_intersect(a, b))).otherwise(bags)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 19) -> DataFrame:
    """(id, item, n_windows, start, similarity) for each document and item that it leaks: similar windows, the first
    start (in words) of the best one and its similarity."""
    listed = benchmark.select(F.col(item_col).alias("item"), words(item_text).alias("w")).repartition(F.xxhash64("item", "w"))
    listed = stored(listed.select("item", F.size("w").alias("size"), shingles(F.col("w"), shingle).alias("has")), "items").where(F.size("has") > 0)
    # Written before the fingerprint: a filter on a computed array would compute it anew for each word.
    items = stored(listed.repartition(F.xxhash64("item", "has")).withColumn("g", simhash(F.col("has"))).withColumn("key", F.monotonically_increasing_id()), "prints")
    known = items.select("key", "size", F.explode(F.array_distinct("has")).alias("h")).groupBy("h").agg(F.collect_list(F.struct("key", "size")).alias("of"))
    few = items.agg(F.coalesce(F.sum(F.size("has")), F.lit(0))).first()[0] <= MAX_BROADCAST
    keyed = identified(docs, id_col, text_col)
    every = shingle_rows(keyed.select(*IDENTITY, words("_text").alias("w")).withColumn("m", F.greatest(F.size("w") - shingle + 1, F.lit(0))), "w", shingle)
    hits = every.join(F.broadcast(known) if few else known, "h").select(*IDENTITY, "m", "pos", F.explode("of").alias("o"))
    near = hits.groupBy(*IDENTITY, "m", F.col("o.key").alias("key"), F.col("o.size").alias("size")).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    n = F.col("size") - shingle + 1
    short = F.col("m") < n
    enough = F.ceil(F.lit(least / (1 + least)) * (F.least("m", n) + n) - 1e-9).cast("int")
    firsts = F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("enough")), lambda i: F.struct((F.get("at", i + F.col("enough") - 1) - n + 1).alias("lo"), F.get("at", i).alias("hi"))), lambda r: r["lo"] <= r["hi"])
    begin = F.when(short, F.array(F.lit(0))).otherwise(F.flatten(F.transform(firsts, lambda r: F.sequence(F.greatest(r["lo"], F.lit(0)), r["hi"]))))
    only = F.when(short, F.col("key"))  # the item that a short document is a window for
    wanted = near.withColumn("enough", enough).where(F.size("at") >= F.col("enough")).select(*IDENTITY, F.explode(F.transform(begin, lambda s: F.struct(F.col("size").alias("size"), s.alias("start"), only.alias("only")))).alias("x"))
    wanted = stored(wanted.groupBy(*IDENTITY).agg(F.collect_set("x").alias("windows")), "wanted")
    # Always by shuffle: documents with windows grow with the documents, and the plan shall be alike at every size.
    again = keyed.join(renamed(wanted, "_w").hint("merge"), same("_w")).select("_id", "windows", words("_text").alias("w")).select("_id", "windows", shingles(F.col("w"), shingle).alias("hs"))
    win = F.slice("hs", F.col("x.start") + 1, F.col("x.size") - shingle + 1)
    windows = again.select("_id", "hs", F.explode("windows").alias("x")).select("_id", "x.size", "x.start", "x.only", win.alias("win"))
    windows = windows.where((F.size("win") == F.col("size") - shingle + 1) | F.col("only").isNotNull())
    windows = stored(windows.withColumn("f", simhash(F.col("win"))).withColumn("window", F.monotonically_increasing_id()), "windows")
    # Fingerprints alone meet.  Short documents and items meet in a block of their own, number -1.
    alone = lambda h: F.array(F.struct(F.lit(-1).alias("block"), h.alias("bits")))
    posted = windows.select("window", "size", "f", F.explode(F.when(F.col("only").isNotNull(), alone(F.col("only"))).otherwise(blocks(F.col("f"), radius + 1))).alias("b"))
    prints = items.select("key", F.col("size").alias("_s"), "g", F.explode(F.concat(alone(F.col("key")), blocks(F.col("g"), radius + 1))).alias("_b"))
    pairs = posted.join(prints, (F.col("size") == F.col("_s")) & (F.col("b.block") == F.col("_b.block")) & (F.col("b.bits") == F.col("_b.bits")))
    # A pair that agrees in several blocks is kept in the first of them.
    differ = F.col("f").bitwiseXOR(F.col("g"))
    cut = [64 * i // (radius + 1) for i in range(radius + 2)]
    first = F.coalesce(*[F.when(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) == 0, F.lit(i)) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])
    pairs = pairs.where((F.col("b.block") == -1) | ((F.bit_count(differ) <= radius) & (first == F.col("b.block")))).select("window", "key")
    both = pairs.join(windows.select("window", "_id", "start", "win"), "window").join(items.select("key", "item", "has"), "key").withColumn("both", _overlap(F.col("win"), F.col("has")))
    proved = both.select("_id", "item", "start", (F.col("both") / (F.size("win") + F.size("has") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= least - 1e-12)
    best = proved.groupBy("_id", "item").agg(F.countDistinct("start").alias("n_windows"), F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.col("_id").alias(id_col), F.col("item").alias(item_col), "n_windows", (-F.col("best.back")).cast("long").alias("start"), F.round("best.similarity", 6).alias("similarity"))
