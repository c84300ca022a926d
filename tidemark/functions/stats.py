"""Entropy, Gini, domain statistics and ratios; every one is aggregated to distinct keys before anything is ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import running


def entropy_of(counts: str | Column) -> Column:
    """Shannon entropy in bits, from a column of counts of distinct keys."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)


def weighted_entropy_of(counts: str, lengths: str) -> Column:
    c, n = F.col(counts), F.col(lengths)
    return (F.sum(c * n) * F.log2(F.sum(c)) - F.sum(n * c * F.log2(c))) / F.sum(c)


def entropy(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    n = df.groupBy(*by, key).agg(F.count("*").alias("_c"))
    return n.groupBy(*by).agg(F.sum("_c").alias("total"), F.count("*").alias("unique_keys"), F.round(entropy_of("_c"), 6).alias("entropy"))


def entropies(df: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``entropy`` of several keys in one pass: (*by, feature, total, unique_keys, entropy)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("string").alias("_value")) for k in keys]))
    return entropy(df.select(*by, each.alias("_x")).select(*by, "_x.feature", "_x._value"), [*by, "feature"], "_value")


def ratio(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    n = df.groupBy(*by, key).agg(F.count("*").alias("_c"))
    return n.groupBy(*by).agg(F.sum("_c").alias("total"), F.count("*").alias("unique_keys"), F.round(F.sum("_c") / F.count("*"), 6).alias("ratio"))


def gini(df: DataFrame, key: str) -> DataFrame:
    """Gini coefficient of a numeric key.  The running sum is over distinct keys, range by range.  Null where all keys are zero or there are none."""
    n = df.groupBy(F.col(key).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("n"))
    share = n.join(F.broadcast(total)).withColumn("x", F.col("c") * F.col("v") / F.col("n"))  # one row of an aggregate
    step = running(share, ["v"], {"s": "x"})
    return step.agg(F.round(1 - F.try_divide(F.sum(F.col("c") * (2 * F.col("s") - F.col("x")) / F.col("n")), F.max("s")), 6).alias("gini"))


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))


def reversed_labels(name: Column) -> Column:
    return F.reverse(F.split(name, "[.]"))


def tld_first(name: Column) -> Column:
    return F.array_join(reversed_labels(name), ".")


def registered_domain(name: Column) -> Column:
    """TLD-first labels while their encoded length (one more than each label) is under 7, never the last label."""
    ls = reversed_labels(name)
    grown = F.aggregate(ls, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("full")), lambda a, x: F.when(a["full"], a).otherwise(F.struct((a["n"] + F.length(x) + 1).alias("n"), (a["k"] + 1).alias("k"), (a["n"] + F.length(x) + 1 >= 7).alias("full"))), lambda a: a["k"])
    return F.array_join(F.slice(ls, 1, F.least(F.size(ls) - 1, grown)), ".")


def domain_stats(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Per registered domain: queries, unique names, bytes, entropy and length-weighted entropy over its names."""
    n = df.groupBy(*by, F.col(name).alias("_name")).agg(F.count("*").alias("c"))
    n = n.select(*by, registered_domain(F.col("_name")).alias("domain"), "c", F.octet_length("_name").cast("long").alias("len"))
    return n.groupBy(*by, "domain").agg(F.sum("c").alias("total_queries"), F.count("*").alias("subdomains"), F.sum(F.col("c") * F.col("len")).alias("total_length"), F.round(entropy_of("c"), 6).alias("entropy"), F.round(weighted_entropy_of("c", "len"), 6).alias("weighted_entropy"))


def interval_domain_entropy(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entropy of an interval over its domains, plain and weighted by the mean length of a domain's queries."""
    q, n = F.col("total_queries"), F.col("total_length")
    weighted = (F.sum(n) * F.log2(F.sum(q)) - F.sum(n * F.log2(q))) / F.sum(q)
    return stats.groupBy(*by).agg(F.sum(q).alias("total_queries"), F.sum(n).alias("total_length"), F.round(entropy_of("total_queries"), 6).alias("entropy"), F.round(weighted, 6).alias("weighted_entropy"))


def max_normalised(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    top = df.agg(*[F.max(F.abs(c)).cast("double").alias(f"_m_{c}") for c in columns])
    return df.join(F.broadcast(top)).select(*keys, *[F.round(F.when(F.col(f"_m_{c}") == 0, 0.0).otherwise(F.col(c) / F.col(f"_m_{c}")), 6).alias(c) for c in columns])
