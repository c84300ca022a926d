"""From packets to statistics of intervals: which packets count as name queries, and what an interval's queries, payloads and addresses say.

Rows are those of ``packets.parse`` with a time in microseconds; they may come from captures in batch or as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import packets, stats

# The port of name servers and the protocol number of datagrams.
NAME_PORT, UDP = 53, 17


def dispatch(df: DataFrame, signature: str = "sig", out: str = "route") -> DataFrame:
    """All columns and the route: ``valid`` for name queries without an answer, ``invalid`` for other datagrams from or to the name port.  Other packets go."""
    s = lambda n: F.col(f"{signature}.{n}")
    named = s("dns_query").isNotNull()
    port = (s("l4_type") == UDP) & ((s("sport") == NAME_PORT) | (s("dport") == NAME_PORT))
    route = F.when(named & ~s("dns_answered"), "valid").when(~named & port, "invalid")
    return df.withColumn(out, route).where(F.col(out).isNotNull())


def bucket(us: str | Column, seconds: int) -> Column:
    """Start of the interval in microseconds, aligned to the epoch: the same in batch and stream."""
    c = F.col(us) if isinstance(us, str) else us
    step = F.lit(seconds * 1_000_000)
    return (c - F.pmod(c, step)).cast("long")


def query_statistics(routed: DataFrame, us: str, seconds: int, signature: str = "sig") -> DataFrame:
    """Per interval and registered domain: queries, names, bytes, entropy and weighted entropy."""
    name = F.array_join(stats.reversed_labels(F.col(f"{signature}.dns_query")), ".")
    return stats.domain_stats(routed.where("route = 'valid'").select(bucket(us, seconds).alias("start_us"), name.alias("name")), "name", ["start_us"])


def payload_statistics(routed: DataFrame, us: str, seconds: int, signature: str = "sig") -> DataFrame:
    """Per interval: packets, distinct payloads, their entropy and length-weighted entropy, over what is no name query."""
    rest = F.coalesce(F.col(f"{signature}.rest"), F.lit(b""))
    n = routed.where("route = 'invalid'").groupBy(bucket(us, seconds).alias("start_us"), F.sha2(rest, 256).alias("h")).agg(F.count("*").alias("c"), F.first(F.octet_length(rest)).cast("long").alias("n"))
    return n.groupBy("start_us").agg(F.sum("c").alias("total"), F.count("*").alias("unique_keys"), F.round(stats.entropy_of("c"), 6).alias("entropy"), F.round(stats.weighted_entropy_of("c", "n"), 6).alias("weighted_entropy"))


def address_statistics(df: DataFrame, us: str, seconds: int, signature: str = "sig") -> DataFrame:
    """Per interval and side (src, dst): packets with an address, distinct addresses and their entropy."""
    s = df.where(F.col(f"{signature}.src").isNotNull())
    rows = s.select(bucket(us, seconds).alias("start_us"), *[packets.address(F.col(f"{signature}.{c}")).alias(c) for c in ("src", "dst")])
    return stats.entropies(rows, ["start_us"], ["src", "dst"]).withColumnRenamed("feature", "side")
