"""Flow statistics in comma-separated form, parsed by Spark's own expressions: the file stays splittable and nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Position -> (name, type) of the fields kept; positions 41 and 42 hold SYN/FIN counts as "a/b".
FIELDS = {
    0: ("conn", "bigint"),
    1: ("a_ip", "string"),
    2: ("b_ip", "string"),
    3: ("a_port", "int"),
    4: ("b_port", "int"),
    5: ("flow_start", "double"),
    6: ("flow_end", "double"),
    7: ("packets_a2b", "bigint"),
    8: ("packets_b2a", "bigint"),
    11: ("acks_a2b", "bigint"),
    12: ("acks_b2a", "bigint"),
    25: ("bytes_a2b", "bigint"),
    26: ("bytes_b2a", "bigint"),
    27: ("resent_a2b", "bigint"),
    28: ("resent_b2a", "bigint"),
    37: ("pushed_a2b", "bigint"),
    38: ("pushed_b2a", "bigint"),
}
NEEDED = 17


def ip_number(ip: Column) -> Column:
    """The address as a number, most significant part first; null unless four parts of at most 255."""
    p = F.split(ip, "[.]")
    parts = [F.get(p, F.lit(i)).try_cast("int") for i in range(4)]
    ok = F.size(p) == 4
    for x in parts:
        ok = ok & x.between(0, 255)
    return F.when(ok, sum((x.cast("long") * (1 << (24 - 8 * i)) for i, x in enumerate(parts[1:], 1)), parts[0].cast("long") * (1 << 24)))


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row for each line that starts with a number; ``valid`` tells whether its first 17 fields parse.

    A field that does not parse is null.  Heading lines, empty lines and nulls are left out."""
    f = F.transform(F.split(line, ","), lambda x: F.trim(x))
    cut = lines.where(F.split(line, ",")[0].try_cast("bigint").isNotNull()).select(f.alias("_f"))
    at = lambda i: F.get("_f", F.lit(i))
    numeric = [at(i).isNotNull() & (at(i) != "") if i in (1, 2) else at(i).try_cast("double").isNotNull() for i in range(NEEDED)]
    valid = numeric[0]
    for n in numeric[1:]:
        valid = valid & n
    half = lambda i, k: F.get(F.split(at(i), "/"), F.lit(k)).try_cast("int")
    out = cut.select(*[(at(i) if t == "string" else at(i).try_cast(t)).alias(n) for i, (n, t) in FIELDS.items()], half(39, 0).alias("syns_a2b"), half(39, 1).alias("fins_a2b"), half(40, 0).alias("syns_b2a"), half(40, 1).alias("fins_b2a"), F.coalesce(valid, F.lit(False)).alias("valid"))
    return out.withColumns({"a_addr": ip_number(F.col("a_ip")), "b_addr": ip_number(F.col("b_ip"))})


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
