"""Times as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; a time without a zone is taken as UTC, whatever the session's zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    since = c.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000}
    plain = sum((F.extract(F.lit(k), since).cast("long") * n for k, n in whole.items()), (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long"))
    return F.when(F.typeof(c) == "timestamp_ntz", plain).otherwise(F.unix_micros(c.cast("timestamp")))
