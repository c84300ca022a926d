"""Numbers from a seed, for numbered rows: the same on any number of tasks and in any order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of a linear congruence modulo 2**31, and the multiplier of a 32-bit multiply-with-carry sequence.
TIMES, PLUS, MODULUS = 1103515245, 12345, 1 << 31
CARRY_TIMES = 0xFFFFDA61


def number(row: Column, seed: int = 1, below: int = 1000) -> Column:
    """A number from 0 to ``below`` - 1 for a row number."""
    x = F.pmod(row * TIMES + F.lit(seed * PLUS), F.lit(MODULUS))
    x = F.pmod(x * TIMES + PLUS, F.lit(MODULUS))
    return F.pmod(F.shiftright(x, 8), F.lit(below)).cast("long")


def numbers(spark: SparkSession, n: int, seed: int = 1, below: int = 1000) -> DataFrame:
    """(id, value): ids from 0 to n - 1, values from 0 to ``below`` - 1."""
    return spark.range(n).select("id", number(F.col("id"), seed, below).alias("value"))


def carried(row: Column, seed: int) -> Column:
    """The multiply-with-carry number at a place (from 0) of the sequence that ``seed`` begins, as a signed 32-bit integer.

    The state's low half is multiplied and its high half added.  Such a step is a product modulo CARRY_TIMES * 2**32 - 1, so the state at any place is a power away from
    the seed and no task waits for the numbers before its own.  The seed is from 1 to the modulus; a null or negative place gives null."""
    modulus = (CARRY_TIMES << 32) - 1

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out: list[int | None] = []
            at, x = 0, seed % modulus
            for n in b.to_pylist():
                if n is None or n < 0:
                    out.append(None)
                    continue
                # Rows often follow each other; a step ahead is cheaper than a power of its own.
                x = x * pow(CARRY_TIMES, n + 1 - at, modulus) % modulus if n + 1 >= at else seed * pow(CARRY_TIMES, n + 1, modulus) % modulus
                at = n + 1
                low = x & 0xFFFFFFFF
                out.append(low - (1 << 32) if low >> 31 else low)
            yield pa.array(out, pa.int32())

    return run(row.cast("long"))
