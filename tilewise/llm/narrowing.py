"""Thinning a large table before a join, with a broadcast of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap has so many bits (512 KB), whatever the tables hold.
BITS = 1 << 22


def marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, Column]:
    """``rows`` with a bitmap word joined on, and the test of its bit.

    The test is true for every row whose (hash) key is among the wanted ones, and for a
    share of others that grows with the number wanted; an exact join must follow. It
    only spares the others the shuffle.
    """
    bit = F.pmod(F.col(wanted_key), F.lit(BITS))
    words = wanted.select(F.floor(bit / 32).cast("int").alias("__word"), F.pmod(bit, F.lit(32)).cast("int").alias("bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__bits"))
    own = F.pmod(F.col(key), F.lit(BITS))
    joined = rows.withColumn("__word", F.floor(own / 32).cast("int")).join(F.broadcast(words), "__word", "left").drop("__word")
    test = F.coalesce(F.expr(f"(shiftright(__bits, CAST(pmod(pmod({key}, {BITS}), 32) AS INT)) & 1L) = 1"), F.lit(False))
    return joined, test
