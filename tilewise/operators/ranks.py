"""Ranks, running sums and exact quantiles of groups of any size.

Rows are dealt by ranges of (keys, order) and written; a group of very many rows thus spans
many ranges. Sums of whole ranges are a few rows per group, and their prefix sums say what
stands before each range. A running sum is then the sum before the range plus that inside it,
and a wanted rank lies in one range, which alone is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.sources.storage import stored

RANGE = "range_id"


def _join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join in which null keys are groups like others."""
    renamed = right.withColumnsRenamed({n: f"__{n}" for n in names})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])).drop(*[f"__{n}" for n in names])


def ranges(rows: DataFrame, keys: list[str], order: list[str | Column], sums: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their range, and for each group and range the sums before it and of the group.

    The second table has ``before_{sum}`` and ``all_{sum}``; a window task sees the ranges of a
    group, whose number doesn't grow with the rows of a range.
    """
    ranged = stored(rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")
    own = ranged.groupBy(*keys, RANGE).agg(*[F.sum(s).alias(s) for s in sums])
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    starts = own.select(
        *keys, RANGE, *sums,
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"before_{s}") for s in sums],
        *[F.sum(s).over(W.partitionBy(*keys)).alias(f"all_{s}") for s in sums],
    )
    return ranged, starts


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: list[str]) -> DataFrame:
    """Adds ``up_to_{sum}`` (this row included, in order) and ``all_{sum}`` of the row's group.

    Rows of a group that are equal in ``order`` have no order among themselves.
    """
    ranged, starts = ranges(rows, keys, order, sums)
    inside = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = ranged.withColumns({f"up_to_{s}": F.sum(s).over(inside) for s in sums})
    joined = _join(counted, starts.drop(*sums), [*keys, RANGE])
    return joined.select(*rows.columns, *[(F.col(f"up_to_{s}") + F.col(f"before_{s}")).alias(f"up_to_{s}") for s in sums], *[f"all_{s}" for s in sums])


def quantiles(values: DataFrame, keys: list[str], share: str = "share") -> DataFrame:
    """``keys, quantile``: of each group's numbers ``value``, the linearly interpolated quantile.

    ``share``: column with the group's p in [0, 1]. Nulls don't count; NaN is the largest
    number; a group without numbers has no row. Equal values are counted first, then only
    the ranges that hold one of the two ranks around p * (n - 1) are read in order.
    """
    counts = values.filter("value IS NOT NULL").groupBy(*keys, share, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    group = [*keys, share]
    ranged, starts = ranges(counts, group, ["value"], ["n"])
    place = F.col(share) * (F.col("all_n") - 1)
    wanted = starts.select(*group, RANGE, "before_n", place.alias("place"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank"), F.col("n").alias("held"))
    wanted = wanted.filter("rank >= before_n AND rank < before_n + held").groupBy(*group, RANGE, "before_n", "place").agg(F.collect_set("rank").alias("ranks"))
    some = _join(ranged, wanted, [*group, RANGE])
    inside = W.partitionBy(*group, RANGE).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = some.withColumn("end", F.col("before_n") + F.sum("n").over(inside)).withColumn("begin", F.col("end") - F.col("n"))
    held = placed.select(*keys, "value", "place", F.explode("ranks").alias("rank"), "begin", "end").filter("rank >= begin AND rank < end")
    low, high = F.min(F.struct("rank", "value")), F.max(F.struct("rank", "value"))
    ends = held.groupBy(*keys).agg(low.alias("low"), high.alias("high"), F.first("place").alias("place"))
    inner = (F.col("high.rank") - F.col("place")) * F.col("low.value") + (F.col("place") - F.col("low.rank")) * F.col("high.value")
    same = (F.col("low.rank") == F.col("high.rank")) | (F.col("low.value") == F.col("high.value"))
    return ends.select(*keys, F.when(same, F.col("low.value")).otherwise(inner).alias("quantile"))
