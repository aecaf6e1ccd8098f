"""Source-fair sampling and round-robin assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.operators.ranks import running


def fair_sample(tiles: DataFrame, source: str, tile: str, per_epoch: int, epoch: int, seed: str = "s") -> DataFrame:
    """min(n, per_epoch) tiles of every source; epochs walk through all tiles before any repeats.

    The walk order is a hash of seed, source and tile, so it doesn't depend on partitions;
    ``step`` is a tile's place on the walk of this epoch.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(source).cast("string"), F.col(tile).cast("string")))
    by = W.partitionBy(source)
    ranked = tiles.withColumn("place", F.row_number().over(by.orderBy(key, tile)) - 1).withColumn("n", F.count("*").over(by))
    k = F.least(F.lit(per_epoch), F.col("n"))
    walked = ranked.withColumn("step", F.pmod(F.col("place") - F.lit(epoch * per_epoch), F.col("n")))
    return walked.filter(F.col("step") < k).drop("place", "n")


def epoch_order(sample: DataFrame, source: str, epoch: int, seed: str = "s") -> DataFrame:
    """Adds ``position`` to a fair sample: sources in a random order of the epoch, each with its walk.

    A source's key is a hash of seed, epoch and source. Rows are sorted by ranges of keys and
    counted after the ranges before theirs, so no task holds the order of all.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch).cast("string"), F.col(source).cast("string")))
    placed = running(sample.withColumn("__key", key).withColumn("__one", F.lit(1)), [], ["__key", source, "step"], ["__one"])
    return placed.withColumn("position", F.col("up_to___one") - 1).drop("__key", "__one", "up_to___one", "all___one")


def round_robin(items: DataFrame, order: str, buckets: int, within: str | None = None) -> DataFrame:
    """Adds ``bucket``: items in order are dealt to the buckets in turn.

    With ``within`` each group is dealt apart. Without, rows are sorted by ranges and counted
    inside their range, after the counts of the ranges before: no task sees all rows.
    """
    if within:
        return items.withColumn("bucket", F.pmod(F.row_number().over(W.partitionBy(within).orderBy(order)) - 1, F.lit(buckets)))
    placed = running(items.withColumn("__one", F.lit(1)), [], [order], ["__one"])
    return placed.withColumn("bucket", F.pmod(F.col("up_to___one") - 1, F.lit(buckets))).drop("__one", "up_to___one", "all___one")
