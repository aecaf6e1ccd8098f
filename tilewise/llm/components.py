"""Connected components of a link table, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm.shared import stored

MOST_ROUNDS = 60
#: Links that one task joins by itself before the rounds.
BLOCK = 20_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a block of links with the smallest node it reaches inside the block."""
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := least.setdefault(x, x)) != x:
            least[x] = least[up]
            x = least[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = root(u), root(v)
            if p != q:
                least[max(p, q)] = min(p, q)
    pairs = [(x, root(x)) for x in list(least) if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component_id`` (its smallest node) of each node with a link.

    ``edges``: ``u, v``; direction, repeats and self links don't matter. Blocks of bounded
    size are joined inside tasks first; the rounds then join the blocks. Each round is
    written to the shared folder, so no round is computed twice. Nodes stay on the
    executors; the driver only compares a count and a checksum.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    blocks = -(-now.count() // BLOCK)
    now = stored(now.select("u", "v").repartition(max(1, blocks)).mapInArrow(_stars, "u long, v long"), "links")
    if blocks <= 1:
        return _named(now)
    seen = None
    for _ in range(MOST_ROUNDS):
        now = stored(_small_star(_large_star(now)), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return _named(now)
        seen = state
    raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")
