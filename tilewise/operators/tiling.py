"""Tiles of images: edge-aligned regions, several scales, thumbnails, enclosing tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pair = int | tuple[int, int]


def pair(value: Pair) -> tuple[int, int]:
    return (value, value) if isinstance(value, int) else value


def check_spec(patch: Pair, stride: Pair | None, factors: list[int]) -> None:
    """The argument contract of tiling."""
    for p, s in zip(pair(patch), pair(patch if stride is None else stride), strict=True):
        if p <= 0 or p % 16:
            raise ValueError("patch sizes must be positive multiples of 16")
        if not 1 <= s <= p:
            raise ValueError("a stride must lie between 1 and the patch size")
    if not factors or factors[0] != 0 or factors != sorted(set(factors)) or min(factors) < 0:
        raise ValueError("factors must be distinct, sorted, non-negative and start at 0")


def starts(size: Column, patch: Column, stride: Column) -> Column:
    """0, s, 2s, ... below the size; what would overhang is pulled back; each start once."""
    moved = F.array_distinct(F.transform(F.sequence(F.lit(0), size - 1, stride), lambda s: F.least(s, size - patch)))
    return F.when(size <= patch, F.array(F.lit(0))).otherwise(moved)


def tiles(images: DataFrame, patch: Pair, stride: Pair | None = None, factors: tuple[int, ...] = (0,)) -> DataFrame:
    """A row per tile: the image's columns, ``scale, tile_id, x, y, w, h, valid_w, valid_h``.

    Tiles stand in row-major order; at scale f patch and stride are 2**f times as large.
    """
    check_spec(patch, stride, list(factors))
    (pw, ph), (sw, sh) = pair(patch), pair(patch if stride is None else stride)
    scaled = images.withColumn("scale", F.explode(F.array(*[F.lit(f) for f in factors])))
    by = lambda v: F.shiftleft(F.lit(v), 0) * F.pow(F.lit(2), F.col("scale")).cast("int")
    placed = scaled.withColumn("w", by(pw)).withColumn("h", by(ph)).withColumn("xs", starts(F.col("width"), by(pw), by(sw))).withColumn("ys", starts(F.col("height"), by(ph), by(sh)))
    rows = placed.select("*", F.posexplode("ys").alias("row", "y")).select("*", F.posexplode("xs").alias("col", "x"))
    return rows.select(
        *images.columns, "scale", (F.col("row") * F.size("xs") + F.col("col")).alias("tile_id"), "x", "y", "w", "h",
        F.least("w", F.col("width") - F.col("x")).alias("valid_w"), F.least("h", F.col("height") - F.col("y")).alias("valid_h"),
    )


def thumbnails(images: DataFrame, size: Pair) -> DataFrame:
    """One row per image: the model sees the whole image at ``size``."""
    w, h = pair(size)
    return images.withColumn("task", F.lit("thumbnail")).withColumn("model_w", F.lit(w)).withColumn("model_h", F.lit(h))


def tile_records(images: DataFrame, patch: Pair, stride: Pair | None, thumbnail: Pair | None) -> DataFrame:
    """Tile and thumbnail records in one table; thumbnails have no region."""
    w, h = pair(patch)
    rows = tiles(images, patch, stride).drop("scale").withColumn("task", F.lit("dynamic_patch")).withColumn("model_w", F.lit(w)).withColumn("model_h", F.lit(h))
    return rows if thumbnail is None else rows.unionByName(thumbnails(images, thumbnail), allowMissingColumns=True)


def enclosing_start(start: Column, size: Column, patch: int, stride: int, factor: Column) -> Column:
    """Start of the first coarser region (along one axis) that holds a main region.

    A closed form instead of a range join: the first regular start at or beyond
    start + patch - big patch, pulled back to the edge.
    """
    big_p, big_s = factor * patch, factor * stride
    first = F.ceil(F.greatest(start + patch - big_p, F.lit(0)) / big_s).cast("int") * big_s
    return F.when(size <= big_p, F.lit(0)).otherwise(F.least(first, size - big_p))


def with_contexts(main: DataFrame, patch: Pair, stride: Pair, factors: tuple[int, ...]) -> DataFrame:
    """A row per main tile and coarser scale: the enclosing tile ``cx, cy, cw, ch``."""
    (pw, ph), (sw, sh) = pair(patch), pair(stride)
    rows = main.withColumn("context_scale", F.explode(F.array(*[F.lit(f) for f in factors if f])))
    k = F.pow(F.lit(2), F.col("context_scale")).cast("int")
    return (
        rows.withColumn("cx", enclosing_start(F.col("x"), F.col("width"), pw, sw, k))
        .withColumn("cy", enclosing_start(F.col("y"), F.col("height"), ph, sh, k))
        .withColumn("cw", k * pw)
        .withColumn("ch", k * ph)
    )


def context_index(contexts: DataFrame, model_w: int, model_h: int) -> DataFrame:
    """Adds where the main tile lies in the resized context tile (truncated to integers)."""
    put = lambda a, b, size, model: F.expr(f"CAST(({a} - {b}) / {size} * {model} AS INT)")
    return (
        contexts.withColumn("ix", put("x", "cx", "cw", model_w))
        .withColumn("iy", put("y", "cy", "ch", model_h))
        .withColumn("iw", F.expr(f"CAST(w / cw * {model_w} AS INT)"))
        .withColumn("ih", F.expr(f"CAST(h / ch * {model_h} AS INT)"))
    )


INDEX = "struct<x:int,y:int,width:int,height:int>"


def index_to_json(x: str, y: str, w: str, h: str) -> Column:
    return F.to_json(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).alias("width"), F.col(h).alias("height")))


def index_from_json(column: str) -> Column:
    return F.from_json(F.col(column), INDEX)
