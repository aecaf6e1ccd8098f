"""Stitching tile maps to image maps, and merging the results of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.functions.vectors import hann_weight
from tilewise.operators import bands


def tile_cells(tiles: DataFrame, cells: DataFrame, patch_w: int, patch_h: int | None = None, edge: str = "replicate") -> DataFrame:
    """``image, tile_id, ty, tx, v``: the pixels of each tile, overhang included.

    Pixels are gathered to bands once and tiles are cut from rows. Overhang repeats the edge
    (images) or is 0 (masks, ``edge="zero"``).
    """
    sizes = tiles.select("image", "width", "height").distinct()
    rows = bands.tile_rows(tiles, bands.from_cells(cells, sizes, halo=0), patch_w, patch_h or patch_w, edge)
    return rows.select("image", "tile_id", "ty", F.posexplode("row").alias("tx", "v"))


def overlap_add(tile_maps: DataFrame, patch_w: int | str, patch_h: int | str | None = None) -> DataFrame:
    """``image, y, x, v``: weighted mean of the tiles that cover a pixel.

    ``tile_maps``: ``image, x, y, valid_w, valid_h, ty, tx, v``; the patch sizes are numbers,
    or columns where tiles differ. Sums are partial on the map side; the shuffle carries one
    row per pixel and task. Tiles that are rows of arrays go to ``bands.overlap_add``.
    """
    size = lambda p: F.lit(p) if isinstance(p, int) else F.col(p)
    inside = tile_maps.filter((F.col("tx") < F.col("valid_w")) & (F.col("ty") < F.col("valid_h")))
    w = 0.05 + 0.95 * hann_weight(F.col("ty"), size(patch_w if patch_h is None else patch_h)) * hann_weight(F.col("tx"), size(patch_w))
    rows = inside.select("image", (F.col("y") + F.col("ty")).alias("y"), (F.col("x") + F.col("tx")).alias("x"), w.alias("w"), F.col("v").cast("double").alias("v"))
    return rows.groupBy("image", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).cast("float").alias("v"))


def coverage_gaps(sizes: DataFrame, stitched: DataFrame) -> DataFrame:
    """Pixels of an image that no tile covered: none, if the tiling is sound."""
    grid = sizes.select("image", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width").select("image", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return grid.join(stitched.select("image", "y", "x"), ["image", "y", "x"], "left_anti")


def fuse_max(stitched: DataFrame, thumbnail: DataFrame) -> DataFrame:
    """Per pixel the larger of the stitched and the thumbnail map, where there is one."""
    t = thumbnail.select("image", "y", "x", F.col("v").alias("t"))
    return stitched.join(t, ["image", "y", "x"], "left").select("image", "y", "x", F.greatest("v", "t").alias("v"))


def unmatched_predictions(records: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Records without a prediction and predictions without a record: must be empty."""
    a = records.select(*keys, F.lit(1).alias("a"))
    b = predictions.select(*keys, F.lit(1).alias("b"))
    return a.join(b, keys, "full_outer").filter("a IS NULL OR b IS NULL").select(*keys, F.when(F.col("a").isNull(), "no record").otherwise("no prediction").alias("fault"))


def join_predictions(records: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    return records.join(predictions, keys)


def merge_tasks(patches: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """``image, n_patches, n_thumbnails, score, fault``: task results of each image in one row.

    A sound image has patches, at most one thumbnail, and one size on both sides.
    """
    both = patches.withColumn("kind", F.lit("patch")).unionByName(thumbnails.withColumn("kind", F.lit("thumbnail")), allowMissingColumns=True)
    merged = both.groupBy("image").agg(
        F.count_if(F.col("kind") == "patch").alias("n_patches"),
        F.count_if(F.col("kind") == "thumbnail").alias("n_thumbnails"),
        F.count_distinct("width", "height").alias("n_sizes"),
        F.max("score").alias("score"),
    )
    fault = F.when(F.col("n_patches") == 0, "no patches").when(F.col("n_thumbnails") > 1, "several thumbnails").when(F.col("n_sizes") != 1, "sizes differ")
    return merged.withColumn("fault", fault).drop("n_sizes")
