"""Operators on pixel tables ``image, y, x, v``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.operators import bands

#: Channel means and deviations of the public ImageNet statistics (R, G, B).
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def crop(cells: DataFrame, roi: tuple[int, int, int, int]) -> DataFrame:
    """Pixels inside (x, y, w, h), shifted to its origin."""
    x, y, w, h = roi
    inside = cells.filter(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def crop_own(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """Each image's pixels inside its own ROI (``image, roi``: x, y, w, h); without one, all of them."""
    at = lambda k: F.get("roi", F.lit(k))
    joined = cells.join(rois.select("image", "roi"), "image", "left")
    inside = F.col("x").between(at(0), at(0) + at(2) - 1) & F.col("y").between(at(1), at(1) + at(3) - 1)
    moved = joined.filter(F.col("roi").isNull() | inside)
    return moved.withColumn("x", F.col("x") - F.coalesce(at(0), F.lit(0))).withColumn("y", F.col("y") - F.coalesce(at(1), F.lit(0))).select(*cells.columns)


def binarise(cells: DataFrame, high: int = 255) -> DataFrame:
    return cells.withColumn("v", F.when(F.col("v") != 0, high).otherwise(0))


def mask_foreground(cells: DataFrame, foreground: DataFrame) -> DataFrame:
    """Pixels where the foreground is 0 become 0; an image without foreground stays as it is."""
    f = foreground.select("image", "y", "x", F.col("v").alias("f"))
    has = foreground.select("image").distinct().withColumn("has", F.lit(True))
    joined = cells.join(f, ["image", "y", "x"], "left").join(has, "image", "left")
    return joined.withColumn("v", F.when(F.col("has") & (F.coalesce("f", F.lit(0)) == 0), F.lit(0)).otherwise(F.col("v"))).drop("f", "has")


def _grid(sizes: DataFrame, out_w: int, out_h: int) -> DataFrame:
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return sizes.select("image", "width", "height", seq(out_h).alias("oy")).withColumn("ox", seq(out_w))


def resize_nearest(cells: DataFrame, sizes: DataFrame, out_w: int, out_h: int) -> DataFrame:
    at = lambda o, size, n: F.least(F.floor(F.col(o) * F.col(size) / n), F.col(size) - 1).cast("int")
    wanted = _grid(sizes, out_w, out_h).withColumn("y", at("oy", "height", out_h)).withColumn("x", at("ox", "width", out_w))
    return wanted.join(cells, ["image", "y", "x"]).select("image", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def resize_bilinear(cells: DataFrame, sizes: DataFrame, out_w: int, out_h: int, align_corners: bool = False) -> DataFrame:
    """Weighted sum of the four neighbours: half-pixel centres with clamped edges, or corners on corners.

    Pixels are gathered to bands once; maps that are arrays already go to ``bands.resize``.
    """
    return bands.cells_of(bands.resize(bands.from_cells(cells, sizes), out_w, out_h, align_corners))


def normalise(cells: DataFrame, channel: str = "channel") -> DataFrame:
    """(v / 255 - mean) / std by channel 0, 1, 2."""
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col(channel) + 1)
    return cells.withColumn("v", (F.col("v") / 255.0 - of(MEAN)) / of(STD))


def min_max(value: Column, low: float | None, high: float | None) -> Column:
    """(v - low) / (high - low) kept in [0, 1]; the value itself without bounds."""
    if low is None or high is None:
        return value
    return F.least(F.greatest((value - low) / (high - low + 1e-4), F.lit(0.0)), F.lit(1.0))


def display_scale(cells: DataFrame, threshold: str = "threshold") -> DataFrame:
    """Adds ``shown``: clip(v / 2t, 0, 1) for a usable threshold, else min-max per map."""
    by = W.partitionBy("image")
    low, high = F.min("v").over(by), F.max("v").over(by)
    t = F.col(threshold).cast("double")
    usable = t.isNotNull() & ~F.isnan(t) & (t > 0) & (t < float("inf"))
    fixed = F.least(F.greatest(F.col("v") / (2 * t), F.lit(0.0)), F.lit(1.0))
    return cells.withColumn("shown", F.when(usable, fixed).when(high > low, (F.col("v") - low) / (high - low)).otherwise(0.0))


def gaussian_smooth(cells: DataFrame, sizes: DataFrame, sigma: float) -> DataFrame:
    """Two separable passes; indexes beyond an edge are reflected (edge pixel repeated)."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return cells
    halo = len(bands.kernel(sigma)) // 2
    return bands.cells_of(bands.smooth(bands.from_cells(cells, sizes, halo=halo), sigma))
