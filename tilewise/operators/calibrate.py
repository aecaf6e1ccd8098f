"""Thresholds from normal data: quantiles, global and per category."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.operators.ranks import quantiles
from tilewise.sources.storage import names, remove, swap


def check_percentile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a percentile must lie strictly between 0 and 1")
    return p


def map_quantile(cells: DataFrame, p: float, keys: list[str], value: str = "pred") -> DataFrame:
    """One number per anomaly map: the quantile of its pixels, linearly interpolated."""
    return cells.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.lit(check_percentile(p))).alias("pixel_stat"))


def calibrate(normals: DataFrame, score_p: float, pixel_p: float | None = None) -> DataFrame:
    """``clsname (null: global), normal_image_count, threshold, pixel_threshold``.

    ``normals``: ``clsname, score`` and, for pixel thresholds, ``pixel_stat``. The quantiles
    are exact and spread: the global group, like a category of very many images, is read by
    ranges of values. Rows without a category count in the global group only.
    """
    rows = normals if "pixel_stat" in normals.columns else normals.withColumn("pixel_stat", F.lit(None).cast("double"))
    measures = {"threshold": ("score", check_percentile(score_p)), "pixel_threshold": ("pixel_stat", check_percentile(pixel_p or score_p))}
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(p).alias("share"), F.col(c).cast("double").alias("value")) for m, (c, p) in measures.items()])
    groups = F.array(F.struct(F.lit(True).alias("is_global"), F.lit(None).cast(normals.schema["clsname"].dataType).alias("clsname")), F.struct(F.lit(False).alias("is_global"), F.col("clsname")))
    keyed = rows.select(F.explode(groups).alias("g"), listed.alias("m")).select("g.is_global", "g.clsname", "m").filter("is_global OR clsname IS NOT NULL")
    values = keyed.select("is_global", "clsname", F.explode("m").alias("m")).select("is_global", "clsname", "m.*")
    found = quantiles(values, ["is_global", "clsname", "measure"])
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("quantile"))).alias(m)
    wide = found.groupBy("is_global", F.col("clsname").alias("of")).agg(*[of(m) for m in measures])
    counted = keyed.groupBy("is_global", "clsname").agg(F.count("*").alias("normal_image_count"))
    if_empty = normals.sparkSession.range(1).select(F.lit(True).alias("is_global"), F.lit(None).cast(normals.schema["clsname"].dataType).alias("clsname"), F.lit(0).cast("long").alias("normal_image_count"))
    counted = counted.unionByName(if_empty).groupBy("is_global", "clsname").agg(F.sum("normal_image_count").alias("normal_image_count"))
    joined = counted.join(wide, (counted["is_global"] == wide["is_global"]) & counted["clsname"].eqNullSafe(wide["of"]), "left")
    return joined.select("clsname", "normal_image_count", *measures)


def lookup(images: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds 32-bit ``threshold`` and ``pixel_threshold``: the category's, else the global ones.

    The calibration has one row per category; Spark broadcasts it where it is small.
    """
    of_class = calibration.filter("clsname IS NOT NULL").select("clsname", F.col("threshold").alias("t"), F.col("pixel_threshold").alias("pt"))
    overall = calibration.filter("clsname IS NULL").agg(F.first("threshold").alias("gt"), F.first("pixel_threshold").alias("gpt"))
    joined = images.join(of_class, "clsname", "left").crossJoin(F.broadcast(overall))  # overall is one row
    # without a global pixel threshold there is none at all
    pixel = F.when(F.col("gpt").isNotNull(), F.coalesce("pt", "gpt"))
    return joined.withColumn("threshold", F.coalesce("t", "gt").cast("float")).withColumn("pixel_threshold", pixel.cast("float")).drop("t", "pt", "gt", "gpt")


POINTER = "CURRENT"
#: Versions that stay beside the current one, for readers that have begun.
KEPT = 2


def save(calibration: DataFrame, path: str) -> None:
    """Store a calibration below ``path``: a new version, then a pointer that is swapped at once.

    A write that fails on the way leaves the pointer, and so the calibration before, as it was;
    a reader sees either the old or the new one, never a part.
    """
    spark = calibration.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    calibration.coalesce(1).write.parquet(f"{path}/versions/{version}")
    swap(spark, f"{path}/{POINTER}", version)
    older = sorted(x for x in names(spark, f"{path}/versions") if x < version)
    for x in older[: max(0, len(older) - KEPT)]:
        remove(spark, f"{path}/versions/{x}")


def load(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """The current calibration; without one an error, or None if it isn't required.

    Also reads older stores, which are one Parquet folder and may lack pixel thresholds.
    """
    held = names(spark, path)
    if POINTER in held:
        rows = spark.read.parquet(f"{path}/versions/{spark.read.text(f'{path}/{POINTER}').first().value}")
    elif any(x.endswith(".parquet") for x in held):
        rows = spark.read.parquet(path)
    elif required:
        raise FileNotFoundError(f"no calibration at {path}")
    else:
        return None
    return rows if "pixel_threshold" in rows.columns else rows.withColumn("pixel_threshold", F.lit(None).cast("double"))


def export_json(calibration: DataFrame) -> DataFrame:
    """One row ``value``: the calibration as a JSON object with sorted categories."""
    own = F.col("clsname").isNotNull()
    entry = F.struct(F.col("clsname").cast("string").alias("key"), F.struct("normal_image_count", "pixel_threshold", "threshold").alias("value"))
    return calibration.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(own, entry)))).alias("categories"),
        F.max(F.when(~own, F.col("pixel_threshold"))).alias("global_pixel_threshold"),
        F.max(F.when(~own, F.col("threshold"))).alias("global_threshold"),
        F.max(F.when(~own, F.col("normal_image_count"))).alias("normal_image_count"),
    ).select(F.to_json(F.struct("categories", "global_pixel_threshold", "global_threshold", "normal_image_count")).alias("value"))
