"""Decisions from thresholds, and the prediction records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.operators.calibrate import lookup


def decide_images(images: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds thresholds and ``is_defect``: strictly above the threshold, in 32 bits.

    Serves batches and streams alike (a stream joins the stored calibration).
    """
    return lookup(images, calibration).withColumn("is_defect", F.col("score").cast("float") > F.col("threshold"))


def decide_pixels(cells: DataFrame, value: str = "pred", threshold: str = "pixel_threshold") -> DataFrame:
    """Adds ``is_anomalous``: at or above the pixel threshold, whatever the image's decision."""
    return cells.withColumn("is_anomalous", F.col(value).cast("float") >= F.col(threshold).cast("float"))


def anomaly_pixels(decided: DataFrame, keys: list[str]) -> DataFrame:
    return decided.groupBy(*keys).agg(F.count_if("is_anomalous").alias("anomaly_pixel_count"))


def mask_name(ordinal: str = "ordinal", path: str = "filename"):
    """``masks/{ordinal:06d}_{stem}.png``."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(.)\.[^.]*$", "$1")
    return F.format_string("masks/%06d_%s.png", F.col(ordinal), stem)


#: Keys that a prediction leaves out where it has no value.
OPTIONAL = ("threshold", "is_defect", "pixel_threshold", "prediction_mask", "anomaly_pixel_count")


def prediction_json(predictions: DataFrame) -> DataFrame:
    """``ordinal, value``: one JSON object per image; label keys stay even if null."""
    fixed = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.col(k).cast("variant")), F.lit("null"))) for k in ("filename", "clsname", "label", "label_name", "score")]
    extra = [F.concat(F.lit(f'"{k}":'), F.to_json(F.col(k).cast("variant"))) for k in OPTIONAL if k in predictions.columns]
    return predictions.select("ordinal", F.concat(F.lit("{"), F.array_join(F.array(*fixed, *extra), ","), F.lit("}")).alias("value"))


def mask_rows(decided: DataFrame, keys: list[str], value: str = "is_anomalous") -> DataFrame:
    """``y, bits`` of each mask: a string of 0 and 1 for each row of pixels, from the left."""
    bit = F.struct("x", F.when(F.col(value), "1").otherwise("0").alias("b"))
    return decided.groupBy(*keys, "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(bit)), lambda s: s["b"]), "").alias("bits"))


def write_masks(masks: DataFrame, path: str) -> None:
    """The mask table: one row for each mask and row of pixels; masks of any size stay spread."""
    masks.write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines in manifest order."""
    prediction_json(predictions).orderBy("ordinal").select("value").write.mode("overwrite").text(path)
