"""Inspection tables derived from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SIDE = 8
TOKENS = 4
DEPTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoder_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, clsname, normal, token, enc``: each vector as TOKENS tokens of DEPTH numbers."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("image"),
        F.col("label").alias("clsname"),
        (F.col("vec_id") % 4 != 0).alias("normal"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda t: F.slice("embedding", t * DEPTH + 1, DEPTH))).alias("token", "enc"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, clsname, y, x, pred, gt``: vectors as 8 x 8 maps; the next vector gives the truth."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").alias("clsname"), "embedding")
    n = e.agg(F.count("*").alias("n"))
    truth = e.crossJoin(F.broadcast(n)).select(F.pmod(F.col("image") - 1 + F.col("n"), F.col("n")).alias("image"), F.col("embedding").alias("truth"))
    both = e.join(truth, "image")
    cells = both.select("image", "clsname", F.posexplode(F.arrays_zip("embedding", "truth")).alias("pos", "c"))
    return cells.select(
        "image",
        "clsname",
        F.floor(F.col("pos") / SIDE).cast("int").alias("y"),
        (F.col("pos") % SIDE).alias("x"),
        F.abs("c.embedding").alias("pred"),
        (F.col("c.truth") > F.lit(0.15).cast("float")).cast("int").alias("gt"),
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, clsname, width, height, values``: vectors as 8 x 8 maps, row by row."""
    values = F.transform("embedding", lambda v: F.abs(v))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").alias("clsname"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), values.alias("values"))


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, clsname, source, score, label``: labelled documents as scored images."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("image"), F.col("lang").alias("clsname"), "source", F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ordinal, image_path, clsname, width, height``: parts as images."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image_path"),
        F.col("p_brand").alias("clsname"),
        (8 * F.col("p_size") + 8).alias("width"),
        (4 * F.col("p_size") + 16).alias("height"),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, clsname, score``: events as a stream of scored images."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("clsname"), F.col("value").alias("score"))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ordinal, value``: JSON lines of a source manifest, some of them damaged."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("ordinal"), F.expr(MANIFEST_VALUE).alias("value"))


#: Also valid DuckDB SQL: both sides damage the same lines.
MANIFEST_VALUE = """
CASE WHEN doc_id % 37 = 0 THEN '  ' WHEN doc_id % 41 = 0 THEN '[1, 2]' WHEN doc_id % 53 = 0 THEN '{"filename": ' ELSE concat(
'{"filename": "', CASE WHEN doc_id % 19 = 0 THEN '/abs/' WHEN doc_id % 23 = 0 THEN 'a/../../' WHEN doc_id % 29 = 1 THEN 'a/../' ELSE '' END, source, '/', lang, '/', CASE WHEN doc_id % 11 = 0 THEN 'NG' ELSE 'OK' END, '_', CAST(doc_id % 250 AS STRING), '_C', CAST(doc_id % 5 AS STRING), '_20240101.png"',
', "split": "', CASE WHEN doc_id % 43 = 0 THEN 'val' WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END, '"',
', "clsname": "', CASE WHEN doc_id % 29 = 0 THEN '  ' WHEN doc_id % 59 = 0 THEN 'a/b' ELSE concat(' ', lang) END, '"',
CASE WHEN doc_id % 17 = 0 THEN ', "label": true' WHEN doc_id % 47 = 0 THEN ', "label": 2' WHEN doc_id % 3 = 0 AND toxic IS NULL THEN '' WHEN doc_id % 3 = 0 THEN concat(', "label": ', CAST(toxic AS STRING)) WHEN doc_id % 13 = 0 THEN ', "label": 1' WHEN doc_id % 12 = 1 THEN ', "label": 0.0' WHEN doc_id % 83 = 0 THEN ', "label": 0.5' ELSE ', "label": 0' END,
CASE WHEN doc_id % 31 = 0 THEN ', "roi": [1, 2, 0, 5]' WHEN doc_id % 31 = 1 THEN ', "roi": [1, 2, 3]' WHEN doc_id % 31 = 2 THEN ', "roi": [1, true, 3, 4]' WHEN doc_id % 5 = 0 THEN concat(', "roi": [4, 4, ', CAST(20 + doc_id % 7 * 40 AS STRING), ', 16]') ELSE ', "roi": null' END,
CASE WHEN doc_id % 67 = 0 THEN ', "mask": "/abs/m.bmp"' WHEN doc_id % 3 = 0 AND toxic = 1 OR doc_id % 61 = 0 THEN concat(', "mask": "masks/', CAST(doc_id AS STRING), '.bmp"') ELSE '' END,
CASE WHEN doc_id % 71 = 0 THEN ', "foreground": "../x.tif"' WHEN doc_id % 7 = 0 THEN concat(', "foreground": "fg/', CAST(doc_id AS STRING), '.tif"') ELSE '' END,
'}') END
"""
