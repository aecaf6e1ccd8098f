"""Decisions on a stream of image scores with stored thresholds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tilewise.operators.decide import decide_images


def score_stream(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet files of scores that arrive below ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def decide_stream(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """The batch rule on a stream: a stateless join to the stored calibration."""
    return decide_images(scores, calibration)


def write_decisions(decided: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append decisions to Parquet; runs through what is there and stops."""
    return decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decide_arrivals(arrivals: Iterable[DataFrame], calibration: DataFrame, root: str) -> DataFrame:
    """Decisions on scores that arrive in turn: each arrival is a start of the stream of its own.

    Arrivals are appended to ``root/scores`` as they come. Every start takes up the checkpoint of
    the one before, so it decides what is new and writes each decision once; the sink's own log
    says which of its files count.
    """
    spark, schema = calibration.sparkSession, None
    for rows in arrivals:
        schema = schema or rows.schema
        rows.write.mode("append").parquet(f"{root}/scores")
        decided = decide_stream(score_stream(spark, f"{root}/scores", schema), calibration)
        write_decisions(decided, f"{root}/decisions", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/decisions")
