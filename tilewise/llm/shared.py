"""Where intermediate tables live, and how lineage is cut.

Every table an operator writes goes below the folder that the session names in
``spark.checkpoint.dir``: driver and executors all see it, so a lost executor
never takes the only copy with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.sources.storage import shared_dir, until_exit


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The paths of each ``scratch`` around, outermost first.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())

#: With it, Spark removes the shuffle files of a query when the query ends. Without it they
#: stay until the driver happens to collect garbage, which many short queries rarely cause.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan starts anew there.

    Inside ``scratch`` the table lasts as long as that, or, if it is to be kept, as long
    as the next ``scratch`` around; outside, until the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    temporary(path, keep)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def temporary(path: str, keep: bool = False) -> None:
    """The path goes when the ``scratch`` around ends, or, if kept, the one around that."""
    if around := _scratch.get()[: -1 if keep else None]:
        around[-1].append(path)


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: their readers must be done by then."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            discard(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator needs; extra ones (whatever their names) are left out."""
    return df.select(*[df[f"`{n}`"] for n in names])


def doc_key() -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))


def doc_stamp() -> Column:
    """Hash of id and text: with ``doc_key`` it tells rows apart, other than exact repeats."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))


def named(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, stamp, text`` without null texts."""
    return pick(docs, "doc_id", "text").select("doc_id", doc_key().alias("doc"), doc_stamp().alias("stamp"), F.coalesce("text", F.lit("")).alias("text"))
