"""Written intermediate tables, whose readers start at a file, and small files swapped at once.

Files are reached through the file systems that Spark knows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of each application that names none; its settings can't be changed any more.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a session whose tasks run in the driver's own process gets a folder
    beside it; on a cluster, executors wouldn't see that folder, so it is an error there.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the table goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def until_exit(spark: SparkSession, path: str) -> None:
    """The path is deleted when the driver's process ends: plans may read it until then."""
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder; nothing if there is none."""
    where, fs = _place(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Make ``text`` the content of a file: written beside it, then renamed over it in one step."""
    where, fs = _place(spark, path)
    beside, _ = _place(spark, f"{path}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    qualified = [p.makeQualified(fs.getUri(), fs.getWorkingDirectory()) for p in (beside, where)]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(*qualified, how)
