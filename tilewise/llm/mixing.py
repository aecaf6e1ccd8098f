"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Within its source the documents stand in key
order; prefix sums of their sizes are taken in two levels (key ranges first, then
inside a range), so a source that holds a third of all rows is spread over many
tasks. A source's budget is cut at the exact word: whole epochs first, then the
documents whose prefix lies below the rest, the last of them in part.

Defined cases: null text has size 0 and takes nothing; null source is a source of
its own, ordered last; rows that repeat a doc_id are separate rows (ties on the key
are broken by id and size); null ids get the key of the string ``null``; extra
columns are ignored; an empty table or one without words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.llm.shared import pick, stored

WORD = r"[^\x20\x09-\x0D]+"
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: Rows that a key range of a source should hold, at most.
RANGE_ROWS = 4096


def sized(docs: DataFrame, seed: str = "mix", row: str | None = None) -> DataFrame:
    """``doc_id, source, size, key``: the key is a uniform hexadecimal string.

    With ``row``, the name of a column that tells rows apart, that column stays too, and
    the key hashes id and text: rows that share an id (or have none) are spread.
    """
    own = [row] if row else []
    d = pick(docs, "doc_id", "source", "text", *own)
    salt = [F.lit(":"), F.xxhash64("text").cast("string")] if row else []
    return d.select(
        *own,
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *salt)).alias("key"),
    )


def source_targets(rows: DataFrame) -> DataFrame:
    """One row per source: ``rank, source_size, n_rows, target``.

    Water filling: sources are capped at MOST_EPOCHS times their size in the order of
    size over weight; what they can't take is reshared by weight among the others.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weighed = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("ratio", F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    left = weighed.withColumn("rest", F.sum("source_size").over(whole) - MOST_EPOCHS * F.coalesce(F.sum("source_size").over(order), F.lit(0))).withColumn(
        "weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    )
    capped = left.withColumn("capped", MOST_EPOCHS * big("source_size") * big("weights") <= big("weight") * big("rest"))
    level = capped.withColumn("k", F.when(~F.col("capped"), F.struct("ratio", "rank", "rest", "weights")))
    free = level.withColumn("open", F.min("k").over(whole))
    target = F.when(F.col("capped"), (MOST_EPOCHS * F.col("source_size")).cast("double")).otherwise((F.col("open.rest") * F.col("weight")).cast("double") / F.col("open.weights"))
    return free.select("source", "rank", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", row: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document; with ``row`` (see ``sized``) that column too."""
    own = [row] if row else []
    rows = stored(sized(docs, seed, row), "mix-sized")
    targets = stored(source_targets(rows), "mix-targets")
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_rows") / RANGE_ROWS) / F.log(F.lit(16.0)))).cast("int")
    t = targets.withColumn("digits", digits).withColumnRenamed("source", "t_source")
    keyed = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source", "source").withColumn("range", F.expr("substr(key, 1, digits)"))
    before = W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = keyed.groupBy("rank", "range").agg(F.sum("size").alias("range_size")).select("rank", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("rank", "range").orderBy("key", "doc_id", "size", *own).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(ranges, ["rank", "range"])
    start = F.col("range_start") + F.col("upto") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .select(*own, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents as often as the mix takes them (a part counts as once more).

    Rows are numbered and stored first, so each row has its own share, also where ids
    repeat or are null; equal rows share a key and hence a task of the mix.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    share = mix(rows, seed, "__row").filter("taken > 0").select("__row", F.expr("ceil(taken / size)").cast("int").alias("__copies"))
    return rows.join(share, "__row").withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__row", "__copies")
