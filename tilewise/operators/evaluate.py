"""Evaluation per category: curves, areas, best thresholds, gates and the report."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.operators.ranks import running

BINS = 65_536


def binary_curve(rows: DataFrame, key: str = "clsname") -> DataFrame:
    """``clsname, score, tp, fp, tpr, fpr, precision, tpr0, fpr0`` at each distinct score, from the top.

    Equal scores are collapsed first; the counts from the top are prefix sums over ranges of
    scores, so no task sees a whole category. ``tpr0, fpr0``: the rates before that score.
    """
    ties = rows.groupBy(key, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    c = running(ties, [key], [F.desc("score")], ["p", "n"]).filter("all_p > 0 AND all_n > 0")
    tp, fp = F.col("up_to_p"), F.col("up_to_n")
    rates = [(tp / F.col("all_p")).alias("tpr"), (fp / F.col("all_n")).alias("fpr"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision")]
    return c.select(key, "score", tp.alias("tp"), fp.alias("fp"), *rates, ((tp - F.col("p")) / F.col("all_p")).alias("tpr0"), ((fp - F.col("n")) / F.col("all_n")).alias("fpr0"))


def auroc(curve: DataFrame, key: str = "clsname", name: str = "image_auroc") -> DataFrame:
    """Area under the curve by trapezoids from (0, 0)."""
    area = (F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2
    return curve.groupBy(key).agg(F.sum(area).alias(name))


def youden_threshold(curve: DataFrame, key: str = "clsname") -> DataFrame:
    """The score with the largest tpr - fpr; of equals, the highest."""
    return curve.groupBy(key).agg(F.max_by("score", F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), F.col("score"))).alias("image_threshold"))


def image_metrics(rows: DataFrame) -> DataFrame:
    curve = binary_curve(rows)
    return auroc(curve).join(youden_threshold(curve), "clsname")


def annotation_gates(rows: DataFrame, key: str = "clsname", label: str = "label", mask: str = "mask") -> DataFrame:
    """``image_ready, pixel_ready``: whether labels and masks are complete enough for metrics."""
    per = rows.groupBy(F.coalesce(key, F.lit("default")).alias(key)).agg(
        (F.array_sort(F.collect_set(label)) == F.array(F.lit(0), F.lit(1))).alias("both"),
        F.bool_and(F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("clean"),
        F.bool_and(F.coalesce((F.col(label) == 0) | (F.coalesce(F.col(mask), F.lit("")) != ""), F.lit(False))).alias("masked"),
    )
    ready = F.coalesce(F.bool_and(F.col("both") & F.col("clean")), F.lit(False))
    return per.agg(ready.alias("image_ready"), (ready & F.coalesce(F.bool_and("masked"), F.lit(False))).alias("pixel_ready"))


def pixel_pairs(pred: DataFrame, truth: DataFrame, pred_sizes: DataFrame | None = None, truth_sizes: DataFrame | None = None) -> DataFrame:
    """``image, clsname, y, x, pred, gt``: predictions with truth; no mask means all zero.

    With the sizes of maps and masks (``image, width, height``), an image whose mask has another
    size than its map fails the job; without them only pixels that masks lack are zero.
    """
    if pred_sizes is not None and truth_sizes is not None:
        other = size_faults(pred_sizes, truth_sizes).select("image", F.concat_ws(" ", F.lit("a mask of"), "truth_size", F.lit("for a map of"), "pred_size").alias("fault"))
        marked = pred.join(other, "image", "left")
        sound = F.when(F.col("fault").isNull(), F.col("pred")).otherwise(F.raise_error(F.col("fault")).cast(pred.schema["pred"].dataType))
        pred = marked.withColumn("pred", sound).drop("fault")
    t = truth.select("image", "y", "x", (F.col("gt") != 0).cast("int").alias("gt"))
    return pred.join(t, ["image", "y", "x"], "left").select("image", "clsname", "y", "x", "pred", F.coalesce("gt", F.lit(0)).alias("gt"))


def size_faults(pred_sizes: DataFrame, truth_sizes: DataFrame) -> DataFrame:
    """``image, pred_size, truth_size`` where the sizes of map and mask differ."""
    size = lambda t, name: t.select("image", F.concat_ws("x", "width", "height").alias(name))
    return size(pred_sizes, "pred_size").join(size(truth_sizes, "truth_size"), "image").filter("pred_size <> truth_size")


def shape_faults(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``size_faults`` of pixel tables that list every pixel: sizes are read off the pixels.

    An image without a mask has none to compare; its truth is all zero.
    """
    size = lambda t: t.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return size_faults(size(pred), size(truth))


def label_or_mask(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``image, label``: the given label, else whether its mask has any pixel."""
    seen = pairs.groupBy("image").agg(F.max("gt").alias("seen"))
    return seen.join(labels.select("image", "label"), "image", "left").select("image", F.coalesce("label", "seen").cast("int").alias("label"))


def pixel_histogram(pairs: DataFrame, bins: int = BINS, key: str = "clsname") -> DataFrame:
    """``clsname, lo, hi, bin, pos, neg``: counts per score bin, all arithmetic in 32 bits.

    At most ``bins`` rows per category leave the aggregation, however many pixels it has.
    """
    bounds = pairs.groupBy(key).agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"))
    scale = (F.lit(float(bins)).cast("float") / (F.col("hi") - F.col("lo")).cast("float")).cast("float")
    raw = ((F.col("pred") - F.col("lo")).cast("float") * scale).cast("float").cast("bigint")
    binned = pairs.join(bounds, key).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(bins - 1)).cast("bigint"))
    return binned.groupBy(key, "lo", "hi", "bin").agg(F.count_if(F.col("gt") == 1).alias("pos"), F.count_if(F.col("gt") == 0).alias("neg"))


def pixel_curve(histogram: DataFrame, bins: int = BINS, key: str = "clsname") -> DataFrame:
    """``clsname, bin, edge, tpr, fpr, precision, tpr0, fpr0``: cumulative from the highest bin.

    A category has at most ``bins`` rows here, whatever its pixels.
    """
    down = W.partitionBy(key).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    c = histogram.select(key, "bin", "lo", "hi", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    edge = F.col("lo").cast("double") + F.col("bin") * ((F.col("hi").cast("double") - F.col("lo").cast("double")) / bins)
    return c.filter("p > 0 AND n > 0").select(
        key, "bin", edge.alias("edge"), (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        ((F.col("tp") - F.col("pos")) / F.col("p")).alias("tpr0"), ((F.col("fp") - F.col("neg")) / F.col("n")).alias("fpr0"),
    )


def average_precision(curve: DataFrame, key: str = "clsname") -> DataFrame:
    return curve.groupBy(key).agg(F.sum((F.col("tpr") - F.col("tpr0")) * F.col("precision")).alias("pixel_ap"))


def best_f1(curve: DataFrame, key: str = "clsname") -> DataFrame:
    """The largest F1 and its threshold (left edge of the bin); of equals, the highest bin."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")), F.lit(0.0))
    best = curve.withColumn("f1", F.round(f1, 12)).groupBy(key).agg(F.max("f1").alias("pixel_f1"), F.max_by("edge", F.struct("f1", "bin")).alias("pixel_threshold"))
    return best


def pixel_metrics(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    curve = pixel_curve(pixel_histogram(pairs, bins), bins)
    return auroc(curve, name="pixel_auroc").join(average_precision(curve), "clsname").join(best_f1(curve), "clsname")


Metric = Callable[[DataFrame], DataFrame]


def metrics_by_category(rows: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """Joins the metric tables of each category; clashing metric names are an error."""
    out, seen = None, set()
    for name, f in metrics.items():
        m = f(rows)
        clash = seen & set(m.columns) - {"clsname"}
        if clash:
            raise ValueError(f"{name}: metric names {sorted(clash)} exist already")
        seen |= set(m.columns)
        out = m if out is None else out.join(m, "clsname", "full_outer")
    return out.orderBy("clsname")


def python_metric(f: Callable[[pd.DataFrame], dict], schema: str) -> Metric:
    """A user's Python metric that needs all rows of a category at once, in one task.

    For categories of any size, a metric should be mergeable: see ``mergeable_metric``.
    """

    def per_category(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"clsname": rows["clsname"].iloc[0], **f(rows)}])

    return lambda rows: rows.groupBy("clsname").applyInPandas(per_category, f"clsname string, {schema}")


#: States of a category that one task merges at a time.
FAN_IN = 64


class Mergeable(Protocol):
    """A metric as a state that grows by rows and by other states; states are pickled."""

    def update(self, state: object | None, rows: pd.DataFrame) -> object: ...

    def merge(self, a: object, b: object) -> object: ...

    def finish(self, state: object) -> dict: ...


def mergeable_metric(metric: Mergeable, schema: str, levels: int = 2) -> Metric:
    """A user's metric as partial aggregation: no task sees more of a category than its own rows.

    Each task folds its batches into one state per category; states are merged in groups of
    FAN_IN, level by level, and finished once. What the metric raises fails the job.
    """

    def updated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for b in batches:
            for name, rows in b.groupby("clsname", dropna=False, sort=False):
                key = None if pd.isna(name) else name
                states[key] = metric.update(states.get(key), rows)
        yield pd.DataFrame({"clsname": pd.Series(list(states), dtype=object), "part": TaskContext.get().partitionId(), "state": [pickle.dumps(s) for s in states.values()]})

    def merged(rows: pd.DataFrame) -> object:
        return reduce(metric.merge, [pickle.loads(s) for s in rows.sort_values("part")["state"]])

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"clsname": rows["clsname"].iloc[0], "part": int(rows["part"].min()) // FAN_IN, "state": pickle.dumps(merged(rows))}])

    def all_of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"clsname": rows["clsname"].iloc[0], **metric.finish(merged(rows))}])

    def run(rows: DataFrame) -> DataFrame:
        held = "clsname string, part long, state binary"
        states = rows.withColumn("clsname", F.col("clsname").cast("string")).mapInPandas(updated, held)
        for _ in range(levels):
            states = states.groupBy("clsname", F.floor(F.col("part") / FAN_IN)).applyInPandas(some, held)
        return states.groupBy("clsname").applyInPandas(all_of, f"clsname string, {schema}")

    return run


def report(metrics: DataFrame, key: str = "clsname") -> DataFrame:
    """The categories and a ``mean`` row: unweighted, without threshold columns."""
    means = [(F.lit(None).cast("double") if "threshold" in c else F.avg(c)).alias(c) for c in metrics.columns if c != key]
    return metrics.unionByName(metrics.agg(*means).withColumn(key, F.lit("mean")))
