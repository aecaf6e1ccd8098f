"""Connected regions of masks, and the per-region-overlap curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.functions.vectors import linspace
from tilewise.sources.storage import stored

#: Rows of pixels that a task joins to regions by itself.
BAND = 256
MOST_ROUNDS = 200
RUN = "y int, x0 int, x1 int, run long, region long"


def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the links a - b.

    Roots are hooked to smaller ones and paths are halved until no link joins two roots, so
    a long winding region takes few rounds.
    """
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def runs_and_regions(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """First pixel, y, x0, x1 and region (index of its first run) of each run of sorted pixels."""
    begins = np.ones(len(x), bool)
    begins[1:] = (group[1:] != group[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    at = np.nonzero(begins)[0]
    last = np.append(at[1:], len(x)) - 1
    y, x0, x1 = y[at], x[at].astype(np.int64), x[last].astype(np.int64)
    # number of the row of pixels; a row that doesn't follow the one before skips a number
    step = np.where(group[at][1:] != group[at][:-1], 2, np.minimum(y[1:] - y[:-1], 2))
    row = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])
    # runs of the row above (the next key) that overlap: those that end at or after x0 and begin at or before x1
    wide = int(x1.max()) + 2
    first = np.searchsorted(row * wide + x1, (row + 1) * wide + x0)
    stop = np.searchsorted(row * wide + x0, (row + 1) * wide + x1, "right")
    count = np.maximum(stop - first, 0)
    a = np.repeat(np.arange(len(at)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return at, y, x0, x1, smallest_reached(a, b, len(at))


def _run_rows(table: pa.Table) -> pa.RecordBatch:
    """The runs of whole bands, sorted by image, band, y and x."""
    image, band = table.column("image").combine_chunks(), table.column("band").to_numpy()
    new = pc.fill_null(pc.not_equal(image.slice(1), image.slice(0, len(image) - 1)), True).to_numpy(zero_copy_only=False)
    group = np.concatenate([[0], np.cumsum(new | (band[1:] != band[:-1]))])
    at, y, x0, x1, region = runs_and_regions(group, table.column("y").to_numpy(), table.column("x").to_numpy())
    run = y.astype(np.int64) << 31 | x0
    return pa.RecordBatch.from_arrays([image.take(pa.array(at)), pa.array(y, pa.int32()), pa.array(x0, pa.int32()), pa.array(x1, pa.int32()), pa.array(run), pa.array(run[region])], ["image", "y", "x0", "x1", "run", "region"])


def _band_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands come whole and sorted; the last of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        tail = (b.column(0)[-1], b.column(1)[-1])
        if held and (held[-1].column(0)[-1], held[-1].column(1)[-1]) == tail and (b.column(0)[0], b.column(1)[0]) == tail:
            held.append(b)  # still the same band
            continue
        table = pa.Table.from_batches([*held, b])
        same = pc.and_(pc.equal(b.column(0), tail[0]), pc.equal(b.column(1), tail[1]))
        cut = table.num_rows - int(pc.sum(same).as_py())
        if cut:
            yield _run_rows(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield _run_rows(pa.Table.from_batches(held))


def band_regions(cells: DataFrame, band: int = BAND) -> DataFrame:
    """``image, y, x0, x1, run, region``: runs of set pixels with regions that stop at bands.

    One shuffle of the set pixels by image and band of rows; everything else stays in the task.
    """
    on = cells.filter("gt = 1 AND image IS NOT NULL").select("image", F.floor(F.col("y") / band).cast("int").alias("band"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    dealt = on.repartition("image", "band").sortWithinPartitions("image", "band", "y", "x")
    kind = on.schema["image"].dataType.simpleString()
    return dealt.mapInArrow(_band_runs, f"image {kind}, {RUN}")


def mask_regions(cells: DataFrame, band: int = BAND) -> DataFrame:
    """``image, y, x0, x1, run, region``: 4-neighbour components; region is the smallest run of its own.

    Images of one band are done after that. For others, the regions of neighbouring bands that
    touch at the border are linked, and labels spread along these few links, each round a
    written table: no pixel or run takes part. Pixels without an image are left out.
    """
    runs = stored(band_regions(cells, band), "runs")
    edge = F.col("y") % band
    below = runs.filter(edge == band - 1).select("image", F.col("y").alias("ya"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("region").alias("a"))
    above = runs.filter(edge == 0).select("image", (F.col("y") - 1).alias("ya"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("region").alias("b"))
    touch = below.join(above, ["image", "ya"]).filter("a0 <= b1 AND b0 <= a1").select("image", "a", "b").distinct()
    links = stored(touch.unionByName(touch.select("image", F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    if links.isEmpty():
        return runs
    label = links.select("image", F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    for _ in range(MOST_ROUNDS):
        near = links.join(label.withColumnRenamed("node", "b"), ["image", "b"]).groupBy("image", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = label.join(near, ["image", "node"]).withColumn("new", F.least("root", "near"))
        hop = spread.select("image", F.col("node").alias("new"), F.col("new").alias("far"))
        new = stored(spread.join(hop, ["image", "new"], "left").select("image", "node", "root", F.least("new", "far").alias("next")), "labels")
        changed = not new.filter("next <> root").isEmpty()
        label = new.select("image", "node", F.col("next").alias("root"))
        if not changed:
            joined = runs.join(label.withColumnRenamed("node", "region"), ["image", "region"], "left")
            return joined.select("image", "y", "x0", "x1", "run", F.coalesce("root", "region").alias("region"))
    raise RuntimeError("regions did not settle")


def pro_curve(pairs: DataFrame, regions: DataFrame, thresholds: int = 200) -> DataFrame:
    """``clsname, fpr, pro``: mean overlap of true regions against the false positive rate.

    Each pixel falls into one threshold bucket (the first threshold it reaches); counts per
    bucket are summed from the top, so pixels never meet all thresholds.
    """
    top, bottom = F.max("pred").cast("double"), F.min("pred").cast("double")
    margin = F.greatest(F.lit(2.0**-52), F.abs(top) * 1e-12, F.abs(bottom) * 1e-12)
    bounds = pairs.groupBy("clsname").agg((top + margin).alias("hi"), (bottom - margin).alias("lo"))
    grid = bounds.select("clsname", linspace(F.col("hi"), F.col("lo"), thresholds).alias("ts"), "hi", "lo")
    p = F.col("pred").cast("double")
    guess = F.greatest(F.lit(0), F.least(F.lit(thresholds - 1), F.ceil((F.col("hi") - p) / (F.col("hi") - F.col("lo")) * (thresholds - 1)).cast("int")))
    t = lambda i: F.element_at("ts", i + 1)
    # the estimate is checked against its neighbours, which settles rounding
    exact = F.when((F.col("k") > 0) & (t(F.greatest(F.col("k") - 1, F.lit(0))) <= p), F.col("k") - 1).when(t(F.col("k")) > p, F.col("k") + 1).otherwise(F.col("k"))
    bucketed = pairs.join(grid, "clsname").withColumn("k", guess).withColumn("k", F.least(exact, F.lit(thresholds - 1)))
    background = bucketed.filter("gt = 0").groupBy("clsname", "k").agg(F.count("*").alias("fp"))
    pixels = regions.select("image", "y", "region", F.explode(F.sequence("x0", "x1")).alias("x"))
    hit = bucketed.filter("gt = 1").join(pixels, ["image", "y", "x"]).groupBy("clsname", "image", "region", "k").agg(F.count("*").alias("n"))
    size = W.partitionBy("clsname", "image", "region")
    part = hit.withColumn("share", F.col("n") / F.sum("n").over(size)).groupBy("clsname", "k").agg(F.sum("share").alias("share"))
    n_regions = hit.select("clsname", "image", "region").distinct().groupBy("clsname").agg(F.count("*").alias("n_regions"))
    steps = bounds.select("clsname", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("k"))
    down = W.partitionBy("clsname").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = steps.join(background, ["clsname", "k"], "left").join(part, ["clsname", "k"], "left").fillna(0, ["fp", "share"])
    sums = joined.select("clsname", "k", F.sum("fp").over(down).alias("fp"), F.sum("fp").over(W.partitionBy("clsname")).alias("all"), F.sum("share").over(down).alias("share"))
    rated = sums.join(n_regions, "clsname").filter("all > 0").select("clsname", (F.col("fp") / F.col("all")).alias("fpr"), (F.col("share") / F.col("n_regions")).alias("pro"))
    return rated.groupBy("clsname", "fpr").agg(F.max("pro").alias("pro"))


def pro_area(curve: DataFrame, limit: float = 0.3) -> DataFrame:
    """Area under the curve up to ``limit``, with the value at the limit interpolated, over ``limit``."""
    by = W.partitionBy("clsname").orderBy("fpr")
    ends = curve.withColumn("f2", F.lead("fpr").over(by)).withColumn("p2", F.lead("pro").over(by))
    at = F.col("pro") + (F.col("p2") - F.col("pro")) * (limit - F.col("fpr")) / (F.col("f2") - F.col("fpr"))
    inside = ends.filter(F.col("fpr") < limit)
    right_f = F.when(F.col("f2") < limit, F.col("f2")).otherwise(F.lit(limit))
    right_p = F.when(F.col("f2") < limit, F.col("p2")).when(F.col("f2").isNotNull(), at).otherwise(F.col("pro"))
    piece = (right_f - F.col("fpr")) * (right_p + F.col("pro")) / 2
    # the first threshold lies above every pixel, so the curve starts at (0, 0)
    area = inside.groupBy("clsname").agg((F.sum(piece) / limit).alias("pro"))
    return area.withColumn("pro", F.least(F.greatest("pro", F.lit(0.0)), F.lit(1.0)))
