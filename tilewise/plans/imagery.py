"""Queries on tilings, stitching, pixel operators and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.operators import bands, features, pixels, sampling, stitch, tiling
from tilewise.plans.evaluation import GRID
from tilewise.sources import tables

PATCH, STRIDE, FACTORS = 64, 48, (0, 1, 2)

IMG = "img AS (SELECT p_partkey AS ordinal, concat('part/', p_partkey, '.png') AS image_path, p_brand AS clsname, 8 * p_size + 8 AS width, 4 * p_size + 16 AS height FROM part)"


def _starts(size: str, patch: str, stride: str) -> str:
    return f"CASE WHEN {size} <= {patch} THEN [0] ELSE list_sort(list_distinct([least(s, {size} - {patch}) FOR s IN range(0, {size}, {stride})])) END"


def _tiles(stride: int, factors: tuple[int, ...]) -> str:
    return f"""sp AS (SELECT img.*, f AS scale, {PATCH} * (1 << f) AS w, {stride} * (1 << f) AS s FROM img, (SELECT unnest({list(factors)}) AS f)),
st AS (SELECT *, {_starts("width", "w", "s")} AS xs, {_starts("height", "w", "s")} AS ys FROM sp),
tl AS (SELECT ordinal, image_path, clsname, width, height, scale, (r * len(xs) + k)::INT AS tile_id, xs[k + 1]::INT AS x, ys[r + 1]::INT AS y, w::INT AS w, w::INT AS h, least(w, width - xs[k + 1])::INT AS valid_w, least(w, height - ys[r + 1])::INT AS valid_h
  FROM (SELECT st.*, r, unnest(range(0, len(xs))) AS k FROM (SELECT *, unnest(range(0, len(ys))) AS r FROM st) st))"""



def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(tables.image_sizes(spark, sf_dir), PATCH).select("image_path", "tile_id", "x", "y", "w", "h", "valid_w", "valid_h")


def tiles_multires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(tables.image_sizes(spark, sf_dir), PATCH, STRIDE, FACTORS).select("image_path", "scale", "tile_id", "x", "y", "w", "valid_w", "valid_h")


def tile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_records(tables.image_sizes(spark, sf_dir), PATCH, None, 32).select("image_path", "task", "tile_id", "x", "y", "model_w", "model_h")


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = tiling.tiles(tables.image_sizes(spark, sf_dir), PATCH, STRIDE)
    return tiling.with_contexts(main, PATCH, STRIDE, FACTORS)


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("image_path", "tile_id", "context_scale", "cx", "cy")


def context_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.context_index(_contexts(spark, sf_dir), 30, 30).select("image_path", "tile_id", "context_scale", "ix", "iy", "iw", "ih")


def context_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tiles of 64 pixels in images of 128, with the tiles around them at two scales.

    Feature grids are the 8 x 8 maps: the main tile's own by its number, the contexts' those of
    the next two images.
    """
    maps = tables.maps(spark, sf_dir).select("image", "width", "height", "values")
    n = maps.agg(F.count("*").alias("n"))
    images = maps.select("image", F.lit(128).alias("width"), F.lit(128).alias("height")).crossJoin(F.broadcast(n))  # n is one row
    t = tiling.tiles(images, 64)
    grid = ["image", "tile_id", F.lit(0).alias("channel"), F.col("gw").alias("width"), F.col("gh").alias("height"), "values"]
    grids = maps.select(F.col("image").alias("at"), F.col("width").alias("gw"), F.col("height").alias("gh"), "values")
    main = t.withColumn("at", F.pmod(F.col("image") * 4 + F.col("tile_id"), F.col("n"))).join(grids, "at").select(*grid)
    index = tiling.context_index(tiling.with_contexts(t, 64, 64, FACTORS), 64, 64).withColumn("at", F.pmod(F.col("image") + F.col("context_scale"), F.col("n")))
    contexts = index.join(grids, "at").select(*grid, "context_scale", "ix", "iy", "iw", "ih")
    fused = features.fuse_contexts(main, contexts, {0: 4.0, 1: 2.0, 2: 1.0}, 64, 64)
    return fused.select("image", "tile_id", F.posexplode("fused").alias("place", "v")).select("image", "tile_id", "place", F.round("v", 5).alias("v"))


def index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as JSON, read back."""
    rows = tiling.tiles(tables.image_sizes(spark, sf_dir), PATCH).withColumn("json", tiling.index_to_json("x", "y", "w", "h"))
    return rows.withColumn("back", tiling.index_from_json("json")).select("image_path", "tile_id", "json", (F.col("back.x") + F.col("back.width")).alias("right"))


def fair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiling.tiles(tables.image_sizes(spark, sf_dir), PATCH)
    return sampling.fair_sample(rows, "image_path", "tile_id", 4, 3).select("image_path", "tile_id")


def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of the fair sample, each in a random order of its own."""
    rows = tiling.tiles(tables.image_sizes(spark, sf_dir), PATCH)
    one = lambda e: sampling.epoch_order(sampling.fair_sample(rows, "image_path", "tile_id", 4, e), "image_path", e).select(F.lit(e).alias("epoch"), "image_path", "tile_id", "position")
    return one(2).unionByName(one(3))


def round_robin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(tables.image_sizes(spark, sf_dir), "ordinal", 7).select("ordinal", F.col("bucket").cast("long").alias("bucket"))


def roi_crop_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image cropped to an ROI of its own."""
    g = tables.grid(spark, sf_dir).select("image", "y", "x", F.col("gt").alias("v"))
    rois = g.select("image").distinct().withColumn("roi", F.array((F.col("image") % 3).cast("int"), (F.col("image") % 2).cast("int"), F.lit(4), (F.col("image") % 4 + 1).cast("int")))
    return pixels.crop_own(g, rois)


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(tables.image_sizes(spark, sf_dir), "ordinal", 7, within="clsname").select("ordinal", F.col("bucket").cast("long").alias("bucket"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid(spark, sf_dir).select("image", "y", "x", F.col("pred").alias("v"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def _small_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 tiles at stride 2 of the 8 x 8 maps."""
    one = F.array(*[F.lit(s) for s in (0, 2, 4)])
    t = _sizes(spark, sf_dir).withColumn("y", F.explode(one)).withColumn("x", F.explode(one))
    return t.withColumn("tile_id", F.col("y") / 2 * 3 + F.col("x") / 2).withColumn("tile_id", F.col("tile_id").cast("int")).withColumn("valid_w", F.lit(4)).withColumn("valid_h", F.lit(4))


def _bands(spark: SparkSession, sf_dir: str, halo: int = 0) -> DataFrame:
    return bands.from_arrays(tables.maps(spark, sf_dir), halo=halo)


def _tile_pixels(spark: SparkSession, sf_dir: str, tiles: DataFrame) -> DataFrame:
    """Pixels of 4 x 4 tiles with repeated edges (v), and with zeros beyond the edge (z)."""
    rows = lambda edge, name: bands.tile_rows(tiles, _bands(spark, sf_dir), 4, 4, edge).withColumnRenamed("row", name)
    both = rows("replicate", "vs").join(rows("zero", "zs"), ["image", "tile_id", "ty"])
    cells = both.select("image", "tile_id", "ty", F.posexplode(F.arrays_zip("vs", "zs")).alias("tx", "c"))
    return cells.select("image", "tile_id", "ty", "tx", F.round("c.vs", 6).alias("v"), F.round("c.zs", 6).alias("z"))


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that overhang by one: x and y moved to 5 for the last ones; masks get zeros there."""
    t = _small_tiles(spark, sf_dir).filter("x = 4 AND y = 4").withColumn("x", F.lit(5)).withColumn("y", F.lit(5))
    return _tile_pixels(spark, sf_dir, t).drop("tile_id")


def tile_pixels_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine tiles, the last row and column moved to 5 so that they overhang by one; z as in ``tile_pixels``."""
    moved = lambda c: F.when(F.col(c) == 4, 5).otherwise(F.col(c)).alias(c)
    return _tile_pixels(spark, sf_dir, _small_tiles(spark, sf_dir).select("image", "tile_id", moved("x"), moved("y"), "width", "height"))


def _tile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's map is the image's, raised by its number / 100: overlaps disagree."""
    t = _small_tiles(spark, sf_dir)
    rows = stitch.join_predictions(t, bands.tile_rows(t, _bands(spark, sf_dir), 4, 4), ["image", "tile_id"])
    return rows.withColumn("row", F.transform("row", lambda v: v + F.col("tile_id") / 100.0))


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    stitched = bands.overlap_add(_tile_maps(spark, sf_dir), 4, 4)
    return bands.stitched_cells(stitched).select("image", "y", "x", F.round(F.col("v").cast("double"), 5).alias("v"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile 4 (the centre) and tile 0 are left out for every third image."""
    kept = _tile_maps(spark, sf_dir).filter("NOT (image % 3 = 0 AND tile_id IN (0, 4))")
    return stitch.coverage_gaps(_sizes(spark, sf_dir), bands.stitched_cells(bands.overlap_add(kept, 4, 4))).select("image", "y", "x")


def fuse_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd images have a thumbnail map: means of 4 x 4 cells, spread out again."""
    c = _cells(spark, sf_dir)
    means = c.filter("image % 2 = 1").groupBy("image", F.floor(F.col("y") / 4).alias("by"), F.floor(F.col("x") / 4).alias("bx")).agg(F.avg(F.col("v").cast("double")).alias("v"))
    half = F.explode(F.sequence(F.lit(0), F.lit(3)))
    thumb = means.withColumn("dy", half).withColumn("dx", half).select("image", (F.col("by") * 4 + F.col("dy")).cast("int").alias("y"), (F.col("bx") * 4 + F.col("dx")).cast("int").alias("x"), "v")
    return stitch.fuse_max(c.withColumn("v", F.col("v").cast("double")), thumb).select("image", "y", "x", F.round("v", 6).alias("v"))


def tile_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions lack one tile in 97 and have one too many per 101 images."""
    records = _small_tiles(spark, sf_dir).select("image", "tile_id")
    made = records.filter("(image * 9 + tile_id) % 97 <> 0").unionByName(_sizes(spark, sf_dir).filter("image % 101 = 0").select("image", F.lit(9).alias("tile_id")))
    return stitch.unmatched_predictions(records, made, ["image", "tile_id"])


def task_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = tables.grid(spark, sf_dir).groupBy("image").agg(F.max("pred").cast("double").alias("best"))
    sized = _sizes(spark, sf_dir).join(best, "image")
    patches = sized.filter("image % 11 <> 0").select("image", "width", "height", (F.col("best") / 2).alias("score")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("k")
    one = sized.select("image", F.when(F.col("image") % 13 == 0, 9).otherwise(F.col("width")).alias("width"), "height", F.col("best").alias("score"))
    thumbs = one.unionByName(one.filter("image % 17 = 0"))
    return stitch.merge_tasks(patches, thumbs).select("image", "n_patches", "n_thumbnails", F.round("score", 6).alias("score"), "fault")


def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pixels.crop(tables.grid(spark, sf_dir).select("image", "y", "x", F.col("gt").alias("v")), (2, 1, 4, 5))
    return pixels.binarise(cut).select("image", "y", "x", "v")


def roi_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose region (16, 8, 200, 100) doesn't fit."""
    s = tables.image_sizes(spark, sf_dir)
    return s.filter((F.lit(16 + 200) > F.col("width")) | (F.lit(8 + 100) > F.col("height"))).select("image_path", "width", "height")


def foreground_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grid(spark, sf_dir)
    masked = pixels.mask_foreground(_cells(spark, sf_dir).withColumn("v", F.col("v").cast("double")), g.filter("image % 4 <> 0").select("image", "y", "x", F.col("gt").alias("v")))
    return masked.groupBy("image").agg(F.round(F.sum("v"), 4).alias("total"), F.count_if(F.col("v") == 0).alias("n_black"))


def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pixels.resize_nearest(_cells(spark, sf_dir), _sizes(spark, sf_dir), 5, 3)
    return r.select("image", "y", "x", F.round(F.col("v").cast("double"), 6).alias("v"))


def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.cells_of(bands.resize(_bands(spark, sf_dir, 1), 5, 12)).select("image", "y", "x", F.round("v", 5).alias("v"))


def upsample_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.cells_of(bands.resize(_bands(spark, sf_dir, 1), 15, 11, align_corners=True)).select("image", "y", "x", F.round("v", 5).alias("v"))


def pixel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).withColumn("v", F.floor(F.col("v").cast("double") * 255)).withColumn("channel", F.col("x") % 3)
    return pixels.normalise(c).groupBy("image", F.col("channel").cast("int").alias("channel")).agg(F.round(F.sum("v"), 5).alias("total"))


def minmax_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return c.groupBy("image").agg(F.round(F.sum(pixels.min_max(F.col("v").cast("double"), 0.05, 0.2)), 5).alias("bounded"), F.round(F.sum(pixels.min_max(F.col("v").cast("double"), None, None)), 5).alias("free"))


def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.cells_of(bands.smooth(_bands(spark, sf_dir, 4), 1.0)).select("image", "y", "x", F.round("v", 5).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        tiles, tiles_multires, tile_union, context_join, context_index, context_fusion, index_json, fair_sample, epoch_order, round_robin, round_robin_all, roi_crop_own, tile_pixels, tile_pixels_all, overlap_add, coverage_gaps, fuse_max,
        tile_predictions, task_merge, roi_crop, roi_bounds, foreground_mask, resize_nearest, resize_bilinear, upsample_aligned, pixel_normalize, minmax_post, gaussian_smooth,
    )
}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_T = _tiles(PATCH, (0,))
_M = _tiles(STRIDE, FACTORS)
#: First enclosing tile in row-major order, found by the range join itself.
_CTX = """ctx AS (SELECT m.image_path, m.tile_id, m.x, m.y, m.w, c.scale AS context_scale, c.x AS cx, c.y AS cy, c.w AS cw FROM tl m JOIN tl c ON m.scale = 0 AND c.scale > 0 AND m.image_path = c.image_path AND m.x >= c.x AND m.y >= c.y AND m.x + m.w <= c.x + c.w AND m.y + m.h <= c.y + c.h
  QUALIFY row_number() OVER (PARTITION BY m.image_path, m.tile_id, c.scale ORDER BY c.tile_id) = 1)"""
_TILES4 = "t4 AS (SELECT vec_id AS image, a::INT AS y, b::INT AS x, (a // 2 * 3 + b // 2)::INT AS tile_id FROM embeddings, range(0, 6, 2) r(a), range(0, 6, 2) q(b))"
_MAPS = "maps AS (SELECT t4.image, t4.tile_id, g.y, g.x, (g.y - t4.y) AS ty, (g.x - t4.x) AS tx, g.pred::DOUBLE + t4.tile_id / 100 AS v FROM t4 JOIN grid g ON g.image = t4.image AND g.y BETWEEN t4.y AND t4.y + 3 AND g.x BETWEEN t4.x AND t4.x + 3)"
_HANN = "(0.5 - 0.5 * cos(2 * pi() * {} / 3))"


def _linear(out_w: int, out_h: int, aligned: bool) -> str:
    place = lambda o, n: f"{o} * 7.0::DOUBLE / {n - 1}" if aligned else f"least(greatest(({o} + 0.5::DOUBLE) * 8 / {n} - 0.5, 0), 7)"
    return (
        _with(GRID, f"o AS (SELECT a AS oy, b AS ox, {place('a', out_h)} AS sy, {place('b', out_w)} AS sx FROM range(0, {out_h}) r(a), range(0, {out_w}) q(b))")
        + "SELECT image, oy::INT AS y, ox::INT AS x, round(sum(pred::DOUBLE * greatest(0, 1 - abs(sy - g.y)) * greatest(0, 1 - abs(sx - g.x))), 5) AS v FROM grid g JOIN o ON abs(sy - g.y) < 1 AND abs(sx - g.x) < 1 GROUP BY ALL"
    )


def _part(side: int) -> str:
    """A square part of a map, its first cell at (x0, y0), resampled to 8 x 8 at (oy, ox)."""
    at = lambda o, first, g: f"greatest(0, 1 - abs(least(greatest(({o} + 0.5::DOUBLE) * {side} / 8 - 0.5, 0), {side - 1}) - ({g} - {first})))"
    return f"sum(pred::DOUBLE * {at('oy', 'y0', 'g.y')} * {at('ox', 'x0', 'g.x')})"


_OUT = "o AS (SELECT a AS oy, b AS ox FROM range(0, 8) r(a), range(0, 8) q(b))"
#: Tiles stand at (64 qx, 64 qy); their part of the coarser grids has 4 and 2 cells a side.
_FUSION = _with(
    GRID, _OUT,
    "t AS (SELECT vec_id AS image, q::INT AS tile_id, q % 2 AS qx, q // 2 AS qy FROM embeddings, range(0, 4) r(q))",
    "m0 AS (SELECT t.image, tile_id, y * 8 + x AS place, pred::DOUBLE AS v FROM t JOIN grid g ON g.image = (t.image * 4 + tile_id) % (SELECT n FROM n_))",
    *[
        f"m{k} AS (SELECT t.image, tile_id, oy * 8 + ox AS place, {_part(side)} AS v FROM (SELECT *, {side} * qx AS x0, {side} * qy AS y0 FROM t) t JOIN grid g ON g.image = (t.image + {k}) % (SELECT n FROM n_) AND g.x BETWEEN x0 AND x0 + {side - 1} AND g.y BETWEEN y0 AND y0 + {side - 1}, o GROUP BY ALL)"
        for k, side in ((1, 4), (2, 2))
    ],
)
SQL = {
    "context_fusion": _FUSION + "SELECT image, tile_id, place::INT AS place, round(m0.v * 4 / 7 + m1.v * 2 / 7 + m2.v / 7, 5) AS v FROM m0 JOIN m1 USING (image, tile_id, place) JOIN m2 USING (image, tile_id, place)",
    "tiles": _with(IMG, _T) + "SELECT image_path, tile_id, x, y, w, h, valid_w, valid_h FROM tl",
    "tiles_multires": _with(IMG, _M) + "SELECT image_path, scale::INT AS scale, tile_id, x, y, w, valid_w, valid_h FROM tl",
    "tile_union": _with(IMG, _T) + "SELECT image_path, 'dynamic_patch' AS task, tile_id, x, y, 64::INT AS model_w, 64::INT AS model_h FROM tl UNION ALL SELECT image_path, 'thumbnail', NULL, NULL, NULL, 32, 32 FROM img",
    "context_join": _with(IMG, _M, _CTX) + "SELECT image_path, tile_id, context_scale::INT AS context_scale, cx, cy FROM ctx",
    "context_index": _with(IMG, _M, _CTX) + "SELECT image_path, tile_id, context_scale::INT AS context_scale, trunc((x - cx) / cw * 30)::INT AS ix, trunc((y - cy) / cw * 30)::INT AS iy, trunc(w / cw * 30)::INT AS iw, trunc(w / cw * 30)::INT AS ih FROM ctx",
    "index_json": _with(IMG, _T) + """SELECT image_path, tile_id, concat('{"x":', x, ',"y":', y, ',"width":', w, ',"height":', h, '}') AS json, (x + w)::INT AS "right" FROM tl""",
    "fair_sample": _with(IMG, _T) + "SELECT image_path, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY md5(concat('s:', image_path, ':', tile_id)), tile_id) - 1 AS p, count(*) OVER (PARTITION BY image_path) AS n FROM tl) WHERE ((p - 12) % n + n) % n < least(4, n)",
    "epoch_order": _with(
        IMG, _T,
        "p AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY md5(concat('s:', image_path, ':', tile_id)), tile_id) - 1 AS p, count(*) OVER (PARTITION BY image_path) AS n FROM tl)",
        "e AS (SELECT epoch::INT AS epoch, image_path, tile_id, ((p - 4 * epoch) % n + n) % n AS step, n FROM p, range(2, 4) r(epoch))",
    )
    + "SELECT epoch, image_path, tile_id, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('s:', epoch, ':', image_path)), image_path, step) - 1 AS position FROM e WHERE step < least(4, n)",
    "round_robin_all": _with(IMG) + "SELECT ordinal, ((row_number() OVER (ORDER BY ordinal) - 1) % 7)::BIGINT AS bucket FROM img",
    "roi_crop_own": _with(GRID) + "SELECT image, (y - image % 2)::INT AS y, (x - image % 3)::INT AS x, gt::INT AS v FROM grid WHERE x - image % 3 BETWEEN 0 AND 3 AND y - image % 2 BETWEEN 0 AND image % 4",
    "round_robin": _with(IMG) + "SELECT ordinal, ((row_number() OVER (PARTITION BY clsname ORDER BY ordinal) - 1) % 7)::BIGINT AS bucket FROM img",
    "tile_pixels": _with(GRID) + "SELECT g.image, ty::INT AS ty, tx::INT AS tx, round(g.pred::DOUBLE, 6) AS v, CASE WHEN 5 + ty > 7 OR 5 + tx > 7 THEN 0 ELSE round(g.pred::DOUBLE, 6) END::DOUBLE AS z FROM range(0, 4) r(ty), range(0, 4) q(tx), grid g WHERE g.y = least(5 + ty, 7) AND g.x = least(5 + tx, 7)",
    "tile_pixels_all": _with(GRID, "t9 AS (SELECT (r * 3 + k)::INT AS tile_id, [0, 2, 5][r + 1] AS y0, [0, 2, 5][k + 1] AS x0 FROM range(0, 3) a(r), range(0, 3) b(k))")
    + "SELECT g.image, tile_id, ty::INT AS ty, tx::INT AS tx, round(g.pred::DOUBLE, 6) AS v, CASE WHEN y0 + ty > 7 OR x0 + tx > 7 THEN 0 ELSE round(g.pred::DOUBLE, 6) END::DOUBLE AS z FROM t9, range(0, 4) r(ty), range(0, 4) q(tx), grid g WHERE g.y = least(y0 + ty, 7) AND g.x = least(x0 + tx, 7)",
    "overlap_add": _with(GRID, _TILES4, _MAPS) + f"SELECT image, y, x, round((sum(v * w) / sum(w))::FLOAT::DOUBLE, 5) AS v FROM (SELECT *, 0.05::DOUBLE + 0.95::DOUBLE * {_HANN.format('ty')} * {_HANN.format('tx')} AS w FROM maps) GROUP BY image, y, x",
    "coverage_gaps": _with(GRID, _TILES4, _MAPS) + "SELECT image, y, x FROM grid EXCEPT SELECT image, y, x FROM maps WHERE NOT (image % 3 = 0 AND tile_id IN (0, 4))",
    "fuse_max": _with(GRID) + "SELECT image, y, x, round(CASE WHEN image % 2 = 1 THEN greatest(pred::DOUBLE, avg(pred::DOUBLE) OVER (PARTITION BY image, y // 4, x // 4)) ELSE pred::DOUBLE END, 6) AS v FROM grid",
    "tile_predictions": _with(_TILES4) + "SELECT image, tile_id, 'no prediction' AS fault FROM t4 WHERE (image * 9 + tile_id) % 97 = 0 UNION ALL SELECT vec_id, 9, 'no record' FROM embeddings WHERE vec_id % 101 = 0",
    "task_merge": _with(GRID)
    + """SELECT image, CASE WHEN image % 11 = 0 THEN 0 ELSE 2 END::BIGINT AS n_patches, CASE WHEN image % 17 = 0 THEN 2 ELSE 1 END::BIGINT AS n_thumbnails, round(max(pred)::DOUBLE, 6) AS score,
 CASE WHEN image % 11 = 0 THEN 'no patches' WHEN image % 17 = 0 THEN 'several thumbnails' WHEN image % 13 = 0 THEN 'sizes differ' END AS fault FROM grid GROUP BY image""",
    "roi_crop": _with(GRID) + "SELECT image, (y - 1)::INT AS y, (x - 2)::INT AS x, (gt * 255)::INT AS v FROM grid WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5",
    "roi_bounds": _with(IMG) + "SELECT image_path, width, height FROM img WHERE width < 216 OR height < 108",
    "foreground_mask": _with(GRID) + "SELECT image, round(sum(v), 4) AS total, count(*) FILTER (v = 0)::BIGINT AS n_black FROM (SELECT image, CASE WHEN image % 4 <> 0 AND gt = 0 THEN 0 ELSE pred::DOUBLE END AS v FROM grid) GROUP BY image",
    "resize_nearest": _with(GRID) + "SELECT g.image, oy::INT AS y, ox::INT AS x, round(g.pred::DOUBLE, 6) AS v FROM grid g, range(0, 3) r(oy), range(0, 5) q(ox) WHERE g.y = floor(oy * 8 / 3) AND g.x = floor(ox * 8 / 5)",
    "resize_bilinear": _linear(5, 12, False),
    "upsample_aligned": _linear(15, 11, True),
    "pixel_normalize": _with(GRID) + "SELECT image, (x % 3)::INT AS channel, round(sum((floor(pred::DOUBLE * 255) / 255 - [0.485, 0.456, 0.406][x % 3 + 1]::DOUBLE) / [0.229, 0.224, 0.225][x % 3 + 1]::DOUBLE), 5) AS total FROM grid GROUP BY ALL",
    "minmax_post": _with(GRID) + "SELECT image, round(sum(least(greatest((pred::DOUBLE - 0.05::DOUBLE) / (0.2::DOUBLE - 0.05::DOUBLE + 1e-4), 0), 1)), 5) AS bounded, round(sum(pred::DOUBLE), 5) AS free FROM grid GROUP BY image",
    "gaussian_smooth": _with(
        GRID,
        "k AS (SELECT i, exp(-0.5 * i * i) / sum(exp(-0.5 * i * i)) OVER () AS w FROM range(-4, 5) r(i))",
        "a AS (SELECT o.image, o.y, o.x, sum(k.w * s.pred::DOUBLE) AS v FROM grid o, k, grid s WHERE s.image = o.image AND s.x = o.x AND s.y = least(((o.y + k.i) % 16 + 16) % 16, 15 - ((o.y + k.i) % 16 + 16) % 16) GROUP BY ALL)",
    )
    + "SELECT o.image, o.y, o.x, round(sum(k.w * s.v), 5) AS v FROM a o, k, a s WHERE s.image = o.image AND s.y = o.y AND s.x = least(((o.x + k.i) % 16 + 16) % 16, 15 - ((o.x + k.i) % 16 + 16) % 16) GROUP BY ALL",
}
SQL["roi_bounds"] = SQL["roi_bounds"].replace("width, height FROM", "width::INT AS width, height::INT AS height FROM")
