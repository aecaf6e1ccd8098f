"""Maps as bands of rows: resampling, smoothing, tiles and stitching without a row per pixel.

A band holds some consecutive rows of a map as arrays, with copies of the neighbouring rows
that its operations look at (the halo). Work along x and y stays inside the band's arrays, so
nothing is shuffled by pixel; what leaves is a row of the result at a time, and pixels only
where a caller asks for them.

Tables: bands ``image, width, height, band, y0, rows`` (``rows`` begins at map row ``y0``);
rows ``image, y, row``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise.functions.vectors import hann_weight

#: Rows of a band, and pixels of a piece of a row when rows are added up.
BAND, PIECE = 64, 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def upto(n: Column | int) -> Column:
    """0 to n - 1; none if n is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _bounds(band: int, halo: int) -> tuple[Column, Column]:
    """First row of a band with its halo, and the row after its last one."""
    first = F.greatest(F.col("band") * band - halo, F.lit(0)).cast("int")
    return first, F.least((F.col("band") + 1) * band + halo, F.col("height")).cast("int")


def from_arrays(maps: DataFrame, band: int = BAND, halo: int = 1) -> DataFrame:
    """Bands of ``image, width, height, values`` (row by row); no shuffle."""
    n = F.ceil(F.col("height") / band).cast("int")
    first, stop = _bounds(band, halo)
    sound = F.when(F.size("values") == F.col("width") * F.col("height"), F.col("values").cast("array<double>")).otherwise(F.raise_error(F.lit("a map has not width * height values")).cast("array<double>"))
    cut = maps.select("image", "width", "height", sound.alias("values"), F.explode(upto(n)).alias("band")).withColumn("y0", first)
    rows = F.transform(F.sequence(F.col("y0"), stop - 1), lambda y: F.slice("values", y * F.col("width") + 1, F.col("width")))
    return cut.select("image", "width", "height", "band", "y0", rows.alias("rows"))


def from_cells(cells: DataFrame, sizes: DataFrame, band: int = BAND, halo: int = 1, value: str = "v") -> DataFrame:
    """Bands of pixels ``image, y, x, v``: one shuffle by image and band, halo pixels sent twice.

    A map that lacks pixels fails the job: its rows would shift.
    """
    last = F.floor((F.col("height") - 1) / band)
    near = F.sequence(F.greatest(F.floor((F.col("y") - halo) / band), F.lit(0).cast("long")), F.least(F.floor((F.col("y") + halo) / band), last))
    sized = cells.select("image", "y", "x", F.col(value).cast("double").alias("v")).join(sizes.select("image", "width", "height"), "image")
    dealt = sized.select("image", "width", "height", F.explode(F.transform(near, lambda k: k.cast("int"))).alias("band"), "y", F.struct("x", "v").alias("p")).repartition("image", "band")
    row = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"])
    rowed = dealt.groupBy("image", "band", "width", "height", "y").agg(row.alias("row"))
    whole = rowed.withColumn("row", F.when(F.size("row") == F.col("width"), F.col("row")).otherwise(F.raise_error(F.lit("a map lacks pixels")).cast("array<double>")))
    banded = whole.groupBy("image", "band", "width", "height").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("held"))
    first, stop = _bounds(band, halo)
    sound = F.when(F.size("held") == stop - first, F.transform("held", lambda r: r["row"])).otherwise(F.raise_error(F.lit("a map lacks rows")).cast("array<array<double>>"))
    return banded.select("image", "width", "height", "band", first.alias("y0"), sound.alias("rows"))


def rows_of(bands: DataFrame, band: int = BAND) -> DataFrame:
    """``image, y, row``: the rows of each band without its halo."""
    own = bands.select("image", "band", "y0", F.posexplode("rows").alias("k", "row")).withColumn("y", F.col("y0") + F.col("k"))
    return own.filter(F.floor(F.col("y") / band) == F.col("band")).select("image", "y", "row")


def cells_of(rows: DataFrame, *others: str) -> DataFrame:
    """``image, others, y, x, v``: a row for each pixel, where that is asked for."""
    return rows.select("image", *others, "y", F.posexplode("row").alias("x", "v"))


def _place(o: Column, size: Column, n: Column | int, align_corners: bool) -> Column:
    """Where an output pixel lies: half-pixel centres with clamped edges, or corners on corners."""
    n = F.lit(n) if isinstance(n, int) else n
    if align_corners:
        return o * (size - 1) / F.greatest(n - 1, F.lit(1))
    return F.least(F.greatest((o + 0.5) * size / n - 0.5, F.lit(0.0)), size - 1.0)


def _ends(size: Column, n: Column | int, align_corners: bool) -> Column:
    """For each of n output pixels the two source pixels and the share of the second."""
    end = lambda s: F.struct(F.floor(s).cast("int").alias("low"), F.least(F.floor(s) + 1, size - 1).cast("int").alias("high"), (s - F.floor(s)).alias("part"))
    return F.transform(upto(n), lambda o: let(_place(o, size, n, align_corners), end))


def _mix(a: Column, b: Column, part: Column) -> Column:
    return a.cast("double") * (1 - part) + b.cast("double") * part


def crop_values(values: Column, width: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The values of columns x0 to x1 - 1 and rows y0 to y1 - 1 of a map kept row by row."""
    rows = F.transform(upto(y1 - y0), lambda k: F.slice(values, (y0 + k) * width + x0 + 1, x1 - x0))
    return F.flatten(rows)


def resize_values(values: Column, width: Column, height: Column, out_w: Column | int, out_h: Column | int, align_corners: bool = False) -> Column:
    """The bilinear resample of a whole map that is one array, for maps as small as feature grids."""

    def across(v: Column, ends: Column, down: Column) -> Column:
        at = lambda y, x: F.element_at(v, y * width + x + 1)
        line = lambda y, e: _mix(at(y, e["low"]), at(y, e["high"]), e["part"])
        return F.flatten(F.transform(down, lambda d: F.transform(ends, lambda e: _mix(line(d["low"], e), line(d["high"], e), d["part"]))))

    return let(values, lambda v: let(_ends(width, out_w, align_corners), lambda e: across(v, e, _ends(height, out_h, align_corners))))


def resize(bands: DataFrame, out_w: int, out_h: int, align_corners: bool = False, band: int = BAND) -> DataFrame:
    """Rows of the bilinear resample: two rows of a band are mixed, then two pixels of the mix.

    The bands need a halo of one row. An output row belongs to the band of the upper of its rows.
    """
    w, h = F.col("width"), F.col("height")
    placed = bands.select("image", "band", "y0", "rows", _ends(w, out_w, align_corners).alias("across"), F.posexplode(_ends(h, out_h, align_corners)).alias("y", "down"))
    own = placed.filter(F.floor(F.col("down.low") / band) == F.col("band"))
    at = lambda k: F.element_at("rows", F.col(f"down.{k}") - F.col("y0") + 1)
    mixed = F.zip_with(at("low"), at("high"), lambda a, b: _mix(a, b, F.col("down.part")))
    row = let(mixed, lambda r: F.transform("across", lambda x: _mix(F.element_at(r, x["low"] + 1), F.element_at(r, x["high"] + 1), x["part"])))
    return own.select("image", "y", row.alias("row"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian cut at four sigma."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k, w / sum(raw)) for k, w in zip(range(-radius, radius + 1), raw, strict=True)]


def _reflected(at: Column, size: Column) -> Column:
    """Indexes beyond an edge come back, the edge pixel repeated."""
    period = F.pmod(at, 2 * size)
    return F.least(period, 2 * size - 1 - period).cast("int")


def smooth(bands: DataFrame, sigma: float, band: int = BAND) -> DataFrame:
    """Rows of the Gaussian smoothing, down and then across; the halo must be the kernel's radius."""
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel(sigma)])
    w, h = F.col("width"), F.col("height")
    own = bands.select("image", "width", "height", "band", "y0", "rows", F.explode(upto(F.least(F.lit(band), h - F.col("band") * band))).alias("k")).withColumn("y", F.col("band") * band + F.col("k"))
    total = lambda of: F.aggregate(weights, F.lit(0.0), lambda s, g: s + g["w"] * of(g["k"]).cast("double"))
    # the rows that a result row looks at, then a sum down each column
    near = F.transform(weights, lambda g: F.element_at("rows", _reflected(F.col("y") + g["k"], h) - F.col("y0") + 1))
    n = len(kernel(sigma)) // 2
    down = let(near, lambda rows: F.transform(upto(w), lambda x: total(lambda k: F.element_at(F.element_at(rows, k + n + 1), x + 1))))
    across = let(down, lambda row: F.transform(upto(w), lambda x: total(lambda k: F.element_at(row, _reflected(x + k, w) + 1))))
    return own.select("image", "y", across.alias("row"))


def tile_rows(tiles: DataFrame, bands: DataFrame, patch_w: int, patch_h: int, edge: str = "replicate", band: int = BAND) -> DataFrame:
    """``image, tile_id, ty, row``: the rows of each tile, overhang included.

    The tile side lists the bands that it covers: an equi-join by image and band. Overhang
    repeats the edge (images) or is 0 (masks, ``edge="zero"``).
    """
    line = F.col("y") + F.col("ty")
    wanted = tiles.select("image", "tile_id", "x", "y", "height", F.explode(upto(patch_h)).alias("ty")).withColumn("py", F.least(line, F.col("height") - 1)).withColumn("below", line >= F.col("height"))
    by_band = wanted.withColumn("band", F.floor(F.col("py") / band).cast("int")).groupBy("image", "band", "tile_id", "x").agg(F.collect_list(F.struct("ty", "py", "below")).alias("lines"))
    joined = by_band.join(bands.select("image", "band", "width", "y0", "rows"), ["image", "band"]).select("image", "tile_id", "x", "width", "y0", "rows", F.explode("lines").alias("l"))
    w = F.col("width")
    cut = F.slice(F.element_at("rows", F.col("l.py") - F.col("y0") + 1), F.col("x") + 1, F.lit(patch_w))
    if edge == "replicate":
        row = let(cut, lambda r: F.concat(r, F.array_repeat(F.element_at(r, -1), F.lit(patch_w) - F.size(r))))
    else:
        zeros = F.array_repeat(F.lit(0.0), patch_w)
        row = F.when(F.col("l.below"), zeros).otherwise(let(cut, lambda r: F.concat(r, F.array_repeat(F.lit(0.0), F.lit(patch_w) - F.size(r)))))
    return joined.select("image", "tile_id", F.col("l.ty").alias("ty"), row.alias("row"))


def overlap_add(rows: DataFrame, patch_w: Column | int, patch_h: Column | int, piece: int = PIECE) -> DataFrame:
    """``image, y, x0, row``: weighted means of the tiles that cover each pixel, in pieces of rows.

    ``rows``: ``image, x, y, valid_w, valid_h, ty, row`` of each tile; the patch sizes may be
    columns, so tiles of several sizes add up. Tile rows are shuffled as arrays, cut where
    pieces end, so that a group holds the few tiles that meet a piece. Pixels that no tile
    covers are null.
    """
    hann = lambda at, n: hann_weight(at, n)
    x, vw = F.col("x"), F.col("valid_w")
    inside = rows.filter((F.col("ty") < F.col("valid_h")) & (vw > 0)).withColumn("pw", F.lit(patch_w) if isinstance(patch_w, int) else patch_w).withColumn("down", hann(F.col("ty"), patch_h))
    weighed = inside.select("image", x, (F.col("y") + F.col("ty")).alias("y"), vw, F.slice("row", F.lit(1), vw).alias("row"), F.transform(upto(vw), lambda tx: 0.05 + 0.95 * F.col("down") * hann(tx, F.col("pw"))).alias("w"))
    first = F.floor(x / piece).cast("int")
    cut = weighed.withColumn("piece", F.explode(F.sequence(first, F.floor((x + vw - 1) / piece).cast("int"))))
    start = F.greatest(x, F.col("piece") * piece)
    stop = F.least(x + vw, (F.col("piece") + 1) * piece)
    part = lambda c: F.slice(c, start - x + 1, stop - start)
    parts = cut.select("image", "y", "piece", F.struct((start - F.col("piece") * piece).cast("int").alias("at"), part("row").alias("v"), part("w").alias("w")).alias("t"))
    met = parts.groupBy("image", "y", "piece").agg(F.collect_list("t").alias("ts"))
    length = F.array_max(F.transform("ts", lambda t: t["at"] + F.size(t["v"])))
    none = F.array_repeat(F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), length)

    def add(acc: Column, t: Column) -> Column:
        covered = F.arrays_zip(F.slice(acc, t["at"] + 1, F.size(t["v"])).alias("s"), t["v"].alias("v"), t["w"].alias("w"))
        summed = F.transform(covered, lambda c: F.struct((c["s"]["v"] + c["v"].cast("double") * c["w"]).alias("v"), (c["s"]["w"] + c["w"]).alias("w")))
        rest = t["at"] + F.size(t["v"])
        return F.concat(F.slice(acc, F.lit(1), t["at"]), summed, F.slice(acc, rest + 1, F.size(acc) - rest))

    sums = F.aggregate("ts", none, add, lambda acc: F.transform(acc, lambda s: F.when(s["w"] > 0, (s["v"] / s["w"]).cast("float"))))
    return met.select("image", "y", (F.col("piece") * piece).alias("x0"), sums.alias("row"))


def stitched_cells(stitched: DataFrame) -> DataFrame:
    """``image, y, x, v`` of pieces of rows, covered pixels only."""
    cells = stitched.select("image", "y", "x0", F.posexplode("row").alias("k", "v")).filter("v IS NOT NULL")
    return cells.select("image", F.col("y").cast("int").alias("y"), (F.col("x0") + F.col("k")).cast("int").alias("x"), "v")
