"""Queries on evaluation: curves, areas, thresholds, gates, pixel metrics and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.operators import calibrate, decide, evaluate, pixels, regions
from tilewise.sources import tables

#: Of the short queries; the ``_full`` ones take the operator's ``evaluate.BINS``.
BINS = 1024

LBL = "lbl AS (SELECT doc_id AS image, lang AS clsname, source, n_chars::DOUBLE AS score, toxic::INT AS label FROM documents JOIN labels USING (doc_id))"
CURVE = """ties AS (SELECT clsname, score, sum(label) AS p, sum(1 - label) AS n FROM lbl GROUP BY ALL),
cum AS (SELECT clsname, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY clsname) AS pos, sum(n) OVER (PARTITION BY clsname) AS neg FROM ties WINDOW w AS (PARTITION BY clsname ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT clsname, score, tp, fp, (tp / pos)::DOUBLE AS tpr, (fp / neg)::DOUBLE AS fpr, (tp / (tp + fp))::DOUBLE AS precision FROM cum WHERE pos > 0 AND neg > 0)"""
AUROC = "SELECT clsname, sum((fpr - lf) * (tpr + lt) / 2) AS image_auroc FROM (SELECT *, lag(fpr, 1, 0.0) OVER w AS lf, lag(tpr, 1, 0.0) OVER w AS lt FROM curve WINDOW w AS (PARTITION BY clsname ORDER BY score DESC)) GROUP BY clsname"
YOUDEN = "SELECT clsname, score AS image_threshold FROM (SELECT *, row_number() OVER (PARTITION BY clsname ORDER BY round(tpr - fpr, 12) DESC, score DESC) AS k FROM curve) WHERE k = 1"

GRID = """n_ AS (SELECT count(*) AS n FROM embeddings),
grid AS (SELECT a.vec_id AS image, a.label AS clsname, (p // 8)::INT AS y, (p % 8)::INT AS x, abs(a.embedding[p + 1])::FLOAT AS pred, (b.embedding[p + 1] > 0.15::FLOAT)::INT AS gt FROM n_, embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM n_), range(0, 64) r(p))"""


def _hist(bins: int) -> str:
    return f"""bounds AS (SELECT clsname, min(pred) AS lo, max(pred) AS hi FROM grid GROUP BY clsname),
hist AS (SELECT clsname, lo, hi, bin, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 0) AS neg FROM (SELECT g.*, lo, hi, CASE WHEN hi > lo THEN least(greatest(trunc((pred - lo)::FLOAT * ({bins}::FLOAT / (hi - lo)::FLOAT)::FLOAT)::BIGINT, 0), {bins - 1}) ELSE {bins - 1} END AS bin FROM grid g JOIN bounds USING (clsname)) GROUP BY ALL)"""


def _pcurve(bins: int) -> str:
    return f"""pcum AS (SELECT clsname, bin, lo, hi, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY clsname) AS p, sum(neg) OVER (PARTITION BY clsname) AS n FROM hist WINDOW w AS (PARTITION BY clsname ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
pcurve AS (SELECT clsname, bin, lo::DOUBLE + bin * ((hi::DOUBLE - lo::DOUBLE) / {bins}) AS edge, (tp / p)::DOUBLE AS tpr, (fp / n)::DOUBLE AS fpr, coalesce((tp / nullif(tp + fp, 0))::DOUBLE, 0) AS precision FROM pcum)"""


HIST, PCURVE = _hist(BINS), _pcurve(BINS)
PAUROC = "SELECT clsname, sum((fpr - lf) * (tpr + lt) / 2) AS pixel_auroc, sum((tpr - lt) * precision) AS pixel_ap FROM (SELECT *, lag(fpr, 1, 0.0) OVER w AS lf, lag(tpr, 1, 0.0) OVER w AS lt FROM pcurve WINDOW w AS (PARTITION BY clsname ORDER BY bin DESC)) GROUP BY clsname"
PF1 = "SELECT clsname, f1 AS pixel_f1, edge AS pixel_threshold FROM (SELECT *, row_number() OVER (PARTITION BY clsname ORDER BY f1 DESC, bin DESC) AS k FROM (SELECT *, round(coalesce(2 * precision * tpr / nullif(precision + tpr, 0), 0), 12) AS f1 FROM pcurve)) WHERE k = 1"
REGIONS = """runs AS (SELECT image, y, min(x) AS x0, max(x) AS x1, y::BIGINT * 2147483648 + min(x) AS run FROM (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM grid WHERE gt = 1) GROUP BY image, y, g),
touch AS (SELECT a.image, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.image = b.image AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
reach AS (SELECT image, run, run AS region FROM runs UNION SELECT r.image, t.b, r.region FROM reach r JOIN touch t ON r.image = t.image AND r.run = t.a),
regions AS (SELECT runs.*, m.region FROM runs JOIN (SELECT image, run, min(region) AS region FROM reach GROUP BY ALL) m USING (image, run))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluate.binary_curve(tables.image_scores(spark, sf_dir))
    return c.select("clsname", "score", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), F.round("precision", 6).alias("precision"))


def image_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auroc(evaluate.binary_curve(tables.image_scores(spark, sf_dir))).select("clsname", F.round("image_auroc", 6).alias("image_auroc"))


def image_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.youden_threshold(evaluate.binary_curve(tables.image_scores(spark, sf_dir)))


def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lambda rows: rows.groupBy("clsname").agg(F.count("*").alias("n_images"))
    m = evaluate.metrics_by_category(tables.image_scores(spark, sf_dir), {"image": evaluate.image_metrics, "counts": counts})
    return m.select("clsname", F.round("image_auroc", 6).alias("image_auroc"), "image_threshold", "n_images")


class Moments:
    """Mean and variance of scores as a mergeable metric."""

    def update(self, state, rows):
        own = (len(rows), rows["score"].mean(), ((rows["score"] - rows["score"].mean()) ** 2).sum())
        return own if state is None else self.merge(state, own)

    def merge(self, a, b):
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart**2 * a[0] * b[0] / n

    def finish(self, state):
        return {"n_images": state[0], "mean_score": state[1], "variance": state[2] / state[0]}


def metric_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third-party metric beside a built-in one; scores in thousands."""
    rows = tables.image_scores(spark, sf_dir).withColumn("score", F.col("score") / 1000)
    moments = evaluate.mergeable_metric(Moments(), "n_images long, mean_score double, variance double")
    m = evaluate.metrics_by_category(rows, {"moments": moments, "image": evaluate.image_metrics})
    return m.select("clsname", "n_images", F.round("mean_score", 6).alias("mean_score"), F.round("variance", 6).alias("variance"), F.round("image_auroc", 6).alias("image_auroc"))


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.report(evaluate.image_metrics(tables.image_scores(spark, sf_dir)))
    return r.select("clsname", F.round("image_auroc", 6).alias("image_auroc"), "image_threshold")


def annotation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.image_scores(spark, sf_dir).withColumn("mask", F.when(F.col("label") == 1, F.lit("m.png")))
    by_lang = evaluate.annotation_gates(rows).withColumn("by", F.lit("lang"))
    by_source = evaluate.annotation_gates(rows, key="source").withColumn("by", F.lit("source"))
    unmasked = evaluate.annotation_gates(rows.withColumn("mask", F.lit(None).cast("string"))).withColumn("by", F.lit("no masks"))
    return by_lang.unionByName(by_source).unionByName(unmasked)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grid(spark, sf_dir)
    sizes = tables.maps(spark, sf_dir).select("image", "width", "height")
    return evaluate.pixel_pairs(g.select("image", "clsname", "y", "x", "pred"), g.filter("image % 5 <> 0").select("image", "y", "x", "gt"), sizes, sizes.filter("image % 5 <> 0"))


def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th mask lacks its last row."""
    g = tables.grid(spark, sf_dir)
    return evaluate.shape_faults(g, g.filter("image % 5 <> 0 AND (image % 7 <> 0 OR y < 7)"))


def pixel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth image has no mask: its truth is all zero."""
    return _pairs(spark, sf_dir).groupBy("image", "clsname").agg(F.sum("gt").alias("n_true"), F.count("*").alias("n"))


def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image"), F.col("toxic").alias("label"))
    return evaluate.label_or_mask(_pairs(spark, sf_dir), labels)


def _histogram(spark: SparkSession, sf_dir: str, bins: int = evaluate.BINS) -> DataFrame:
    return evaluate.pixel_histogram(tables.grid(spark, sf_dir), bins).select("clsname", "bin", "pos", "neg")


def _curve(spark: SparkSession, sf_dir: str, bins: int = evaluate.BINS) -> DataFrame:
    c = evaluate.pixel_curve(evaluate.pixel_histogram(tables.grid(spark, sf_dir), bins), bins)
    return c.select("clsname", "bin", *[F.round(x, 6).alias(x) for x in ("edge", "tpr", "fpr", "precision")])


def _ap(spark: SparkSession, sf_dir: str, bins: int = evaluate.BINS) -> DataFrame:
    m = evaluate.pixel_metrics(tables.grid(spark, sf_dir), bins)
    return m.select("clsname", F.round("pixel_auroc", 6).alias("pixel_auroc"), F.round("pixel_ap", 6).alias("pixel_ap"))


def _f1(spark: SparkSession, sf_dir: str, bins: int = evaluate.BINS) -> DataFrame:
    m = evaluate.best_f1(evaluate.pixel_curve(evaluate.pixel_histogram(tables.grid(spark, sf_dir), bins), bins))
    return m.select("clsname", F.round("pixel_f1", 6).alias("pixel_f1"), F.round("pixel_threshold", 6).alias("pixel_threshold"))


def pixel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, BINS)


def pixel_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, BINS)


def pixel_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir, BINS)


def pixel_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, BINS)


def pixel_histogram_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


def pixel_curve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir)


def pixel_ap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir)


def pixel_f1_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir)


def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.mask_regions(tables.grid(spark, sf_dir)).select("image", F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"), "region")


def pro(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grid(spark, sf_dir)
    return regions.pro_area(regions.pro_curve(g, regions.mask_regions(g))).select("clsname", F.round("pro", 6).alias("pro"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with their map's 0.9 quantile as the threshold."""
    g = tables.grid(spark, sf_dir)
    t = calibrate.map_quantile(g, 0.9, ["image"]).select("image", F.round("pixel_stat", 6).alias("pixel_threshold"))
    return g.join(t, "image")


def pixel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide_pixels(_judged(spark, sf_dir)).select("image", "y", "x", "is_anomalous")


def anomaly_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.anomaly_pixels(decide.decide_pixels(_judged(spark, sf_dir)), ["image"])


def display_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even images have a threshold, odd ones are scaled by their own range."""
    rows = _judged(spark, sf_dir).withColumn("v", F.col("pred").cast("double")).withColumn("threshold", F.when(F.col("image") % 2 == 0, F.col("pixel_threshold")))
    return pixels.display_scale(rows).select("image", "y", "x", F.round("shown", 6).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        roc_curve, image_auroc, image_threshold, metrics_by_category, metric_plugin, metric_report, annotation_gates, shape_faults, pixel_pairs, label_fallback, pixel_histogram,
        pixel_curve, pixel_ap, pixel_f1, pixel_histogram_full, pixel_curve_full, pixel_ap_full, pixel_f1_full, mask_regions, pro, pixel_decisions, anomaly_pixels, display_scale,
    )
}

_GATE = """SELECT coalesce(bool_and(has0 AND has1 AND clean), false) AS image_ready, coalesce(bool_and(has0 AND has1 AND clean), false) AND coalesce(bool_and(masked), false) AS pixel_ready, '{by}' AS by FROM
 (SELECT bool_or(label = 0) AS has0, bool_or(label = 1) AS has1, bool_and(coalesce(label IN (0, 1), false)) AS clean, bool_and(label = 0 OR {mask}) AS masked FROM lbl GROUP BY {key})"""
_Q = "q AS (SELECT image, round(quantile_cont(pred::DOUBLE, 0.9), 6) AS t FROM grid GROUP BY image)"
SQL = {
    "roc_curve": _with(LBL, CURVE) + "SELECT clsname, score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM curve",
    "image_auroc": _with(LBL, CURVE) + f"SELECT clsname, round(image_auroc, 6) AS image_auroc FROM ({AUROC})",
    "image_threshold": _with(LBL, CURVE) + YOUDEN,
    "metrics_by_category": _with(LBL, CURVE) + f"SELECT clsname, round(image_auroc, 6) AS image_auroc, image_threshold, n_images FROM (SELECT clsname, count(*)::BIGINT AS n_images FROM lbl GROUP BY clsname) LEFT JOIN ({AUROC}) USING (clsname) LEFT JOIN ({YOUDEN}) USING (clsname)",
    "metric_plugin": _with(LBL, CURVE) + f"SELECT clsname, n_images, mean_score, variance, round(image_auroc, 6) AS image_auroc FROM (SELECT clsname, count(*)::BIGINT AS n_images, round(avg(score / 1000), 6) AS mean_score, round(var_pop(score / 1000), 6) AS variance FROM lbl GROUP BY clsname) LEFT JOIN ({AUROC}) USING (clsname)",
    "metric_report": _with(LBL, CURVE, f"m AS (SELECT * FROM ({AUROC}) JOIN ({YOUDEN}) USING (clsname))") + "SELECT clsname, round(image_auroc, 6) AS image_auroc, image_threshold FROM m UNION ALL SELECT 'mean', round(avg(image_auroc), 6), NULL FROM m",
    "annotation_gates": _with(LBL) + " UNION ALL ".join(_GATE.format(by=b, key=k, mask=m) for b, k, m in (("lang", "clsname", "true"), ("source", "source", "true"), ("no masks", "clsname", "false"))),
    "shape_faults": _with(GRID) + "SELECT DISTINCT image, '8x8' AS pred_size, '8x7' AS truth_size FROM grid WHERE image % 5 <> 0 AND image % 7 = 0",
    "pixel_pairs": _with(GRID) + "SELECT image, clsname, sum(CASE WHEN image % 5 = 0 THEN 0 ELSE gt END)::BIGINT AS n_true, count(*)::BIGINT AS n FROM grid GROUP BY ALL",
    "label_fallback": _with(GRID) + "SELECT image, coalesce(any_value(l.toxic), max(CASE WHEN image % 5 = 0 THEN 0 ELSE gt END))::INT AS label FROM grid LEFT JOIN labels l ON l.doc_id = image GROUP BY image",
    "pixel_histogram": _with(GRID, HIST) + "SELECT clsname, bin, pos::BIGINT AS pos, neg::BIGINT AS neg FROM hist",
    "pixel_curve": _with(GRID, HIST, PCURVE) + "SELECT clsname, bin, round(edge, 6) AS edge, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM pcurve",
    "pixel_ap": _with(GRID, HIST, PCURVE) + f"SELECT clsname, round(pixel_auroc, 6) AS pixel_auroc, round(pixel_ap, 6) AS pixel_ap FROM ({PAUROC})",
    "pixel_f1": _with(GRID, HIST, PCURVE) + f"SELECT clsname, round(pixel_f1, 6) AS pixel_f1, round(pixel_threshold, 6) AS pixel_threshold FROM ({PF1})",
    "mask_regions": _with(GRID, REGIONS, recursive=True) + "SELECT image, y, x0, x1, region FROM regions",
    "pro": _with(
        GRID, REGIONS,
        "b AS (SELECT clsname, max(pred)::DOUBLE + greatest(2.220446049250313e-16, abs(max(pred)::DOUBLE) * 1e-12, abs(min(pred)::DOUBLE) * 1e-12) AS hi, min(pred)::DOUBLE - greatest(2.220446049250313e-16, abs(max(pred)::DOUBLE) * 1e-12, abs(min(pred)::DOUBLE) * 1e-12) AS lo FROM grid GROUP BY clsname)",
        "t AS (SELECT clsname, k, CASE WHEN k = 199 THEN lo ELSE hi + k * ((lo - hi) / 199) END AS t FROM b, range(0, 200) r(k))",
        "bg AS (SELECT t.clsname, k, count(*) FILTER (pred::DOUBLE >= t) / count(*) AS fpr FROM t JOIN grid g ON g.clsname = t.clsname AND gt = 0 GROUP BY ALL)",
        "px AS (SELECT g.clsname, g.image, r.region, g.pred::DOUBLE AS pred FROM grid g JOIN regions r ON g.image = r.image AND g.y = r.y AND g.x BETWEEN r.x0 AND r.x1)",
        "ov AS (SELECT clsname, k, avg(o) AS pro FROM (SELECT t.clsname, k, image, region, count(*) FILTER (pred >= t) / count(*) AS o FROM t JOIN px USING (clsname) GROUP BY ALL) GROUP BY ALL)",
        "c AS (SELECT clsname, fpr, max(pro) AS pro FROM bg JOIN ov USING (clsname, k) GROUP BY ALL)",
        "e AS (SELECT *, lead(fpr) OVER w AS f2, lead(pro) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY clsname ORDER BY fpr))",
        recursive=True,
    )
    + """SELECT clsname, round(least(greatest(sum((CASE WHEN f2 < 0.3 THEN f2 ELSE 0.3 END - fpr) * (CASE WHEN f2 < 0.3 THEN p2 WHEN f2 IS NULL THEN pro ELSE pro + (p2 - pro) * (0.3 - fpr) / (f2 - fpr) END + pro) / 2) / 0.3, 0), 1), 6)::DOUBLE AS pro FROM e WHERE fpr < 0.3 GROUP BY clsname""",
    "pixel_decisions": _with(GRID, _Q) + "SELECT image, y, x, pred >= t::FLOAT AS is_anomalous FROM grid JOIN q USING (image)",
    "anomaly_pixels": _with(GRID, _Q) + "SELECT image, count(*) FILTER (pred >= t::FLOAT)::BIGINT AS anomaly_pixel_count FROM grid JOIN q USING (image) GROUP BY image",
    "display_scale": _with(GRID, _Q)
    + "SELECT image, y, x, round(CASE WHEN image % 2 = 0 THEN least(greatest(v / (2 * t), 0), 1) WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6)::DOUBLE AS shown FROM (SELECT *, pred::DOUBLE AS v, min(pred::DOUBLE) OVER (PARTITION BY image) AS lo, max(pred::DOUBLE) OVER (PARTITION BY image) AS hi FROM grid JOIN q USING (image))",
}
for _name in ("pixel_histogram", "pixel_curve", "pixel_ap", "pixel_f1"):
    SQL[f"{_name}_full"] = SQL[_name].replace(HIST, _hist(evaluate.BINS)).replace(PCURVE, _pcurve(evaluate.BINS))
