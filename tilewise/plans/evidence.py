"""Queries on token evidence, thresholds and decisions, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.operators import calibrate, decide, features
from tilewise.sources import tables
from tilewise.sources.storage import shared_dir, stored
from tilewise.streaming import decisions

TOP_K = 2
PERCENTILE = 0.95
#: The training run of ``flagship_weighted``, and the rank of ``low_rank_detector``.
ROUNDS, PER_EPOCH, SHARE, FACTOR = 3, 3, 0.6, 0.1
RANK = 3

TOK = "tok AS (SELECT vec_id AS image, label AS clsname, vec_id % 4 <> 0 AS normal, t::INT AS token, embedding[16 * t + 1 : 16 * t + 16] AS enc FROM embeddings, range(0, 4) r(t))"
CEN = "cen AS (SELECT clsname, token, list(m ORDER BY dim) AS dec FROM (SELECT clsname, token, dim, avg(enc[dim]::DOUBLE) AS m FROM tok, range(1, 17) d(dim) WHERE normal GROUP BY ALL) GROUP BY clsname, token)"
DIST = """dist AS (SELECT image, clsname, normal, token, least(greatest(1 - list_inner_product(e, dec) / (greatest(sqrt(list_inner_product(e, e)), 1e-8) * greatest(sqrt(list_inner_product(dec, dec)), 1e-8)), 0), 2)::DOUBLE AS distance
  FROM (SELECT tok.*, enc::DOUBLE[] AS e, dec FROM tok JOIN cen USING (clsname, token)))"""
TOP = f"top AS (SELECT image, clsname, normal, avg(distance) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY distance DESC, token) AS k FROM dist) WHERE k <= {TOP_K} GROUP BY ALL)"
IMG = "img AS (SELECT image, clsname, normal, round(max(score), 6)::FLOAT AS score FROM top GROUP BY ALL)"
STAT = "stat AS (SELECT vec_id AS image, round(quantile_cont(v, 0.9), 6) AS pixel_stat FROM (SELECT vec_id, abs(unnest(embedding))::DOUBLE AS v FROM embeddings) GROUP BY vec_id)"
CAL = f"""cal AS (SELECT clsname::INT AS clsname, grouping(clsname) AS g, count(*)::BIGINT AS normal_image_count, quantile_cont(score::DOUBLE, {PERCENTILE}) AS threshold, quantile_cont(pixel_stat, {PERCENTILE}) AS pixel_threshold
  FROM img JOIN stat USING (image) WHERE normal GROUP BY GROUPING SETS ((), (clsname)))"""
DEC = """dec_ AS (SELECT i.image, i.clsname, i.score, coalesce(c.threshold, g.threshold)::FLOAT AS threshold, coalesce(c.pixel_threshold, g.pixel_threshold)::FLOAT AS pixel_threshold
  FROM img i LEFT JOIN (SELECT * FROM cal WHERE g = 0) c ON i.clsname = c.clsname CROSS JOIN (SELECT * FROM cal WHERE g = 1) g WHERE NOT i.normal)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tables.encoder_tokens(spark, sf_dir)
    return features.reconstruct_centroid(tokens, features.fit_centroids(tokens))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.token_distance(reconstructed(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, clsname, normal, score``."""
    return _scores(distances(spark, sf_dir))


def _scores(found: DataFrame) -> DataFrame:
    top = features.top_k_mean(found, ["image", "clsname", "normal"], TOP_K)
    return features.image_scores(top.withColumn("score", F.round("score", 6)), ["image", "clsname", "normal"])


def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.explode("embedding").alias("v")).withColumn("pred", F.abs("v"))
    return calibrate.map_quantile(cells, 0.9, ["image"]).withColumn("pixel_stat", F.round("pixel_stat", 6))


def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_of(scored(spark, sf_dir), pixel_stats(spark, sf_dir))


def calibration_of(scores: DataFrame, stats: DataFrame) -> DataFrame:
    normals = scores.filter("normal").join(stats, "image")
    return calibrate.calibrate(normals.select("clsname", "score", "pixel_stat"), PERCENTILE)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals set the thresholds, the others are judged; both come from one table of scores."""
    scores = stored(scored(spark, sf_dir), "scores")
    return decide.decide_images(scores.filter("NOT normal"), calibration_of(scores, pixel_stats(spark, sf_dir)))


def token_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("image", "token", F.round("distance", 6).alias("distance"))


def token_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens 0, 1 and 2, 3 as two layers of the same two places."""
    layers = distances(spark, sf_dir).withColumn("place", F.col("token") % 2)
    return features.token_max(layers, ["image", "place"]).select("image", F.col("place").cast("int").alias("place"), F.round("distance", 6).alias("distance"))


def topk_token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.top_k_mean(distances(spark, sf_dir), ["image"], TOP_K).select("image", F.round("score", 6).alias("score"))


def image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiles per image, of two tokens each."""
    tiles = distances(spark, sf_dir).withColumn("tile", F.floor(F.col("token") / 2))
    per_tile = features.top_k_mean(tiles, ["image", "tile"], 1)
    return features.image_scores(per_tile.withColumn("score", F.round("score", 6)), ["image"])


def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances with every 50th made NaN and every 70th infinite: the guard finds just those."""
    d = distances(spark, sf_dir).withColumn("distance", F.when(F.col("image") % 50 == 0, float("nan")).when(F.col("image") % 70 == 0, float("inf")).otherwise(F.col("distance")))
    return features.not_finite(d, "distance").select("image", "token")


def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("image", "clsname", "score")


def centroid_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("clsname", "normal").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("double")), 5).alias("mean_score"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_table(spark, sf_dir).select("clsname", "normal_image_count", F.round("threshold", 9).alias("threshold"), F.round("pixel_threshold", 9).alias("pixel_threshold"))


def threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("image", F.round(F.col("threshold").cast("double"), 5).alias("threshold"), F.round(F.col("pixel_threshold").cast("double"), 5).alias("pixel_threshold"))


def image_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("image", "clsname", "is_defect")


def map_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_stats(spark, sf_dir)


def feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = features.layer_mean(tables.encoder_tokens(spark, sf_dir), ["image"])
    return means.select("image", F.posexplode("mean").alias("dim", "m")).select("image", "dim", F.round("m", 6).alias("mean"))


def feature_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tokens as four scales, weighed 4, 2, 1, 1."""
    rows = tables.encoder_tokens(spark, sf_dir).select("image", F.col("token").alias("scale"), F.col("enc").alias("feature"))
    fused = features.fuse_resolutions(rows, ["image"], {0: 4.0, 1: 2.0, 2: 1.0, 3: 1.0})
    return fused.select("image", F.posexplode("fused").alias("dim", "m")).select("image", "dim", F.round("m", 6).alias("fused"))


def reconstruction_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = features.reconstruction_loss(reconstructed(spark, sf_dir), ["clsname", "image"])
    return loss.groupBy("clsname").agg(F.round(F.avg("loss"), 6).alias("loss"))


def hard_mining_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances(spark, sf_dir).filter("normal").withColumn("distance", F.round("distance", 6))
    weighed = features.hard_mining_weights(rows, ["clsname", "token"], ["image"], features.ramped_share(5, 10, 0.6), 0.1)
    return weighed.select("image", "token", "weight")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on normals, calibrate, judge the rest: counts per category."""
    return decided(spark, sf_dir).groupBy("clsname").agg(F.count("*").alias("n_images"), F.count_if("is_defect").alias("n_defects"))


def flagship_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with a training run: three rounds on source-fair samples, easy tokens weighed down."""
    tokens = tables.encoder_tokens(spark, sf_dir)
    model = features.fit_reweighted(tokens, ROUNDS, PER_EPOCH, SHARE, FACTOR)
    scores = stored(_scores(features.token_distance(features.reconstruct_centroid(tokens, model))), "scores")
    judged = decide.decide_images(scores.filter("NOT normal"), calibration_of(scores, pixel_stats(spark, sf_dir)))
    return judged.groupBy("clsname").agg(F.count("*").alias("n_images"), F.count_if("is_defect").alias("n_defects"), F.round(F.sum(F.col("score").cast("double")), 4).alias("total_score"))


def low_rank_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the low-rank model, three components for each category."""
    return _scores(features.token_distance(features.reconstruct_low_rank(tables.encoder_tokens(spark, sf_dir), RANK)))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the days since the first one."""
    e = tables.event_scores(spark, sf_dir)
    begin = e.agg(F.min("ts").alias("begin"))
    return e.crossJoin(F.broadcast(begin)).withColumn("early", F.col("ts") < F.col("begin") + F.expr("INTERVAL 7 DAYS"))


def _early_thresholds(dated: DataFrame) -> DataFrame:
    return calibrate.calibrate(dated.filter("early").select("clsname", "score"), 0.9)


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the events after the first seven days, with thresholds from those days."""
    dated = _dated(spark, sf_dir)
    return decide.decide_images(dated.filter("NOT early").select("event_id", "clsname", "score"), _early_thresholds(dated)).select("event_id", "clsname", "is_defect")


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions by Structured Streaming: later events arrive in two parts, and the
    stream, with thresholds from a store, is started anew for the second."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    dated = _dated(spark, sf_dir)
    calibrate.save(_early_thresholds(dated), f"{root}/calibration")
    late = dated.filter("NOT early").withColumn("first", F.col("ts") < F.col("begin") + F.expr("INTERVAL 18 DAYS"))
    parts = (late.filter(part).select("event_id", "clsname", "score") for part in ("first", "NOT first"))
    decided = decisions.decide_arrivals(parts, calibrate.load(spark, f"{root}/calibration"), root)
    return decided.select("event_id", "clsname", "is_defect")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).select(
        F.col("image").alias("ordinal"), F.concat(F.lit("img/"), F.col("image").cast("string"), F.lit(".png")).alias("filename"), F.col("clsname").cast("string").alias("clsname"),
        F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("label_name"), F.floor(F.col("score").cast("double") * 1000).cast("long").alias("score"),
        "is_defect", F.when(F.col("is_defect"), F.lit("masks/x.png")).alias("prediction_mask"),
    )
    return decide.prediction_json(rows)


def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.manifest_lines(spark, sf_dir).select("ordinal", F.concat(F.lit("a.b/"), F.col("ordinal").cast("string"), F.when(F.col("ordinal") % 2 == 0, ".x.png").otherwise("")).alias("filename"))
    return rows.select("ordinal", decide.mask_name().alias("name"))


QUERIES = {
    "flagship": flagship,
    "flagship_weighted": flagship_weighted,
    "low_rank_detector": low_rank_detector,
    "token_distance": token_distance,
    "token_max": token_max,
    "topk_token_score": topk_token_score,
    "image_score": image_score,
    "finite_guard": finite_guard,
    "detector_scores": detector_scores,
    "centroid_detector": centroid_detector,
    "calibration": calibration,
    "threshold_lookup": threshold_lookup,
    "image_decisions": image_decisions,
    "map_quantile": map_quantile,
    "feature_mean": feature_mean,
    "feature_fusion": feature_fusion,
    "reconstruction_loss": reconstruction_loss,
    "hard_mining_weights": hard_mining_weights,
    "stream_decisions": stream_decisions,
    "stream_restart": stream_restart,
    "predictions": predictions,
    "mask_names": mask_names,
}



def _round(epoch: int) -> tuple[str, ...]:
    """The sample of a round, its weights by the round before, and its centroids."""
    sample = f"s{epoch} AS (SELECT image, clsname, token, enc FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY md5(concat('s:', image, ':', token)), token) - 1 AS p, count(*) OVER (PARTITION BY image) AS n FROM tok WHERE normal) WHERE ((p - {epoch * PER_EPOCH}) % n + n) % n < least({PER_EPOCH}, n))"
    share = SHARE * epoch / (ROUNDS - 1)
    distance = DIST.replace("dist AS", f"d{epoch} AS").replace("FROM tok JOIN cen", f"FROM s{epoch} tok JOIN c{epoch - 1}").replace("normal, token, least", "token, least")
    weighed = f"w{epoch} AS (SELECT clsname, token, enc, CASE WHEN row_number() OVER (PARTITION BY clsname, token ORDER BY distance, image) <= floor(count(*) OVER (PARTITION BY clsname, token) * {share}::DOUBLE) THEN {FACTOR}::DOUBLE ELSE 1 END AS w FROM s{epoch} JOIN (SELECT image, token, round(distance, 6) AS distance FROM d{epoch}) USING (image, token))"
    rows = f"w{epoch}" if epoch else "(SELECT *, 1::DOUBLE AS w FROM s0)"
    fit = f"c{epoch} AS (SELECT clsname, token, list(m ORDER BY dim) AS dec FROM (SELECT clsname, token, dim, sum(w * enc[dim]::DOUBLE) / sum(w) AS m FROM {rows}, range(1, 17) d(dim) GROUP BY ALL) GROUP BY clsname, token)"
    return (sample, distance, weighed, fit) if epoch else (sample, fit)


_BASE = (TOK, CEN, DIST)
_TRAINED = (TOK, *[part for epoch in range(ROUNDS) for part in _round(epoch)], DIST.replace("JOIN cen", f"JOIN c{ROUNDS - 1}"))
_ALL = (*_BASE, TOP, IMG, STAT, CAL, DEC)
SQL = {
    "flagship": _with(*_ALL) + "SELECT clsname, count(*)::BIGINT AS n_images, count(*) FILTER (score > threshold)::BIGINT AS n_defects FROM dec_ GROUP BY clsname",
    "flagship_weighted": _with(*_TRAINED, TOP, IMG, STAT, CAL, DEC) + "SELECT clsname, count(*)::BIGINT AS n_images, count(*) FILTER (score > threshold)::BIGINT AS n_defects, round(sum(score::DOUBLE), 4) AS total_score FROM dec_ GROUP BY clsname",
    "token_distance": _with(*_BASE) + "SELECT image, token, round(distance, 6) AS distance FROM dist",
    "token_max": _with(*_BASE) + "SELECT image, (token % 2)::INT AS place, round(max(distance), 6) AS distance FROM dist GROUP BY ALL",
    "topk_token_score": _with(*_BASE, TOP) + "SELECT image, round(score, 6) AS score FROM top",
    "image_score": _with(*_BASE) + "SELECT image, round(max(distance), 6)::FLOAT AS score FROM dist GROUP BY image",
    "finite_guard": _with(*_BASE) + "SELECT image, token FROM dist WHERE image % 50 = 0 OR image % 70 = 0",
    "detector_scores": _with(*_BASE, TOP, IMG) + "SELECT image, clsname, score FROM img",
    "centroid_detector": _with(*_BASE, TOP, IMG) + "SELECT clsname, normal, count(*)::BIGINT AS n, round(avg(score::DOUBLE), 5) AS mean_score FROM img GROUP BY ALL",
    "calibration": _with(*_BASE, TOP, IMG, STAT, CAL) + "SELECT clsname, normal_image_count, round(threshold, 9) AS threshold, round(pixel_threshold, 9) AS pixel_threshold FROM cal",
    "threshold_lookup": _with(*_ALL) + "SELECT image, round(threshold::DOUBLE, 5) AS threshold, round(pixel_threshold::DOUBLE, 5) AS pixel_threshold FROM dec_",
    "image_decisions": _with(*_ALL) + "SELECT image, clsname, score > threshold AS is_defect FROM dec_",
    "map_quantile": _with(STAT) + "SELECT image, pixel_stat FROM stat",
    "feature_mean": _with(TOK) + "SELECT image, (dim - 1)::INT AS dim, round(avg(enc[dim]::DOUBLE), 6) AS mean FROM tok, range(1, 17) d(dim) GROUP BY ALL",
    "feature_fusion": _with(TOK) + "SELECT image, (dim - 1)::INT AS dim, round(sum(enc[dim]::DOUBLE * [0.5, 0.25, 0.125, 0.125][token + 1]), 6)::DOUBLE AS fused FROM tok, range(1, 17) d(dim) GROUP BY image, dim",
    "reconstruction_loss": _with(TOK, CEN)
    + """SELECT clsname, round(avg(loss), 6) AS loss FROM (SELECT clsname, image, 1 - sum(ab) / (sqrt(sum(aa)) * sqrt(sum(bb))) AS loss FROM
 (SELECT clsname, image, list_inner_product(enc::DOUBLE[], dec) AS ab, list_inner_product(enc::DOUBLE[], enc::DOUBLE[]) AS aa, list_inner_product(dec, dec) AS bb FROM tok JOIN cen USING (clsname, token)) GROUP BY ALL) GROUP BY clsname""",
    "hard_mining_weights": _with(*_BASE)
    + """SELECT image, token, CASE WHEN row_number() OVER (PARTITION BY clsname, token ORDER BY distance, image) <= floor(count(*) OVER (PARTITION BY clsname, token) * 0.3) THEN 0.1 ELSE 1.0 END::DOUBLE AS weight
 FROM (SELECT image, clsname, token, round(distance, 6) AS distance FROM dist WHERE normal)""",
    "stream_decisions": """WITH e AS (SELECT event_id, event_type AS clsname, value AS score, ts < (SELECT min(ts) FROM events) + INTERVAL 7 DAY AS early FROM events),
c AS (SELECT clsname, quantile_cont(score, 0.9) AS t FROM e WHERE early GROUP BY clsname), g AS (SELECT quantile_cont(score, 0.9) AS t FROM e WHERE early)
SELECT event_id, e.clsname, score::FLOAT > coalesce(c.t, g.t)::FLOAT AS is_defect FROM e LEFT JOIN c ON e.clsname = c.clsname CROSS JOIN g WHERE NOT early""",
    "predictions": _with(*_ALL)
    + """SELECT image AS ordinal, concat('{"filename":"img/', image, '.png","clsname":"', clsname, '","label":null,"label_name":null,"score":', floor(score::DOUBLE * 1000)::BIGINT, ',"is_defect":', CASE WHEN score > threshold THEN 'true,"prediction_mask":"masks/x.png"' ELSE 'false' END, '}') AS value FROM dec_""",
    "mask_names": "SELECT doc_id AS ordinal, format('masks/{:06d}_{}.png', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(doc_id, '.x') ELSE doc_id::VARCHAR END) AS name FROM documents",
}
SQL["stream_restart"] = SQL["stream_decisions"]
