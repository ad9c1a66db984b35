"""Stars, vectors, evaluation, splits, augmentation and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footreach.constants import CATEGORIES
from footreach.functions import scalars as S
from footreach.functions import vectors as V
from footreach.operators import augment as AU
from footreach.operators import evaluate as E
from footreach.operators import features as FT
from footreach.operators import learn as L
from footreach.operators import quantiles as Q
from footreach.operators import split as SP
from footreach.plans import bindings as B
from footreach.plans.access import nearest_by_category
from footreach.plans.registry import query, r6
from footreach.sources import writers as WR

# ---- stars: customers on a 100 m lattice, cells of a 300 m disc, services within 500 m of each cell ----

STAR_R, STAR_CELL = 300.0, 100.0


def star_targets(spark, sf):
    return B.targets(spark, sf).selectExpr("'all' AS neighborhood_name", "target_id", "home", "floor(x / 100D) AS ix", "floor(y / 100D) AS iy")


def stars(spark, sf):
    t = star_targets(spark, sf)
    cells = FT.star_cells(t, STAR_R, STAR_CELL, STAR_CELL).selectExpr("*", "ix * 100D AS x", "iy * 100D AS y")
    cells = FT.feature_vector(FT.service_counts(cells, B.services(spark, sf), 500.0)).select("neighborhood_name", "ix", "iy", "features")
    out = FT.assemble_stars(t, cells, STAR_R, STAR_CELL, STAR_CELL)
    own = F.filter("neighbor_data", lambda s: s["euclidean_distance"] == 0)
    return out.withColumn("target_features", F.get(own, F.lit(0))["features"])


_STARS = """
, tl AS (SELECT target_id, home, CAST(floor(x / 100) AS bigint) AS ix, CAST(floor(y / 100) AS bigint) AS iy FROM targets),
offs AS (SELECT i, j FROM (SELECT unnest(generate_series(-3, 3)) AS i), (SELECT unnest(generate_series(-3, 3)) AS j) WHERE i * i + j * j <= 9),
cell AS (SELECT DISTINCT ix + i AS cx, iy + j AS cy FROM tl, offs),
near AS (SELECT cx, cy, category_index, count(*) AS n FROM cell, services WHERE (cx * 100 - fx) * (cx * 100 - fx) + (cy * 100 - fy) * (cy * 100 - fy) <= 250000 GROUP BY ALL),
cf AS (SELECT cx, cy, coalesce(sum(n), 0) AS total, coalesce(sum(CASE WHEN category_index = 2 THEN n END), 0) AS grocery FROM cell LEFT JOIN near USING (cx, cy) GROUP BY 1, 2),
star AS (SELECT target_id, home, i, j, sqrt(i * i + j * j) * 100 AS d, total, grocery,
  row_number() OVER (PARTITION BY target_id ORDER BY i, j) - 1 AS k FROM tl, offs JOIN cf ON cx = ix + i AND cy = iy + j)"""


def _total(v):
    return V.vsum(F.slice(v, 22, 8))


@query("star_assembly", "N7 G5 G6 A2 P15 P16", B.sql("targets services", _STARS + """
SELECT target_id, count(*) AS num_neighbors, round(CAST(sum(total) AS double), 6) AS services_around, round(sum(total * d), 3) AS weighted, round(CAST(max(CASE WHEN d = 0 THEN total END) AS double), 6) AS own
FROM star GROUP BY 1"""))
def star_assembly(spark, sf):
    s = stars(spark, sf)
    around = F.aggregate("neighbor_data", F.lit(0.0), lambda a, n: a + _total(n["features"]))
    weighted = F.aggregate("neighbor_data", F.lit(0.0), lambda a, n: a + _total(n["features"]) * n["euclidean_distance"])
    return s.select("target_id", F.col("num_neighbors").cast("bigint").alias("num_neighbors"), r6(around).alias("services_around"), F.round(weighted, 3).alias("weighted"),
                    r6(_total(F.col("target_features"))).alias("own"))


@query("star_graph", "N7 P17", B.sql("targets services", _STARS + """
SELECT target_id, count(*) + 1 AS node_rows, count(*) AS edge_rows, round(sum(abs(i) * 100 / 1000), 6) AS dx_abs, round(sum(d / 1000), 6) AS d_sum FROM star GROUP BY 1"""))
def star_graph(spark, sf):
    g = FT.star_graph(stars(spark, sf))
    return g.select("target_id", F.size("x").cast("bigint").alias("node_rows"), F.size("edge_index").cast("bigint").alias("edge_rows"),
                    r6(F.aggregate("edge_attr", F.lit(0.0), lambda a, e: a + F.abs(e[0]))).alias("dx_abs"),
                    r6(F.aggregate("edge_attr", F.lit(0.0), lambda a, e: a + e[2])).alias("d_sum"))


@query("pooled_neighbours", "M1", B.sql("targets services", _STARS + """
SELECT target_id, round(avg(grocery), 6) AS mean_grocery, round(sum(grocery / (d / 1000 + 0.1e0)) / sum(1 / (d / 1000 + 0.1e0)), 6) AS near_grocery FROM star GROUP BY 1"""))
def pooled_neighbours(spark, sf):
    s = stars(spark, sf)
    out = L.pool_neighbours(L.pool_neighbours(s).withColumnRenamed("pooled", "a"), "inverse")
    return out.select("target_id", r6(F.get("a", F.lit(23))).alias("mean_grocery"), r6(F.get("pooled", F.lit(23))).alias("near_grocery"))


_U = "(('0x' || substr(md5({k} || '|{s}'), 1, 8))::UBIGINT / 4294967296.0)"


def _normal(keys: str, seed: str) -> str:
    return f"sqrt(-2 * ln(greatest({_U.format(k=keys, s=seed + 'a')}, 1e-10))) * cos(2 * pi() * {_U.format(k=keys, s=seed + 'b')})"


@query("sampled_neighbours", "W11 R2", B.sql("targets services", _STARS + f"""
, b AS (SELECT *, {_U.format(k="target_id || '|' || k", s='42')} AS u, CASE WHEN d / 300 < 0.3 THEN 0 WHEN d / 300 < 0.6 THEN 1 WHEN d / 300 < 0.9 THEN 2 WHEN d / 300 < 1 THEN 3 END AS band FROM star),
q AS (SELECT *, row_number() OVER (PARTITION BY target_id, band ORDER BY u, k) AS r, count(*) OVER (PARTITION BY target_id, band) AS n FROM b)
SELECT target_id, count(*) AS kept, round(sum(d), 4) AS distance_sum FROM q WHERE band IS NOT NULL AND r <= greatest(1, floor(n * 0.8e0)) GROUP BY 1"""))
def sampled_neighbours(spark, sf):
    out = AU.subsample(stars(spark, sf), 0.8, 3, 42, scale=STAR_R)
    return out.select("target_id", F.col("num_neighbors").cast("bigint").alias("kept"),
                      F.round(F.aggregate("neighbor_data", F.lit(0.0), lambda a, n: a + n["euclidean_distance"]), 4).alias("distance_sum"))


_K = "target_id || '|' || k"


@query("edge_noise", "R3 P17", B.sql("targets services", _STARS + f"""
, z AS (SELECT target_id, d / 1000 AS e, i * 100 / 1000e0 AS x, {_normal(_K, '7e')} AS ze, {_normal(_K, '7x')} AS zx, {_normal(_K, '7n')} AS zn FROM star),
m AS (SELECT *, least(greatest(e + ze * 0.02e0 * e, 0e0), 1.000001e0) AS e2 FROM z)
SELECT target_id, round(sum(e2), 5) AS euclidean, round(sum(greatest(least(greatest(e + zn * 0.02e0 * e, 0e0), 1.000001e0), e2)), 5) AS network,
  round(sum(least(greatest((x + zx * 0.02e0) * CASE WHEN e > 1e-6 THEN e2 / e ELSE 1e0 END, 0e0), 1.000001e0)), 5) AS dx FROM m GROUP BY 1"""))
def edge_noise(spark, sf):
    out = AU.edge_noise(FT.star_graph(stars(spark, sf)).select("target_id", "edge_attr"), seed=7)

    def total(i):
        return F.round(F.aggregate("edge_attr", F.lit(0.0), lambda a, e: a + e[i]), 5)
    return out.select("target_id", total(2).alias("euclidean"), total(3).alias("network"), total(0).alias("dx"))


def _feature_rows(spark, sf):
    return B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("target_id"), V.fit_length("embedding", 33).alias("target_features"))


def _clamped(v: str) -> str:
    return (f"CASE WHEN i = 2 THEN least(greatest({v}, -3e0), 3e0) WHEN i BETWEEN 3 AND 17 OR i IN (32, 33) THEN least(greatest({v}, 0e0), 1.000001e0) "
            f"WHEN i = 20 THEN least(greatest({v}, 0e0), 20e0) WHEN i = 31 THEN least(greatest({v}, 0e0), 500e0) ELSE greatest({v}, 0e0) END")


@query("feature_noise", "R1 P18 P15", f"""
WITH n AS (SELECT vec_id AS target_id, unnest(list_transform(embedding[1:33], lambda v, i: {{'v': v::DOUBLE, 'i': i}}), recursive := true) FROM embeddings),
z AS (SELECT target_id, i, v + 0.01e0 * {_normal("target_id || '|t|' || (i - 1)", '42')} AS v FROM n)
SELECT target_id, round(sum({_clamped('v')}), 6) AS total, round(max({_clamped('v')}), 6) AS top FROM z GROUP BY 1""")
def feature_noise(spark, sf):
    out = AU.feature_noise(_feature_rows(spark, sf), 0.01, 42, neighbors=False)
    return out.select("target_id", r6(V.vsum("target_features")).alias("total"), r6(F.array_max("target_features")).alias("top"))


@query("clamped_features", "P18 P16", f"""
WITH n AS (SELECT vec_id AS target_id, unnest(list_transform(embedding[1:33], lambda v, i: {{'v': v::DOUBLE * 9, 'i': i}}), recursive := true) FROM embeddings)
SELECT target_id, round(sum({_clamped('v')}), 6) AS total, round(min({_clamped('v')}), 6) AS low FROM n GROUP BY 1""")
def clamped_features(spark, sf):
    v = V.clamp_features(V.finite_or_zero(F.transform("target_features", lambda x: x * 9.0)))
    return _feature_rows(spark, sf).withColumn("c", v).select("target_id", r6(V.vsum("c")).alias("total"), r6(F.array_min("c")).alias("low"))


@query("composed_augmentation", "R4 R1 R2", B.sql("targets services", _STARS + f"""
, feats AS (SELECT target_id, s.i, CAST(coalesce(n, 0) AS double) AS v FROM tl CROSS JOIN (SELECT unnest(generate_series(1, 33)) AS i) s LEFT JOIN near ON cx = ix AND cy = iy AND category_index = s.i - 22),
noisy AS (SELECT target_id, i, v AS old, v + 0.01e0 * {_normal("target_id || '|t|' || (i - 1)", '42')} AS v FROM feats),
vec AS (SELECT target_id, CASE WHEN {_U.format(k='target_id', s='42gate0')} < 0.8 THEN sum({_clamped('v')}) ELSE sum(old) END AS total FROM noisy GROUP BY target_id),
bands AS (SELECT target_id, CASE WHEN d / 300 < 0.3 THEN 0 WHEN d / 300 < 0.6 THEN 1 WHEN d / 300 < 0.9 THEN 2 WHEN d / 300 < 1 THEN 3 END AS band, count(*) AS n FROM star GROUP BY 1, 2),
kept AS (SELECT target_id, sum(n) AS n, sum(CASE WHEN band IS NOT NULL THEN greatest(1, floor(n * 0.8e0)) END) AS few FROM bands GROUP BY 1)
SELECT target_id, CAST(CASE WHEN n > 3 AND {_U.format(k='target_id', s='42gate1')} < 0.5 THEN greatest(few, 3) ELSE n END AS int) AS num_neighbors, round(total, 6) AS feature_sum FROM vec JOIN kept USING (target_id)"""))
def composed_augmentation(spark, sf):
    """Seeded chain of feature noise and subsampling, each behind a gate per row."""
    out = AU.augment(stars(spark, sf).select("target_id", "target_features", "neighbor_data", "num_neighbors"), [
        (lambda d: AU.feature_noise(d, 0.01, 42, neighbors=False), 0.8), (lambda d: AU.subsample(d, 0.8, 3, 42, scale=STAR_R), 0.5)], 42)
    return out.select("target_id", "num_neighbors", r6(V.vsum("target_features")).alias("feature_sum"))


# ---- vectors on predictions ----------------------------------------------------------------------

def _kl(p: str, q: str, eps_p: str, log_q: str) -> str:
    return f"list_sum(list_transform(generate_series(1, 8), lambda i: {p}[i] * (ln({p}[i] + {eps_p}) - {log_q})))"


_LOGQ = "(logits[i] - list_max(logits) - ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))))"


@query("divergences", "F3 F4 F5 F2", B.sql("preds", f"""
, c AS (SELECT *, list_transform(target_probs, lambda x: least(greatest(x, 1e-9), 1e0)) AS t0 FROM preds),
d AS (SELECT *, list_transform(t0, lambda x: x / list_sum(t0)) AS t FROM c)
SELECT target_id, round({_kl('target_probs', 'predicted_probs', '1e-8', 'ln(predicted_probs[i] + 1e-8)')}, 6) AS kl,
  round(list_sum(list_transform(generate_series(1, 8), lambda i: t[i] * (ln(t[i]) - {_LOGQ}))), 6) AS kl_loss,
  round({_kl('target_probs', 'predicted_probs', '1e-8', _LOGQ)}, 6) AS kl_from_logits FROM d"""))
def divergences(spark, sf):
    return B.predictions(spark, sf).select("target_id", r6(V.kl("target_probs", "predicted_probs")).alias("kl"), r6(V.kl_loss("logits", "target_probs")).alias("kl_loss"),
                                           r6(V.kl_from_logits("logits", "target_probs")).alias("kl_from_logits"))


@query("vector_scores", "F6 F7 F8 F14 F15 F21 F11", B.sql("preds", """
, s AS (SELECT *, list_transform(target_probs, lambda x: 0.9e0 * x + 0.0125e0) AS sm, -list_sum(list_transform(predicted_probs, lambda x: x * ln(x))) AS h,
  sqrt(list_sum(list_transform(logits, lambda x: x * x))) AS len FROM preds)
SELECT target_id, round(list_max(sm), 6) AS smoothed_top, round(h, 6) AS entropy, round(greatest(2 - h, 0e0), 6) AS linear_penalty,
  round(greatest(2 - h, 0e0) * greatest(2 - h, 0e0), 6) AS quadratic_penalty, round(CASE WHEN list_max(logits) > 1 THEN list_max(logits) ELSE 0e0 END, 6) AS max_logit,
  round(list_max(logits) / (len + 1e-8) / 2, 6) AS normed_top, round(CASE WHEN list_sum(logits) > 0 THEN logits[1] / list_sum(logits) ELSE 0.125e0 END, 4) AS normalised_first,
  round(list_max(logits) - list_min(logits), 6) AS spread FROM s"""))
def vector_scores(spark, sf):
    return B.predictions(spark, sf).filter(V.check_vector("logits").isNull() & V.same_shape("logits", "target_probs")).select(
        "target_id", r6(F.array_max(V.smooth("target_probs", 0.1))).alias("smoothed_top"), r6(V.entropy("predicted_probs")).alias("entropy"),
        r6(V.entropy_penalty("predicted_probs", 2.0)).alias("linear_penalty"), r6(V.entropy_penalty("predicted_probs", 2.0, "quadratic")).alias("quadratic_penalty"),
        r6(V.max_logit_penalty("logits", 1.0)).alias("max_logit"), r6(F.array_max(V.logit_norm("logits", 1.0, 2.0))).alias("normed_top"),
        F.round(F.get(V.normalise("logits"), F.lit(0)), 4).alias("normalised_first"), r6(V.array_range("logits")).alias("spread"))


@query("focal_losses", "F9 F10", B.sql("preds", f"""
, c AS (SELECT *, list_transform(target_probs, lambda x: least(greatest(x, 1e-9), 1e0)) AS t0 FROM preds), d AS (SELECT *, list_transform(t0, lambda x: x / list_sum(t0)) AS t FROM c),
r AS (SELECT list_transform(generate_series(1, 8), lambda i: t[i] * (ln(t[i]) - {_LOGQ}) * pow(1 - predicted_probs[i], 2) * (1 + i / 10)) AS terms FROM d)
SELECT round(avg(list_sum(terms)), 6) AS batchmean, round(sum(list_sum(terms)) / sum(len(terms)), 6) AS mean, round(sum(list_sum(terms)), 4) AS total FROM r"""))
def focal_losses(spark, sf):
    terms = B.predictions(spark, sf).select(V.focal(V.kl_terms("logits", "target_probs"), "predicted_probs", 2.0, [1 + (i + 1) / 10 for i in range(8)]).alias("terms"))
    per_row = terms.select(V.vsum("terms").alias("loss"), F.size("terms").alias("n"))
    return per_row.agg(r6(F.avg("loss")).alias("batchmean"), r6(F.sum("loss") / F.sum("n")).alias("mean"), F.round(F.sum("loss"), 4).alias("total"))


@query("reduced_loss", "F10", B.sql("preds", """
SELECT round(avg(list_sum(list_transform(generate_series(1, 8), lambda i: abs(target_probs[i] - predicted_probs[i]))) / 8), 6) AS loss FROM preds"""))
def reduced_loss(spark, sf):
    t = B.predictions(spark, sf).select(F.zip_with("target_probs", "predicted_probs", lambda a, b: F.abs(a - b)).alias("terms"))
    return E.reduce_loss(t, "terms", "mean").withColumn("loss", r6("loss"))


_TOP3 = "list_transform(list_sort(list_transform(generate_series(1, 8), lambda i: {{'p': -{v}[i], 'i': i - 1}}))[1:3], lambda s: s['i'])"


@query("top_categories", "W1 W2 F12 U5", B.sql("preds", f"""
, t AS (SELECT *, {_TOP3.format(v='predicted_probs')} AS a, {_TOP3.format(v='target_probs')} AS b FROM preds)
SELECT target_id, CAST(list_position(predicted_probs, list_max(predicted_probs)) - 1 AS int) AS predicted_class, array_to_string(a, ',') AS top3,
  len(list_intersect(a, b)) > 0 AS hit3, a[1] = b[1] AS hit1 FROM t"""))
def top_categories(spark, sf):
    return B.predictions(spark, sf).select("target_id", V.argmax_class("predicted_probs").alias("predicted_class"),
                                           F.array_join(V.top_k("predicted_probs", 3).cast("array<string>"), ",").alias("top3"),
                                           V.top_k_hit("predicted_probs", "target_probs", 3).alias("hit3"), V.top_k_hit("predicted_probs", "target_probs", 1).alias("hit1"))


_CLS = """
, k AS (SELECT *, CAST(list_position(predicted_probs, list_max(predicted_probs)) - 1 AS int) AS pc, CAST(list_position(target_probs, list_max(target_probs)) - 1 AS int) AS tc,
  list_max(predicted_probs) AS conf FROM preds)"""


@query("class_weights", "A12 W1", B.sql("preds categories", _CLS + """
, n AS (SELECT tc AS class, count(*) AS c FROM k GROUP BY 1)
SELECT category_index AS class, coalesce(c, 0) AS "count", round(least(sqrt(CASE WHEN c > 0 THEN (SELECT count(*) FROM k) / c ELSE 1e0 END), 3e0), 6) AS weight
FROM categories LEFT JOIN n ON class = category_index"""))
def class_weights(spark, sf):
    return E.class_weights(B.predictions(spark, sf), "target_probs").withColumn("weight", r6("weight"))


@query("class_distribution", "A13", B.sql("preds categories", """
SELECT category_index AS class, round((SELECT avg(predicted_probs[category_index + 1]) FROM preds), 6) AS predicted, round((SELECT avg(target_probs[category_index + 1]) FROM preds), 6) AS target FROM categories"""))
def class_distribution(spark, sf):
    p = B.predictions(spark, sf)
    a = E.class_distribution(p, "predicted_probs").withColumnRenamed("mean", "predicted")
    b = E.class_distribution(p, "target_probs").withColumnRenamed("mean", "target")
    return a.join(b, "class").select("class", r6("predicted").alias("predicted"), r6("target").alias("target"))


@query("per_class_recall", "A14", B.sql("preds categories", _CLS + """
SELECT category_index AS class, count(tc) AS support, round(coalesce(avg(CASE WHEN pc = tc THEN 1e0 WHEN tc IS NOT NULL THEN 0e0 END), 0e0), 6) AS recall
FROM categories LEFT JOIN k ON tc = category_index GROUP BY 1"""))
def per_class_recall(spark, sf):
    return E.per_class_recall(B.predictions(spark, sf)).withColumn("recall", r6("recall"))


@query("group_accuracy", "A15 W3", B.sql("preds", _CLS + """
SELECT neighborhood_name, count(*) AS "count", round(avg(CASE WHEN pc = tc THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def group_accuracy(spark, sf):
    return E.group_accuracy(B.predictions(spark, sf), top_n=20).withColumn("accuracy", r6("accuracy"))


_REL = _CLS + """
, b AS (SELECT CAST(i AS int) AS bin, i / 10 AS lo, (i + 1) / 10 AS hi FROM (SELECT unnest(generate_series(0, 9)) AS i)),
rel AS (SELECT bin, count(pc) AS n, coalesce(avg(CASE WHEN pc = tc THEN 1e0 WHEN pc IS NOT NULL THEN 0e0 END), 0e0) AS acc, coalesce(avg(conf), (bin + 0.5e0) / 10) AS cf
  FROM b LEFT JOIN k ON conf > lo AND conf <= hi GROUP BY bin)"""


@query("reliability_bins", "A16", B.sql("preds", _REL + 'SELECT bin, n AS "count", round(acc, 6) AS accuracy, round(cf, 6) AS confidence FROM rel'))
def reliability_bins(spark, sf):
    return E.reliability(B.predictions(spark, sf)).select("bin", "count", r6("accuracy").alias("accuracy"), r6("confidence").alias("confidence"))


@query("calibration_error", "A16", B.sql("preds", _REL + "SELECT round(sum(n / (SELECT count(*) FROM preds) * abs(acc - cf)), 6) AS ece FROM rel"))
def calibration_error(spark, sf):
    return E.ece(B.predictions(spark, sf)).withColumn("ece", r6("ece"))


_ENT = """, e AS (SELECT -list_sum(list_transform(predicted_probs, lambda x: x * ln(x + 1e-12))) AS p, -list_sum(list_transform(target_probs, lambda x: x * ln(x + 1e-12))) AS t FROM preds)"""


@query("entropy_summary", "A17", B.sql("preds", _ENT + " SELECT count(*) AS n, round(avg(p), 6) AS mean_pred_entropy, round(avg(t), 6) AS mean_target_entropy FROM e"))
def entropy_summary(spark, sf):
    return E.entropy_summary(B.predictions(spark, sf)).select("n", r6("mean_pred_entropy").alias("mean_pred_entropy"), r6("mean_target_entropy").alias("mean_target_entropy"))


def _hist_sql(source: str, v: str, bins: int) -> str:
    return f""", m AS (SELECT min({v}) AS a, max({v}) AS z FROM {source}), w AS (SELECT a, (z - a) / {bins} AS w FROM m),
bb AS (SELECT CAST(unnest(generate_series(0, {bins - 1})) AS int) AS bin), h AS (SELECT CAST(least(floor(({v} - a) / w), {bins - 1}) AS int) AS bin, count(*) AS c FROM {source}, w GROUP BY 1)
SELECT bin, round(a + w * bin, 6) AS lo, round(a + w * (bin + 1), 6) AS hi, coalesce(c, 0) AS "count" FROM bb CROSS JOIN w LEFT JOIN h USING (bin)"""


@query("entropy_histogram", "A17 A18", B.sql("preds", _ENT + _hist_sql("e", "p", 30)))
def entropy_histogram(spark, sf):
    return E.entropy_histogram(B.predictions(spark, sf)).select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "count")


@query("price_histogram", "A18", "WITH x AS (SELECT 1) " + _hist_sql("orders", "o_totalprice", 50))
def price_histogram(spark, sf):
    return Q.histogram(B.table(spark, sf, "orders"), "o_totalprice", 50).select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "count")


@query("box_plots", "A19", """
SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
FROM lineitem GROUP BY 1""")
def box_plots(spark, sf):
    out = Q.box_plot(B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), "l_extendedprice", ["flag"])
    return out.select("flag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("overall_quantiles", "A19", """
SELECT p AS prob, round(CASE WHEN p = 0.1e0 THEN quantile_cont(l_quantity, 0.1) WHEN p = 0.5e0 THEN quantile_cont(l_quantity, 0.5) ELSE quantile_cont(l_quantity, 0.99) END, 6) AS value
FROM lineitem, (VALUES (0.1e0), (0.5e0), (0.99e0)) v(p) GROUP BY p""")
def overall_quantiles(spark, sf):
    return Q.quantiles(B.table(spark, sf, "lineitem"), "l_quantity", [0.1, 0.5, 0.99]).withColumn("value", r6("value"))


@query("evaluation_summary", "A20 F3 F12 K7", B.sql("preds", f"""
, t AS (SELECT *, {_TOP3.format(v='predicted_probs')} AS a, {_TOP3.format(v='target_probs')} AS b, {_kl('target_probs', 'predicted_probs', '1e-8', 'ln(predicted_probs[i] + 1e-8)')} AS kl FROM preds)
SELECT round(avg(kl), 6) AS kl_divergence, round(avg(CASE WHEN a[1] = b[1] THEN 1e0 ELSE 0e0 END), 6) AS top1_accuracy,
  round(avg(CASE WHEN len(list_intersect(a, b)) > 0 THEN 1e0 ELSE 0e0 END), 6) AS top3_accuracy, count(*) AS num_samples FROM t"""))
def evaluation_summary(spark, sf):
    """Evaluated, written as JSON, read back."""
    path = B.scratch(spark, "evaluation")
    WR.write_evaluation(E.evaluate(B.predictions(spark, sf), loss=None), path, "test")
    back = spark.read.schema("split string, kl_divergence double, top1_accuracy double, top3_accuracy double, num_samples bigint").json(path)
    return back.select(r6("kl_divergence").alias("kl_divergence"), r6("top1_accuracy").alias("top1_accuracy"), r6("top3_accuracy").alias("top3_accuracy"), "num_samples")


@query("sample_statistics", "A21 F5", B.sql("preds", _CLS + f"""
, s AS (SELECT pc, tc, {_kl('target_probs', 'predicted_probs', '1e-8', _LOGQ)} AS kl FROM k)
SELECT round(avg(kl), 6) AS mean_kl_divergence, round(stddev_samp(kl), 6) AS std_kl_divergence, round(avg(CASE WHEN pc = tc THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS num_samples FROM s"""))
def sample_statistics(spark, sf):
    p = B.predictions(spark, sf).withColumn("kl_divergence", V.kl_from_logits("logits", "target_probs"))
    out = E.sample_stats(p, ["kl_divergence"])
    return out.select(*[r6(c).alias(c) for c in ("mean_kl_divergence", "std_kl_divergence", "accuracy")], "num_samples")


@query("prediction_files", "K6 S13", B.sql("preds", "SELECT count(*) AS n, round(sum(predicted_probs[1]), 6) AS p0, round(sum(target_probs[8]), 6) AS t7 FROM preds"))
def prediction_files(spark, sf):
    """Predictions to CSV with text arrays; unparsable rows among them are dropped when read."""
    path = B.scratch(spark, "predictions")
    p = B.predictions(spark, sf).select("target_id", "predicted_probs", "target_probs")
    WR.write_predictions(p, path)
    back = spark.read.schema("target_id bigint, predicted_probs string, target_probs string").option("header", True).option("escape", '"').csv(path)
    broken = back.withColumn("predicted_probs", F.explode(F.array(F.lit("[[0.1, 0.9]]"), F.lit("nan, 1"), F.lit(None))))
    good = E.parse_prob_arrays(back.unionByName(broken))
    return good.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.get("predicted_probs", F.lit(0)))).alias("p0"), r6(F.sum(F.get("target_probs", F.lit(7)))).alias("t7"))


@query("prediction_layer", "A28", B.sql("preds targets", _CLS + "SELECT pc AS class, count(*) AS points, round(avg(lon), 6) AS lon FROM k JOIN targets t ON t.target_id = k.target_id GROUP BY 1"))
def prediction_layer(spark, sf):
    layer = E.prediction_layer(B.predictions(spark, sf), B.targets(spark, sf))
    return layer.groupBy("class").agg(F.count(F.lit(1)).alias("points"), r6(F.avg("lon")).alias("lon"))


# ---- splits and samples --------------------------------------------------------------------------

@query("group_split", "W10 J12", f"""
WITH g AS (SELECT DISTINCT c_nationkey AS home FROM customer), n AS (SELECT count(*) AS n FROM g),
r AS (SELECT home, row_number() OVER (ORDER BY {_U.format(k='home', s='42')}, home) - 1 AS r FROM g),
s AS (SELECT home, CASE WHEN r < greatest(floor(n * 0.7e0), 1) THEN 'train' WHEN r < greatest(floor(n * 0.7e0), 1) + greatest(floor(n * 0.15e0), 1) THEN 'val' ELSE 'test' END AS split FROM r, n)
SELECT c_custkey AS target_id, home, split FROM customer JOIN s ON home = c_nationkey""")
def group_split(spark, sf):
    return SP.group_split(B.targets(spark, sf).select("target_id", "home"), "home", seed=42).select("target_id", "home", "split")


@query("small_groups", "W9 A11", """
WITH g AS (SELECT c_nationkey AS home, count(*) AS n FROM customer GROUP BY 1), small AS (SELECT * FROM g WHERE n < (SELECT avg(n) FROM g)),
p AS (SELECT home FROM small ORDER BY n DESC, home LIMIT 3) SELECT c_custkey AS target_id, c_nationkey AS home FROM customer WHERE c_nationkey IN (SELECT home FROM p)""")
def small_groups(spark, sf):
    t = B.targets(spark, sf).select("target_id", "home")
    mean = t.groupBy("home").count().agg(F.avg("count")).first()[0]
    return SP.small_groups(t, "home", mean, 3)


@query("largest_groups", "W9", """
WITH g AS (SELECT c_nationkey AS home, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT home FROM g ORDER BY n DESC, home LIMIT 3)
SELECT c_custkey AS target_id, c_nationkey AS home FROM customer WHERE c_nationkey IN (SELECT home FROM p)""")
def largest_groups(spark, sf):
    return SP.small_groups(B.targets(spark, sf).select("target_id", "home"), "home", 1, 3)


@query("top_groups", "W3 A11", "SELECT c_nationkey AS home, count(*) AS \"count\" FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_groups(spark, sf):
    return SP.top_groups(B.targets(spark, sf), "home", 5)


@query("seeded_sample", "W12", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_U.format(k='o_orderkey', s='42')}, o_orderkey LIMIT 500")
def seeded_sample(spark, sf):
    return SP.sample_n(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 500, 42, "o_orderkey")


@query("balanced_head", "W13", """
WITH f AS (SELECT c_mktsegment AS g, min(c_custkey) AS k FROM customer GROUP BY 1 ORDER BY 2 LIMIT 2), o AS (SELECT g, row_number() OVER (ORDER BY k) AS r FROM f),
x AS (SELECT c_custkey AS target_id, c_mktsegment AS segment, r, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer JOIN o ON g = c_mktsegment)
SELECT target_id, segment FROM x WHERE (r = 1 AND n <= 50) OR (r = 2 AND n <= 51)""")
def balanced_head(spark, sf):
    return SP.balanced_head(B.targets(spark, sf).select("target_id", "segment"), "segment", 101, ["target_id"])


# ---- learning ------------------------------------------------------------------------------------

def training_rows(spark, sf):
    return B.predictions(spark, sf).select("target_id", "neighborhood_name", F.col("logits").alias("features"), F.col("target_probs").alias("target_prob_vector"))


@query("soft_label_rows", "M2", B.sql("preds", """
, e AS (SELECT target_id, unnest(generate_series(1, 8)) AS i, target_probs FROM preds)
SELECT CAST(i - 1 AS double) AS label, count(*) AS n, round(sum(target_probs[i]), 6) AS weight FROM e GROUP BY 1"""))
def soft_label_rows(spark, sf):
    return L.soft_rows(training_rows(spark, sf)).groupBy(F.col("class_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("class_weight")).alias("weight"))


@query("soft_label_model", "M2 M4", None)
def soft_label_model(spark, sf):
    """Fit on soft labels, score every row; an iterative optimiser has no SQL form."""
    rows = training_rows(spark, sf)
    scored = L.score(L.fit_soft_labels(rows, max_iter=20), rows)
    return scored.select("target_id", "predicted_class", r6(F.array_max("predicted_probs")).alias("confidence"), r6(V.kl("target_prob_vector", "predicted_probs")).alias("kl"))


@query("model_grid", "M3 W5", None)
def model_grid(spark, sf):
    """Two strengths of regularisation over area-disjoint folds, by validation divergence."""
    rows = training_rows(spark, sf).withColumn("fold", F.floor(S.uniform(42, "neighborhood_name") * 2).cast("int"))
    return L.grid_search(rows, {"reg": [0.01, 1.0]}, "fold", [0, 1])


_GAPS = B.sql("targets services categories", """
, near AS (SELECT target_id, category_index, min(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) AS d FROM targets, services
  WHERE (x - fx) * (x - fx) + (y - fy) * (y - fy) <= 1000e0 * 1000e0 GROUP BY ALL),
lists AS (SELECT target_id, list(coalesce(d, 2400e0) ORDER BY c.category_index) AS ds FROM targets CROSS JOIN categories c LEFT JOIN near USING (target_id, category_index) GROUP BY 1),
""" + f"""preds AS ({B.PREDICTIONS_SQL}), j AS (SELECT l.target_id, ds, p.predicted_probs AS q, {B.sql_softmax("list_transform(ds, lambda v: -v / 200)")} AS dp FROM lists l JOIN preds p ON p.target_id = l.target_id),
t AS (SELECT *, {_TOP3.format(v='q')} AS top FROM j)
SELECT target_id, round({_kl('dp', 'q', '1e-8', 'ln(q[i] + 1e-8)')}, 5) AS gap,
  array_to_string(list_transform(top, lambda i: [{', '.join(f"'{c}'" for c in CATEGORIES)}][i + 1]), ',') AS top3, len(list_filter(top, lambda i: ds[i + 1] > 1200)) AS missing FROM t""")


@query("service_gaps", "M5 F13 F1", _GAPS)
def service_gaps(spark, sf):
    d = nearest_by_category(B.targets(spark, sf), B.services(spark, sf))
    g = L.service_gaps(d.join(B.predictions(spark, sf).select("target_id", "predicted_probs"), "target_id"))
    return g.select("target_id", F.round("gap", 5).alias("gap"), F.array_join("top_categories", ",").alias("top3"), F.size("missing_categories").cast("bigint").alias("missing"))


@query("group_comparison", "M6", """
WITH v AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'other' END AS grp, l_quantity AS v FROM lineitem),
c AS (SELECT v, count(*) AS n FROM v GROUP BY 1), r AS (SELECT v, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2 AS rk FROM c)
SELECT grp, count(*) AS n, round(avg(v.v), 6) AS mean, round(stddev_samp(v.v), 6) AS std, round(sum(rk) - count(*) * (count(*) + 1) / 2, 1) AS u FROM v JOIN r ON r.v = v.v GROUP BY 1""")
def group_comparison(spark, sf):
    out = L.compare_groups(B.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity", "A")
    return out.select("grp", "n", r6("mean").alias("mean"), r6("std").alias("std"), F.round("u", 1).alias("u"))


@query("distance_alignment", "F13 F1", _GAPS[:_GAPS.rindex("SELECT target_id, round(")] + f"SELECT round(avg({_kl('dp', 'q', '1e-8', 'ln(q[i] + 1e-8)')}), 5) AS distance_alignment FROM j")
def distance_alignment(spark, sf):
    d = nearest_by_category(B.targets(spark, sf), B.services(spark, sf))
    j = d.join(B.predictions(spark, sf).select("target_id", "predicted_probs"), "target_id")
    return E.distance_alignment(j).withColumn("distance_alignment", F.round("distance_alignment", 5))


