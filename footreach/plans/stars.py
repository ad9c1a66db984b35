"""Stars of whole walking discs: every cell within 1000 m of a target, with all 33 features, and what is learned from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.constants import CATEGORIES, FEATURES, GRID_CELL_M, WALK_RADIUS_M
from footreach.functions import geometry as G
from footreach.functions import vectors as V
from footreach.operators import augment as AU
from footreach.operators import features as FT
from footreach.operators import learn as L
from footreach.plans import bindings as B
from footreach.plans.access import nearest_by_category
from footreach.plans.feature_table import _USES, features_sql, sources
from footreach.plans.models import _U
from footreach.plans.registry import query, r6
from footreach.session import cut_lineage

#: Features that stand for the groups of the vector in the checks.
SHOWN = ["ses_index", "median_income", "building_count", "services_2", "services_6", "intersection_density", "average_block_length", "pedestrian_street_ratio"]


def _own(stars: DataFrame) -> DataFrame:
    own = F.filter("neighbor_data", lambda s: s["euclidean_distance"] == 0)
    return stars.withColumn("target_features", F.get(own, F.lit(0))["features"])


def walking_stars(spark, sf, more: DataFrame | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Targets on a 100 m lattice with the cells of their disc; each cell's 33 features are built once, however many stars hold it.

    `more` (target_id, ...) is joined to the targets before they take their stars, as a join after that would shuffle every star
    of every target. `finish` is applied to the stars of the lattice points, which targets share.
    """
    t = B.targets(spark, sf).selectExpr("'all' AS neighborhood_name", "target_id", f"floor(x / {GRID_CELL_M}D) AS ix", f"floor(y / {GRID_CELL_M}D) AS iy", "lon", "lat")
    cells = FT.star_cells(t, WALK_RADIUS_M, GRID_CELL_M, GRID_CELL_M).selectExpr("neighborhood_name", "ix", "iy", "ix * 1000000 + iy AS target_id", "0 AS home", f"ix * {GRID_CELL_M}D AS x", f"iy * {GRID_CELL_M}D AS y")
    cells = cut_lineage(cells.withColumn("lon", G.lon_of("x")).withColumn("lat", G.lat_of("y")))
    built = cut_lineage(FT.feature_vector(FT.point_features(cells, **sources(spark, sf))).select("target_id", "features"))
    cells = cells.select("neighborhood_name", "ix", "iy", "target_id").join(built, "target_id").drop("target_id")
    if more is not None:
        t = cut_lineage(t.join(more, "target_id"))
    if finish is None:
        return _own(FT.assemble_stars(t, cells, WALK_RADIUS_M, GRID_CELL_M, GRID_CELL_M))
    return FT.assemble_stars(t, cells, WALK_RADIUS_M, GRID_CELL_M, GRID_CELL_M, finish=lambda stars: finish(_own(stars)))


_CELLS = """customers AS ({targets}), tl AS (SELECT target_id, CAST(floor(x / 100) AS bigint) AS ix, CAST(floor(y / 100) AS bigint) AS iy FROM customers),
offs AS (SELECT i, j FROM (SELECT unnest(generate_series(-10, 10)) AS i), (SELECT unnest(generate_series(-10, 10)) AS j) WHERE i * i + j * j <= 100),
cell AS (SELECT DISTINCT ix + i AS cx, iy + j AS cy FROM tl, offs),
targets AS (SELECT cx * 1000000 + cy AS target_id, 0 AS home, cx * 100e0 AS x, cy * 100e0 AS y, degrees(cx * 100e0 / 6378137e0) AS lon, degrees(2e0 * atan(exp(cy * 100e0 / 6378137e0)) - pi() / 2) AS lat FROM cell)"""
_AT = {f: f"CAST({'intersections_per_km2' if f == 'intersection_density' else f} AS REAL)" for f in SHOWN}


def _star_sql(body: str) -> str:
    shown = ", ".join(f"CAST({e} AS double) AS {f}" for f, e in _AT.items())
    text = B.sql(_USES, features_sql(lambda e, n: f"({e})", 1.0) + f""", star AS (SELECT tl.target_id, sqrt(i * i + j * j) * 100 AS d, row_number() OVER (PARTITION BY tl.target_id ORDER BY i, j) - 1 AS k, {shown}
  FROM tl CROSS JOIN offs JOIN features f ON f.target_id = (ix + i) * 1000000 + iy + j) """ + body)
    plain = B.views()["targets"]
    return text.replace(f"targets AS ({plain})", _CELLS.format(targets=plain), 1)


def _digits(f: str) -> int:
    return {"median_income": 0, "intersection_density": 9}.get(f, 3)


def _shown(v, f: str):
    return F.round(F.get(v, F.lit(FEATURES.index(f))).cast("double"), _digits(f)).alias(f)


@query("walking_stars", "N7 G5 G6 P15 P16 M1", _star_sql(f"""
SELECT target_id, count(*) AS num_neighbors, {', '.join(f'round(avg({f}), {_digits(f)}) AS {f}' for f in SHOWN)},
  round(max(CASE WHEN d = 0 THEN average_block_length END), 3) AS own_block_length FROM star GROUP BY 1"""))
def walking_stars_query(spark, sf):
    """Stars of 317 cells with 33 features each, as neighbour counts, pooled means and the target's own features."""
    out = L.pool_neighbours(walking_stars(spark, sf))
    own = F.get("target_features", F.lit(FEATURES.index("average_block_length"))).cast("double")
    return out.select("target_id", F.col("num_neighbors").cast("bigint").alias("num_neighbors"), *[_shown("pooled", f) for f in SHOWN], F.round(own, 3).alias("own_block_length"))


@query("walking_star_samples", "W11 R2 M1 P17", _star_sql(f"""
, b AS (SELECT *, {_U.format(k="target_id || '|' || k", s='42')} AS u, CASE WHEN d / 1000 < 0.3 THEN 0 WHEN d / 1000 < 0.6 THEN 1 WHEN d / 1000 < 0.9 THEN 2 WHEN d / 1000 < 1 THEN 3 END AS band FROM star),
q AS (SELECT *, row_number() OVER (PARTITION BY target_id, band ORDER BY u, k) AS r, count(*) OVER (PARTITION BY target_id, band) AS n FROM b)
SELECT target_id, count(*) AS kept, round(sum(d) / 1000, 4) AS distance_sum, round(sum(services_2 / (d / 1000 + 0.1e0)) / sum(1 / (d / 1000 + 0.1e0)), 3) AS near_grocery
FROM q WHERE band IS NOT NULL AND r <= greatest(1, floor(n * 0.8e0)) GROUP BY 1"""))
def walking_star_samples(spark, sf):
    """Stratified samples of the stars, their edge attributes and the inverse-distance mean of what is kept."""
    kept = FT.star_graph(L.pool_neighbours(AU.subsample(walking_stars(spark, sf), 0.8, 3, 42), "inverse"))
    return kept.select("target_id", F.col("num_neighbors").cast("bigint").alias("kept"), F.round(F.aggregate("edge_attr", F.lit(0.0), lambda a, e: a + e[2]), 4).alias("distance_sum"),
                       F.round(F.get("pooled", F.lit(FEATURES.index("services_2"))), 3).alias("near_grocery"))


def star_rows(spark, sf, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stars with the target's geometry and its distribution over the service categories."""
    probs = nearest_by_category(B.targets(spark, sf), B.services(spark, sf)).select("target_id", V.distance_softmax("distances", 200.0).alias("target_prob_vector"))
    return walking_stars(spark, sf, probs, finish).withColumn("target_geometry", G.to_wkt("lon", "lat"))


@query("star_row_check", "Q28 N7", B.sql("targets", """
SELECT rule, CAST(0 AS bigint) AS violations, (SELECT count(*) FROM targets) AS "rows" FROM (VALUES ('feature_length'), ('vector_length'), ('vector_sum'), ('neighbor_count'), ('geometry'), ('finite')) v(rule)"""))
def star_row_check(spark, sf):
    """Every row of the training table against its schema."""
    return FT.check_feature_rows(star_rows(spark, sf))


@query("star_model", "M1 M2 M4", None)
def star_model(spark, sf):
    """Soft labels fitted on the targets' 33 features and the pooled 33 of their discs, every target scored; an optimiser has no SQL form."""
    rows = star_rows(spark, sf, lambda stars: L.pool_neighbours(stars).drop("neighbor_data"))
    rows = cut_lineage(rows.select("target_id", "target_prob_vector", F.concat(V.as_double("target_features"), "pooled").alias("features")))
    scored = L.score(L.fit_soft_labels(rows, max_iter=20), rows)
    best = F.get(V._col(F.array(*[F.lit(c) for c in CATEGORIES])), F.col("predicted_class"))
    return scored.select("target_id", best.alias("predicted"), r6(F.array_max("predicted_probs")).alias("confidence"), r6(V.kl("target_prob_vector", "predicted_probs")).alias("kl"))
