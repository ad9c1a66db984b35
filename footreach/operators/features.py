"""Per-point features, the 33-vector, and stars (a target with the cells of its walking disc)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.constants import (BUILDING_RADIUS_M, CATEGORIES, CATEGORY_TAGS, DEMOGRAPHIC_FEATURES, FEATURES, GRID_CELL_M, LATTICE_STEP_M,
                                 N_CATEGORIES, SERVICE_FEATURES, STREET_RADIUS_M, WALK_RADIUS_M)
from footreach.functions import geometry as G
from footreach.functions import scalars as S
from footreach.functions import vectors as V
from footreach.operators import network as N
from footreach.operators.relational import match_or_mean

from footreach.operators.spatial import _offset_array, disc_offsets, distance_join, least_within, radius_aggregate
from footreach.session import inline_table


def tag_map(spark) -> DataFrame:
    """tag, category, category_index: the fixed map, 91 rows."""
    rows = [(t, c, i) for i, (c, tags) in enumerate(CATEGORY_TAGS.items()) for t in tags]
    return inline_table(spark, rows, "tag string, category string, category_index int")


def category_dim(spark) -> DataFrame:
    return inline_table(spark, list(enumerate(CATEGORIES)), "category_index int, category string")


def service_counts(points: DataFrame, services: DataFrame, r: float = WALK_RADIUS_M, category: str = "category_index",
                   fx: str = "fx", fy: str = "fy") -> DataFrame:
    """Eight columns services_0..7: services of each category within the radius, 0 when none."""
    measures = {n: F.when(F.col(category) == i, 1).otherwise(0) for i, n in enumerate(SERVICE_FEATURES)}
    return radius_aggregate(points, services, r, measures, fx=fx, fy=fy)


def built_form(points: DataFrame, buildings: DataFrame, r: float = BUILDING_RADIUS_M, *, rings: str = "rings",
               levels: str = "levels") -> DataFrame:
    """Buildings whose footprint comes within the radius: count, count per m^2, mean numeric levels; floor area is 0.

    Copies of a footprint are summed first and each place of the points is looked at once, so piles of copies on
    either side cost no pairs.
    """
    shapes = buildings.select(F.col(rings).alias("_rings"), F.lit(1).alias("_n"), S.to_number(levels).alias("_levels"),
                              S.to_number(levels).isNotNull().cast("int").alias("_known"))
    shapes = shapes.groupBy("_rings").agg(*[F.sum(c).alias(c) for c in ("_n", "_levels", "_known")])
    near = distance_join(points.select("x", "y").distinct(), shapes, r, rings="_rings", spread="points")  # two numbers a row; there are more shapes, and they are wider
    got = near.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(
        F.sum("_n").alias("building_count"), F.try_divide(F.sum("_levels"), F.sum("_known")).alias("average_levels"))
    out = points.join(got, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_x", "_y").fillna(
        0, ["building_count"]).fillna(0.0, ["average_levels"])
    return out.withColumn("building_density", F.col("building_count") / F.lit(math.pi * r * r)).withColumn(
        "floor_area_per_capita", F.lit(0.0))


def point_features(points: DataFrame, *, units: DataFrame, boxes: DataFrame, buildings: DataFrame, services: DataFrame, nodes: DataFrame, edges: DataFrame,
                   pedestrian: DataFrame, group: str = "neighborhood_name", point_id: str = "target_id", unit_cell: float = 0.004,
                   service_radius: float = WALK_RADIUS_M, building_radius: float = BUILDING_RADIUS_M, street_radius: float = STREET_RADIUS_M) -> DataFrame:
    """All 33 features of every point, as columns, and its geometry as text.

    points: point_id, group, lon, lat, x, y; units: code, group, the demographic features; boxes: code, rings (degrees);
    buildings: rings (metres), levels; services: fx, fy, category_index; nodes: node_id, x, y; edges: src, dst, length.
    A point takes the demographics of the unit it lies in (the least code where units overlap), else the mean of its
    group's units, else 0. Every other feature is a radius aggregate, so pairs of points and features are not listed.
    point_id is unique.
    """
    spot = points.select(point_id, group, "lon", "lat", "x", "y")
    inside = least_within(spot, boxes, unit_cell, by=[point_id], x="lon", y="lat")
    out = match_or_mean(spot.join(inside, point_id, "left"), units, "code", group, DEMOGRAPHIC_FEATURES).drop("code")
    degrees = N.node_degrees(nodes, edges).select(F.col("x").alias("fx"), F.col("y").alias("fy"), "degree")
    centres = N.edge_centres(edges, nodes)
    # each block starts from the points alone and meets the others by id: chained, every block would compute those before it again
    place = spot.select(point_id, "x", "y")
    for block in (built_form(place, buildings, building_radius), service_counts(place, services, service_radius), N.intersection_density(place, degrees, street_radius).drop("intersections"),
                  N.block_length(place, centres, street_radius), N.pedestrian_ratio(place, pedestrian, centres, street_radius)):
        out = out.join(block.drop("x", "y"), point_id)
    return out.select(point_id, group, "lon", "lat", "x", "y", *FEATURES, G.to_wkt("lon", "lat").alias("target_geometry"))


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """The 33 features in their fixed order, padded or cut to length, NaN and infinities to 0, as floats."""
    have = set(df.columns)
    parts = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in FEATURES])
    return df.withColumn(name, V.finite_or_zero(V.fit_length(parts)).cast("array<float>"))


# ---- stars ---------------------------------------------------------------------------------------

def _lattice_multiple(step: float, cell: float) -> int:
    k = round(cell / step)
    if k < 1 or abs(k * step - cell) > 1e-9:
        raise ValueError(f"the cell size {cell} must be a multiple of the lattice step {step}")
    return k


def star_cells(targets: DataFrame, radius: float = WALK_RADIUS_M, cell: float = GRID_CELL_M, step: float = LATTICE_STEP_M,
               key: str = "neighborhood_name") -> DataFrame:
    """Distinct lattice points that some star needs: key, ix, iy. Their features are computed once each.

    Targets are gathered by tile first, so that the overlap of neighbouring discs collapses before the shuffle.
    """
    k = _lattice_multiple(step, cell)
    table = _offset_array(disc_offsets(radius, cell), scale=k)
    tiled = targets.select(key, "ix", "iy").repartition(F.col(key), F.floor(F.col("ix") / 64), F.floor(F.col("iy") / 64))
    return tiled.withColumn("_o", F.explode(table)).select(
        key, (F.col("ix") + F.col("_o.i")).alias("ix"), (F.col("iy") + F.col("_o.j")).alias("iy")).distinct()


def assemble_stars(targets: DataFrame, cells: DataFrame, radius: float = WALK_RADIUS_M, cell: float = GRID_CELL_M,
                   step: float = LATTICE_STEP_M, *, key: str = "neighborhood_name", features: str = "features",
                   tile: int | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Targets with `neighbor_data`, the array of the cells in the disc with their features.

    `finish` is applied to the stars of the lattice points (key, ix, iy, neighbor_data, num_neighbors) before the targets take
    theirs, so that what is made of a star alone is made once, and need not travel whole.

    targets: key, target_id, ix, iy, ...; cells: key, ix, iy, features (one row per lattice point). A star is built
    once per lattice point that holds targets. Cells are copied to the tiles whose border they touch (at most 4 when
    the tile is wider than the disc) and both sides are laid out by tile; the join and the grouping then stay inside a
    tile, so only cells travel, not the pairs. A tile holds at most tile^2 lattice points: no hot group.

    Spark joins in place on part of the join keys only with spark.sql.requireAllClusterKeysForCoPartition off, and plans
    when the stars are used, so the option stays off for the session; it only ever saves shuffles.
    """
    k = _lattice_multiple(step, cell)
    offsets = disc_offsets(radius, cell)
    halo = k * max(i for i, _ in offsets)
    tile = tile or max(16, 3 * halo)
    targets.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def tile_of(col, grow=0):
        return f"floor(({col} + {grow}) / {tile})"

    def tiles(col):
        return F.expr(f"explode(sequence({tile_of(col, -halo)}, {tile_of(col, halo)}))")

    tile_id = f"concat_ws('/', {key}, _tx, _ty) AS _tile"
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as the work of a tile is not in the bytes that travel
    side = (
        cells.selectExpr(f"{key} AS _key", "ix AS _cx", "iy AS _cy", f"{features} AS _f")
        .withColumn("_tx", tiles("_cx")).withColumn("_ty", tiles("_cy"))
        .selectExpr("_key", "_cx", "_cy", "_f", tile_id.replace(key, "_key")).repartition(tasks, "_tile")
    )
    spot = [key, "ix", "iy"]
    hub = (
        targets.select(*spot).distinct().selectExpr(*spot, f"{tile_of('ix')} AS _tx", f"{tile_of('iy')} AS _ty")
        .selectExpr(*spot, tile_id).repartition(tasks, "_tile").withColumn("_o", F.explode(_offset_array(offsets)))
        .selectExpr(*spot, "_tile", "_o.i AS _i", "_o.j AS _j", f"ix + _o.i * {k} AS _cx", f"iy + _o.j * {k} AS _cy")
        .withColumn("_key", F.col(key))
    )
    c = f"{float(cell)!r}D"
    d = f"sqrt(CAST(_i * _i + _j * _j AS double)) * {c}"
    entry = F.expr(f"named_struct('_i', _i, '_j', _j, 'features', _f, 'network_distance', {d}, 'euclidean_distance', {d}, "
                   f"'dx', _i * {c}, 'dy', _j * {c})")
    stars = (
        hub.join(side.hint("merge"), ["_cx", "_cy", "_tile", "_key"])  # numbers first: they are what rows are sorted by at once; both sides are exploded: Spark would broadcast one by its size before that
        .groupBy("_tile", *spot).agg(F.sort_array(F.collect_list(entry)).alias("_n"))
        .select(*spot, F.transform("_n", lambda s: s.dropFields("_i", "_j")).alias("neighbor_data"))
    )
    empty = F.array().cast(stars.schema["neighbor_data"].dataType)

    def whole(some: DataFrame) -> DataFrame:
        return some.join(stars, spot, "left").select(*some.columns, "neighbor_data").withColumn(
            "neighbor_data", F.coalesce("neighbor_data", empty)).withColumn("num_neighbors", F.size("neighbor_data"))

    if finish is None:
        return whole(targets)
    done = finish(whole(targets.select(*spot).distinct()))
    return targets.join(done, spot, "left").select(*targets.columns, *[c for c in done.columns if c not in spot])


def star_graph(stars: DataFrame, target_features: str = "target_features", scale: float = 1000.0) -> DataFrame:
    """Node matrix (row 0 the target), edge index (i -> 0) and scaled edge attributes; no neighbour gives no edge."""
    n = F.size("neighbor_data")
    return stars.withColumn("x", F.concat(F.array(F.col(target_features).cast("array<double>")), F.transform(
        "neighbor_data", lambda s: s["features"].cast("array<double>")))).withColumn(
        "edge_index", F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
            i.alias("src"), F.lit(0).alias("dst")))).otherwise(
            F.array().cast("array<struct<src:int,dst:int>>"))).withColumn(
        "edge_attr", F.transform("neighbor_data", lambda s: F.array(*[
            s[c].cast("double") / F.lit(float(scale)) for c in ("dx", "dy", "euclidean_distance", "network_distance")])))


def check_feature_rows(df: DataFrame, n_features: int = 33, n_categories: int = N_CATEGORIES, tol: float = 1e-5) -> DataFrame:
    """Every row of the output against its schema: one row per broken rule, with the number of rows that break it."""
    prob = V.as_double("target_prob_vector")
    rules = {
        "feature_length": F.size("target_features") != n_features,
        "vector_length": F.size("target_prob_vector") != n_categories,
        "vector_sum": F.abs(V.vsum(prob) - 1.0) > tol,
        "neighbor_count": F.col("num_neighbors") != F.size("neighbor_data"),
        "geometry": ~F.col("target_geometry").startswith("POINT"),
        "finite": F.exists(V.as_double("target_features"), lambda x: ~V.is_finite(x)),
    }
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()], F.count(F.lit(1)).alias("_n"))
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("rule"), F.col(n).alias("violations"), F.col("_n").alias("rows")) for n in rules])).alias("e")).select("e.*")
