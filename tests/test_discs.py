"""Joins that grow inside Spark: exploded rows are never sent through the driver, and disc sums are those of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footreach.functions import geometry as G
from footreach.operators import discs as D
from footreach.operators import features as FT
from footreach.operators import spatial as SP


def broadcast_explodes(df) -> list[str]:
    """Broadcasts in the plan that hold exploded rows: Spark takes their size from the rows before the explosion."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n") + df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(s) - len(s.lstrip(" :+-*()0123456789")) for s in lines]
    bad = []
    for i, s in enumerate(lines):
        if "BroadcastExchange" in s:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                if "Generate" in lines[j]:
                    bad.append(lines[j])
    return bad


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def points_and_features(spark):
    p = spark.range(40).selectExpr("id AS target_id", "CAST(id * 30 AS double) AS x", "CAST(id % 7 * 50 AS double) AS y")
    return p, spark.range(40).selectExpr("id AS fid", "CAST(id * 31 AS double) AS fx", "CAST(id % 5 * 60 AS double) AS fy")


def test_no_exploded_rows_pass_the_driver_in_disc_sums(spark, adaptive):
    p, f = points_and_features(spark)
    assert not broadcast_explodes(SP.radius_aggregate(p, f, 100.0, {"n": F.lit(1)}))


@pytest.mark.parametrize("n, m, r, grid", [(300, 2000, 0.2, None), (300, 2000, 2.0, None), (200, 2000, 0.1, 1), (1, 1, 1.0, None), (50, 900, 1e-4, 1)])
def test_disc_sums_are_brute_force(n, m, r, grid, monkeypatch):
    g = np.random.default_rng(n + m)
    x, y, fx, fy = (a if grid is None else np.round(a, grid) for a in (g.random(n), g.random(n), g.random(m), g.random(m)))
    v = g.integers(0, 9, (m, 3))
    near = (np.sqrt((fx[None] - x[:, None]) ** 2 + (fy[None] - y[:, None]) ** 2) <= r).astype(np.int64)
    monkeypatch.setattr(D, "PIECE", 500)
    assert (D.disc_sums(x, y, fx, fy, v, r) == near @ v).all()


def test_parts_of_a_crowded_tile_meet_each_other(spark, monkeypatch):
    """Parts of a few rows give what one task would; values that are null, infinite or undefined act on their own discs only."""
    monkeypatch.setattr(D, "POINTS", 7)
    monkeypatch.setattr(D, "FEATURES", 11)
    rnd = random.Random(3)
    p = [(i, rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(60)] + [(60, None, 1.0), (61, float("nan"), 1.0)]
    f = [(rnd.uniform(0, 500), rnd.uniform(0, 500), [1.5, 2.0, None, 4.0][i % 4]) for i in range(120)] + [(10.0, 10.0, float("inf")), (None, 10.0, 1.0)]
    points = spark.createDataFrame(p, "target_id bigint, x double, y double")
    feats = spark.createDataFrame(f, "fx double, fy double, w double")
    got = {r.target_id: (r.n, r.s) for r in SP.radius_aggregate(points, feats, 120.0, {"n": F.lit(1), "s": F.col("w")}).collect()}
    for i, x, y in p:
        near = [w for a, b, w in f if None not in (x, a) and math.hypot(x - a, y - b) <= 120.0]
        n, s = got.pop(i)
        assert n == len(near) and s == pytest.approx(sum(w for w in near if w is not None))
    assert not got


def shapes(spark):
    """Rectangles in several ring orders, a diamond, a triangle, a shape of two rings; code descending, one null, one repeated."""
    def ring(*v):
        return [{"x": float(a), "y": float(b)} for a, b in (*v, v[0])]
    rings = [[ring((0, 0), (40, 0), (40, 20), (0, 20))], [ring((10, 50), (10, 90), (70, 90), (70, 50))], [ring((100, 0), (120, 20), (100, 40), (80, 20))],
             [ring((60, 60), (90, 60), (75, 95))], [ring((0, 100), (50, 100), (50, 150), (0, 150)), ring((10, 110), (10, 140), (40, 140), (40, 110))], [ring((30, 10), (30, 60), (60, 60), (60, 10))]]
    codes = ["f", "e", "d", None, "b", "e"]
    return spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(zip(codes, rings))], "fid int, code string, rings array<array<struct<x:double,y:double>>>")


def lattice(spark):
    return spark.range(14 * 17).selectExpr("id AS target_id", "CAST(id % 14 * 10 AS double) AS x", "CAST(floor(id / 14) * 10 AS double) AS y")


def test_a_polygon_that_is_its_box_is_measured_as_one(spark, adaptive):
    p, s = lattice(spark), shapes(spark)
    got = SP.distance_join(p, s, 25.0, rings="rings")
    assert not broadcast_explodes(got)
    want = p.crossJoin(s).withColumn("d", G.polygon_distance("rings", "x", "y")).filter("d <= 25")
    found = {(r.target_id, r.fid): round(r.distance, 9) for r in got.collect()}
    assert found == {(r.target_id, r.fid): round(r.d, 9) for r in want.collect()} and len(found) > 100
    assert [f.fid for f in s.filter(G.is_rectangle("rings")).collect()] == [0, 1, 5]


@pytest.mark.parametrize("radius, cell", [(25.0, None), (30.0, 10.0), (20.0, 200.0)])
def test_points_spread_over_cells_meet_every_shape_once(spark, adaptive, radius, cell):
    p, s = lattice(spark).unionByName(spark.createDataFrame([(900, None, 1.0), (901, float("inf"), 1.0), (902, float("nan"), 1.0), (903, 1e18, -1e18), (3, 30.0, 0.0)], "target_id bigint, x double, y double")), shapes(spark)
    got = SP.distance_join(p, s, radius, rings="rings", cell=cell, spread="points")
    assert not broadcast_explodes(got)
    key = lambda df: sorted((r.target_id, r.fid, round(r.distance, 9)) for r in df.collect())
    assert key(got) == key(SP.distance_join(p, s, radius, rings="rings", cell=cell)) and got.count() > 100
    with pytest.raises(ValueError, match="inner"):
        SP.distance_join(p, s, radius, rings="rings", spread="points", how="left")


def test_built_form_repeats_points_not_shapes(spark, monkeypatch):
    """Shapes of 10 m in cells of 100 m are repeated over the cells of their own box only."""
    seen, real = [], SP._exploded
    monkeypatch.setattr(SP, "_exploded", lambda df: seen.append(df.count()) or real(df))
    p = spark.range(30).selectExpr("id AS target_id", "id * 37D AS x", "id * 91D AS y")
    box = "array(array(named_struct('x', a, 'y', b), named_struct('x', a + 10, 'y', b), named_struct('x', a + 10, 'y', b + 10), named_struct('x', a, 'y', b + 10), named_struct('x', a, 'y', b)))"
    b = spark.range(2000).selectExpr("CAST(id % 50 * 23 AS double) AS a", "CAST(floor(id / 50) * 71 AS double) AS b").selectExpr(f"{box} AS rings", "'2' AS levels")
    got = {r.target_id: r.building_count for r in FT.built_form(p, b).collect()}
    near = p.join(b, G.polygon_distance("rings", "x", "y") <= 100.0).groupBy("target_id").count().collect()
    assert {k: v for k, v in got.items() if v} == {r["target_id"]: r["count"] for r in near} and seen and max(seen) < 2 * 2000


@pytest.mark.parametrize("strict, how", [(True, "inner"), (False, "inner"), (True, "left"), (False, "left")])
def test_within_join_is_brute_force(spark, strict, how):
    p, s = lattice(spark), shapes(spark)
    got = SP.within_join(p, s, 30.0, strict=strict, how=how)
    assert not broadcast_explodes(got)
    test = G.contains_point if strict else G.covers_point
    want = p.join(s, test("rings", "x", "y"), how)
    assert sorted((r.target_id, -1 if r.fid is None else r.fid) for r in got.collect()) == sorted((r.target_id, -1 if r.fid is None else r.fid) for r in want.collect())


def test_least_within_takes_the_least_code(spark):
    p, s = lattice(spark), shapes(spark)
    got = {r.target_id: r.code for r in SP.least_within(p, s, 30.0, by=["target_id"]).collect()}
    want = p.join(s.filter("code is not null"), G.contains_point("rings", "x", "y")).groupBy("target_id").agg(F.min("code").alias("code"))
    assert got == {r.target_id: r.code for r in want.collect()} and len(set(got.values())) > 2


def test_nearest_join_sends_no_exploded_rows_through_the_driver(spark, monkeypatch, adaptive):
    seen = []
    cut = SP.cut_lineage
    monkeypatch.setattr(SP, "cut_lineage", lambda df: seen.extend(broadcast_explodes(df)) or cut(df))
    p, f = points_and_features(spark)
    SP.nearest_join(p, f, id_col="target_id", feature_id="fid")
    assert not seen


def test_stars_send_no_exploded_rows_through_the_driver(spark):
    t = spark.range(50).selectExpr("'a' AS neighborhood_name", "id AS target_id", "id AS ix", "id % 7 AS iy")
    cells = FT.star_cells(t, 200.0, 100.0, 100.0).withColumn("features", F.array(F.lit(1.0)))
    stars = FT.assemble_stars(t, cells, 200.0, 100.0, 100.0)
    plan = stars._jdf.queryExecution().sparkPlan().toString()
    joins = [s for s in plan.split("\n") if "Join" in s and "_tile" in s]
    assert joins and all("SortMergeJoin" in s for s in joins)
