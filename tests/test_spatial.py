import math
import random

import pytest
from footreach.functions import geometry as G
from footreach.operators import features as FT
from footreach.operators import spatial as SP
from footreach.operators.skew import number_rows, rank_by_hash
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def cloud(spark):
    """Points and features with a third of each in one small spot, and copies of one place."""
    rnd = random.Random(7)

    def pts(n, off):
        out = []
        for i in range(n):
            hot = i % 3 == 0
            x, y = (rnd.uniform(0, 60), rnd.uniform(0, 60)) if hot else (rnd.uniform(-5000, 5000), rnd.uniform(-5000, 5000))
            out.append((i + off, x, y) if i % 10 else (i + off, 25.0, 25.0))
        return out
    p, f = pts(200, 0), pts(300, 1000)
    return p, f, spark.createDataFrame(p, "target_id bigint, x double, y double"), spark.createDataFrame(
        [(i, x, y, i % 3) for i, x, y in f], "fid bigint, fx double, fy double, kind int")


def test_distance_join_is_brute_force(cloud):
    p, f, points, feats = cloud
    got = {(r.target_id, r.fid) for r in SP.distance_join(points, feats, 700.0).collect()}
    assert got == {(i, j) for i, x, y in p for j, a, b in f if math.hypot(x - a, y - b) <= 700}
    left = SP.distance_join(points, feats, 700.0, how="left")
    assert left.select("target_id").distinct().count() == len(p)


def test_radius_aggregate_is_brute_force(cloud):
    p, f, points, feats = cloud
    out = SP.radius_aggregate(points, feats, 700.0, {"n": F.lit(1), "s": F.col("kind")}).collect()
    assert len(out) == len(p)
    for r in out:
        near = [j for j, a, b in f if math.hypot(r.x - a, r.y - b) <= 700]
        assert (r.n, r.s) == (len(near), sum(j % 3 for j in near))


@pytest.mark.parametrize("limit", [None, 900.0])
def test_nearest_join_is_brute_force(cloud, limit):
    p, f, points, feats = cloud
    got = {(r.target_id, r.kind): r.distance for r in SP.nearest_join(
        points, feats, id_col="target_id", feature_id="fid", by="kind", by_values=[0, 1, 2], max_distance=limit).collect()}
    for i, x, y in p:
        for k in range(3):
            d = min(math.hypot(x - a, y - b) for j, a, b in f if j % 3 == k)
            if limit is None or d <= limit:
                assert got[(i, k)] == pytest.approx(d)
            else:
                assert (i, k) not in got


def test_a_dense_spot_leaves_other_cells_as_they_are(spark, monkeypatch):
    """Half of the features in one spot: the tree is fine there only, and the nearest are still those of brute force."""
    monkeypatch.setattr(SP, "CELL_PLACES", 8)
    rnd = random.Random(21)
    wide = [(k, rnd.uniform(0, 10_000), rnd.uniform(0, 10_000)) for k in range(400)]
    spot = [(1000 + k, 5000 + rnd.random(), 5000 + rnd.random()) for k in range(400)]

    def cells(rows):
        df = spark.createDataFrame(rows, "fid bigint, fx double, fy double")
        _, levels, placed = SP._tree(df, [], "fx", "fy", len(rows), 0.0, 0.0, 10_000.0)
        leaves = {(level, r._cx, r._cy) for level, c in enumerate(levels, 1) for r in c.collect() if r._leaf}
        counts = {(r._level, r._cx, r._cy): r.n for r in placed.groupBy("_level", "_cx", "_cy").agg(F.count("fid").alias("n")).collect()}
        assert leaves == set(counts) and sum(counts.values()) == len(rows) and max(counts.values()) <= 8
        return leaves
    plain, dense = cells(wide), cells(wide + spot)
    split = {(k, int(x // (10_000 / 4**k)), int(y // (10_000 / 4**k))) for k in range(1, 15) for _, x, y in spot}
    assert plain - split <= dense and max(k for k, *_ in dense) > max(k for k, *_ in plain)
    rows = wide + spot + [(9, 20_000.0, 20_000.0)]
    p = [(k, rnd.uniform(-3000, 15_000), rnd.uniform(-3000, 15_000)) for k in range(150)] + [(500 + k, 5000 + rnd.random(), 5000 + rnd.random()) for k in range(50)]
    got = {r.id: (r.fid, r.distance) for r in SP.nearest_join(spark.createDataFrame(p, "id bigint, x double, y double"), spark.createDataFrame(rows, "fid bigint, fx double, fy double"), id_col="id", feature_id="fid").collect()}
    want = {i: min((math.hypot(x - a, y - b), f) for f, a, b in rows) for i, x, y in p}
    assert {i: f for i, (f, _) in got.items()} == {i: f for i, (_, f) in want.items()}


@pytest.mark.parametrize("n", [500, 6000])
def test_a_point_looks_at_few_places_first(spark, n):
    """Evenly spread features: a cell of the first level holds a few, whatever their number."""
    df = spark.range(n).selectExpr("id AS fid", "10000D * (id * 0.7548776662466927D % 1) AS fx", "10000D * (id * 0.5698402909980532D % 1) AS fy")
    start, _, placed = SP._tree(df, [], "fx", "fy", n, 0.0, 0.0, 10_000.0)
    cells = placed.filter(F.col("_level") == start).groupBy("_cx", "_cy").count().agg(F.avg("count")).first()[0]
    assert cells <= 8


def test_snap_is_brute_force(spark):
    rnd = random.Random(3)
    p = [(i, rnd.uniform(2.2, 2.4), rnd.uniform(48.8, 48.9)) for i in range(60)] + [(99, 5.0, 45.0)]
    n = [(i, rnd.uniform(2.2, 2.4), rnd.uniform(48.8, 48.9)) for i in range(80)]

    def hav(a, b):
        la, lb = math.radians(a[2]), math.radians(b[2])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371009 * math.asin(math.sqrt(h))
    got = {r.target_id: r.node_id for r in SP.snap_to_nodes(
        spark.createDataFrame(p, "target_id int, lon double, lat double"),
        spark.createDataFrame(n, "node_id int, node_lon double, node_lat double"), id_col="target_id").collect()}
    assert got == {a[0]: min(n, key=lambda b: hav(a, b))[0] for a in p}


def test_disc():
    assert len(SP.disc_offsets()) == 317
    assert (0, 0) in SP.disc_offsets() and (10, 0) in SP.disc_offsets() and (6, 8) in SP.disc_offsets()
    assert len(SP.disc_offsets(factor=None)) == 441
    assert len(SP.disc_offsets(factor=1.25)) > 317


def test_lattice_is_inside_and_numbered(spark):
    areas = spark.sql("SELECT 'a' AS neighborhood_name").withColumn("rings", G.box("2.35D", "48.85D", "2.36D", "48.86D"))
    rows = SP.target_lattice(areas, 200.0).orderBy("target_id").collect()
    assert [r.target_id for r in rows] == list(range(len(rows)))
    assert [(r.ix, r.iy) for r in rows] == sorted((r.ix, r.iy) for r in rows)
    assert all(2.35 < r.lon < 2.36 and 48.85 < r.lat < 48.86 for r in rows)
    assert len(rows) == 5 * 8
    empty = spark.sql("SELECT 'a' AS neighborhood_name").withColumn("rings", F.expr(f"CAST(NULL AS {G.RINGS_TYPE})"))
    assert SP.target_lattice(empty, 200.0).count() == 0


def skewed_reads(df):
    """Joins of the finished plan that adaptive execution has split."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


@pytest.mark.parametrize("hot", ["0", "cast(null as bigint)"])
def test_hot_and_null_keys_are_split(spark, hot):
    """A third of the rows has one key, or none, and half of those are copies of one row: the left join still spreads them."""
    keep = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        left = spark.range(90_000, numPartitions=12).selectExpr("CASE WHEN id % 6 = 0 THEN 0 ELSE id END AS id", f"CASE WHEN id % 3 = 0 THEN {hot} ELSE id END AS k")
        right = spark.range(90_000).selectExpr("id AS k", "id * 2 AS v").filter("k % 2 = 0")
        joined = left.join(right, "k", "left")
        assert skewed_reads(joined) > 0
        assert joined.count() == 90_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_number_rows_matches_a_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500).alias("o"))
    rows = number_rows(df, ["g"], [F.col("o")], F.floor(F.col("o") / 16), "n").collect()
    for g in range(3):
        mine = sorted((r.o, r.n) for r in rows if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))
    ranked = rank_by_hash(df, F.col("o") / 500.0, name="r").orderBy("r").collect()
    assert [r.r for r in ranked] == list(range(500)) and [r.o for r in ranked] == list(range(500))


def test_stars(spark):
    t = spark.sql("SELECT 'a' AS neighborhood_name, CAST(id AS int) AS target_id, id % 5 AS ix, id div 5 AS iy FROM range(20)")
    cells = FT.star_cells(t, 200.0, 100.0, 50.0)
    want = {(x + 2 * i, y + 2 * j) for x in range(5) for y in range(4) for i, j in SP.disc_offsets(200.0, 100.0)}
    assert {(r.ix, r.iy) for r in cells.collect()} == want
    feats = cells.withColumn("features", F.array((F.col("ix") * 100 + F.col("iy")).cast("float")))
    rows = FT.assemble_stars(t, feats, 200.0, 100.0, 50.0, tile=4).collect()
    assert len(rows) == 20
    for r in rows:
        assert r.num_neighbors == len(SP.disc_offsets(200.0, 100.0)) == len(r.neighbor_data)
        for n in r.neighbor_data:
            assert n.features[0] == (r.ix + n.dx / 50) * 100 + r.iy + n.dy / 50
            assert n.euclidean_distance == pytest.approx(math.hypot(n.dx, n.dy)) == n.network_distance
    none = FT.assemble_stars(t, feats.filter("ix < -100"), 200.0, 100.0, 50.0)
    assert {r.num_neighbors for r in none.collect()} == {0}
    g = FT.star_graph(none.withColumn("target_features", F.array(F.lit(1.0)))).first()
    assert (len(g.x), g.edge_index, g.edge_attr) == (1, [], [])
    with pytest.raises(ValueError):
        FT.star_cells(t, 200.0, 75.0, 50.0)
