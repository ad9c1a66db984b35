"""Spatial, street-network and accessibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footreach.constants import METERS_PER_DEGREE
from footreach.functions import geometry as G
from footreach.functions import vectors as V
from footreach.operators import features as FT
from footreach.operators import network as N
from footreach.operators import shapes as SH
from footreach.operators import spatial as SP
from footreach.plans import bindings as B
from footreach.plans.registry import query, r6

R = 1000.0
_counts = ", ".join(f"count(CASE WHEN category_index = {i} THEN 1 END) AS services_{i}" for i in range(8))

ACCESS_SQL = B.sql("targets services categories", """
, near AS (SELECT target_id, category_index, min(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) AS d
  FROM targets, services WHERE (x - fx) * (x - fx) + (y - fy) * (y - fy) <= 1000e0 * 1000e0 GROUP BY ALL),
full_grid AS (SELECT target_id, c.category_index, coalesce(d, 2400e0) AS d
  FROM targets CROSS JOIN categories c LEFT JOIN near USING (target_id, category_index)),
lists AS (SELECT target_id, list(exp(-d / 200) ORDER BY category_index) AS e, list(d ORDER BY category_index) AS ds FROM full_grid GROUP BY 1),
probs AS (SELECT target_id, ds, list_transform(e, lambda v: v / list_sum(e)) AS p FROM lists)
SELECT target_id, round(ds[1], 4) AS d_education, round(ds[3], 4) AS d_grocery, round(list_min(ds), 4) AS d_nearest,
  CAST(list_position(p, list_max(p)) - 1 AS int) AS dominant_class, round(list_max(p), 6) AS dominant_prob FROM probs""")


def nearest_by_category(points, feats, radius=R, penalty=2400.0):
    """target_id, distances[8]: nearest service of each category by straight line, the penalty when none is in reach."""
    near = SP.nearest_join(points, feats, id_col="target_id", feature_id="service_id", by="category_index",
                           by_values=list(range(8)), max_distance=radius)
    wide = near.groupBy("target_id").agg(*[F.min(F.when(F.col("category_index") == i, F.col("distance"))).alias(f"_d{i}") for i in range(8)])
    return points.select("target_id").join(wide, "target_id", "left").select(
        "target_id", F.array(*[F.coalesce(f"_d{i}", F.lit(penalty)) for i in range(8)]).alias("distances"))


@query("service_access", "J8 J9 F1 W1 G1", ACCESS_SQL)
def service_access(spark, sf):
    """Flagship: nearest service of each category, as distances and as a distribution."""
    d = nearest_by_category(B.targets(spark, sf), B.services(spark, sf)).withColumn("p", V.distance_softmax("distances"))
    return d.select("target_id", F.round(F.get("distances", F.lit(0)), 4).alias("d_education"),
                    F.round(F.get("distances", F.lit(2)), 4).alias("d_grocery"), F.round(F.array_min("distances"), 4).alias("d_nearest"),
                    V.argmax_class("p").alias("dominant_class"), r6(F.array_max("p")).alias("dominant_prob"))


@query("service_counts", "A2 J8", B.sql("targets services", f"""
SELECT target_id, {_counts} FROM targets LEFT JOIN services ON (x - fx) * (x - fx) + (y - fy) * (y - fy) <= 1000e0 * 1000e0 GROUP BY 1"""))
def service_counts(spark, sf):
    out = FT.service_counts(B.targets(spark, sf), B.services(spark, sf), R)
    return out.select("target_id", *[f"services_{i}" for i in range(8)])


@query("services_within_radius", "J8", B.sql("targets services", """
SELECT target_id, count(*) AS pairs, round(sum(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))), 3) AS total_distance
FROM targets, services WHERE (x - fx) * (x - fx) + (y - fy) * (y - fy) <= 500e0 * 500e0 GROUP BY 1"""))
def services_within_radius(spark, sf):
    pairs = SP.distance_join(B.targets(spark, sf).select("target_id", "x", "y"), B.services(spark, sf).select("service_id", "fx", "fy"), 500.0)
    return pairs.groupBy("target_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("distance"), 3).alias("total_distance"))


@query("mercator_round_trip", "G1", B.sql("targets", """
SELECT target_id, round(x, 3) AS x, round(y, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM targets"""))
def mercator_round_trip(spark, sf):
    t = B.targets(spark, sf)
    return t.select("target_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                    r6(G.lon_of("x")).alias("lon"), r6(G.lat_of("y")).alias("lat"))


@query("area_buffer_members", "G2 G8", B.sql("targets areas", f"""
, d AS (SELECT area_id, target_id, greatest(x0 - lon, lon - x1, 0e0) AS dx, greatest(y0 - lat, lat - y1, 0e0) AS dy FROM targets, areas)
SELECT area_id, count(*) AS members FROM d WHERE sqrt(dx * dx + dy * dy) < 500 / {METERS_PER_DEGREE}e0 GROUP BY 1"""))
def area_buffer_members(spark, sf):
    grow = 500.0 / METERS_PER_DEGREE
    t = B.targets(spark, sf).select("target_id", "lon", "lat")
    near = SP.distance_join(t, B.areas(spark, sf).select("area_id", "rings"), grow, x="lon", y="lat", rings="rings", cell=0.02)
    return near.filter(G.within_buffer("rings", "lon", "lat", 500.0)).groupBy("area_id").agg(F.count(F.lit(1)).alias("members"))


@query("building_areas", "G3 G13", B.sql("buildings", f"""
SELECT building_id, round(4 * half * half * {METERS_PER_DEGREE}e0 * {METERS_PER_DEGREE}e0, 3) AS area_degrees,
  round(({B.mx('lon + half')} - {B.mx('lon - half')}) * ({B.my('lat + half')} - {B.my('lat - half')}), 3) AS area_mercator,
  round(lon, 6) AS cx, round(lat, 6) AS cy FROM buildings"""))
def building_areas(spark, sf):
    b = B.buildings(spark, sf)
    c = G.centroid("rings")
    return b.select("building_id", F.round(G.area_m2("rings", "degrees"), 3).alias("area_degrees"),
                    F.round(G.area("mrings"), 3).alias("area_mercator"), r6(c["x"]).alias("cx"), r6(c["y"]).alias("cy"))


_LATTICE = f"""
, box AS (SELECT area_id, name, {B.mx('x0')} AS ax, {B.my('y0')} AS ay, {B.mx('x1')} AS bx, {B.my('y1')} AS by_ FROM areas),
cols AS (SELECT *, unnest(generate_series(0, CAST(ceil((bx - ax) / STEP) AS bigint))) AS ix FROM box),
grid AS (SELECT *, unnest(generate_series(0, CAST(ceil((by_ - ay) / STEP) AS bigint))) AS iy FROM cols),
lattice AS (SELECT name AS neighborhood_name, area_id, ix, iy, ax + ix * STEP AS x, ay + iy * STEP AS y FROM grid
  WHERE ax + ix * STEP > ax AND ax + ix * STEP < bx AND ay + iy * STEP > ay AND ay + iy * STEP < by_)"""


def lattice_sql(step: float) -> str:
    return _LATTICE.replace("STEP", f"{step}e0")


def lattice(spark, sf, step):
    """Target lattice of every area; 13 m and wider steps are used with the test tables."""
    a = B.areas(spark, sf).select(F.col("name").alias("neighborhood_name"), "rings")
    return SP.target_lattice(a, step)


@query("target_lattice", "G4 W8", B.sql("areas", lattice_sql(100) + """
SELECT neighborhood_name, row_number() OVER (PARTITION BY neighborhood_name ORDER BY ix, iy) - 1 AS target_id, ix, iy,
  round(x, 3) AS x, round(y, 3) AS y FROM lattice"""))
def target_lattice(spark, sf):
    return lattice(spark, sf, 100.0).select("neighborhood_name", "target_id", "ix", "iy", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("lattice_impact", "G20", B.sql("areas", f"""
, sizes AS ({' UNION ALL '.join(f"SELECT neighborhood_name, {s} AS s FROM ({B.sql('areas', lattice_sql(s) + ' SELECT * FROM lattice')})" for s in (50, 100, 200))})
, wide AS (SELECT coalesce(neighborhood_name, 'TOTAL') AS neighborhood_name, count(CASE WHEN s = 50 THEN 1 END) AS points_50,
  count(CASE WHEN s = 100 THEN 1 END) AS points_100, count(CASE WHEN s = 200 THEN 1 END) AS points_200 FROM sizes GROUP BY ROLLUP (neighborhood_name))
SELECT neighborhood_name, points_50, points_100, points_200, round(points_50 / points_200, 6) AS growth_50, round(points_100 / points_200, 6) AS growth_100 FROM wide"""))
def lattice_impact(spark, sf):
    a = B.areas(spark, sf).select(F.col("name").alias("neighborhood_name"), "rings")
    out = SP.lattice_impact(a, [50.0, 100.0, 200.0])
    return out.select("neighborhood_name", "points_50", "points_100", "points_200", r6("growth_50").alias("growth_50"), r6("growth_100").alias("growth_100"))


def _disc_sql(limit: str) -> str:
    return B.sql("targets", f"""
, offs AS (SELECT i, j FROM (SELECT unnest(generate_series(-10, 10)) AS i), (SELECT unnest(generate_series(-10, 10)) AS j) WHERE {limit})
SELECT target_id, count(*) AS cells, round(sum(sqrt(i * i + j * j) * 100), 3) AS distance_sum, round(max(x + i * 100), 3) AS east,
  round(min(y + j * 100), 3) AS south FROM targets, offs GROUP BY 1""")


def _disc(spark, sf, factor):
    cells = SP.disc_cells(B.targets(spark, sf).select("target_id", "x", "y"), factor=factor)
    return cells.groupBy("target_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("euclidean_distance"), 3).alias("distance_sum"),
                                          F.round(F.max("cell_x"), 3).alias("east"), F.round(F.min("cell_y"), 3).alias("south"))


@query("disc_square", "G5", _disc_sql("true"))
def disc_square(spark, sf):
    return _disc(spark, sf, None)


@query("disc_cells", "G6", _disc_sql("i * i + j * j <= 100"))
def disc_cells(spark, sf):
    return _disc(spark, sf, 1.0)


@query("disc_prefilter", "G7", _disc_sql("i * i + j * j <= 156.25"))
def disc_prefilter(spark, sf):
    return _disc(spark, sf, 1.25)


@query("points_in_areas", "G8 J7 W8", B.sql("targets areas", """
SELECT target_id, area_id, name AS neighborhood_name FROM targets LEFT JOIN areas ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1""").replace(
    "SELECT target_id, area_id, name AS", "SELECT target_id, area_id, areas.name AS"))
def points_in_areas(spark, sf):
    a = B.areas(spark, sf).select("area_id", F.col("name").alias("neighborhood_name"), "rings")
    out = SP.within_join(B.targets(spark, sf).select("target_id", "lon", "lat"), a, 0.02, x="lon", y="lat")
    return out.select("target_id", "area_id", "neighborhood_name")


@query("buildings_within_areas", "G9", B.sql("buildings areas", """
SELECT area_id, count(*) AS buildings, round(sum(area_m2), 2) AS area_m2 FROM buildings, areas
WHERE lon - half >= x0 AND lon + half <= x1 AND lat - half >= y0 AND lat + half <= y1 GROUP BY 1"""))
def buildings_within_areas(spark, sf):
    a = B.areas(spark, sf).select("area_id", F.col("rings").alias("other_rings"))
    got = SP.intersects_join(B.buildings(spark, sf).select("building_id", "area_m2", "rings"), a, 0.02, relation="within")
    return got.groupBy("area_id").agg(F.count(F.lit(1)).alias("buildings"), F.round(F.sum("area_m2"), 2).alias("area_m2"))


@query("units_meeting_areas", "G10 J6", B.sql("unit_boxes areas", """
SELECT code, area_id FROM unit_boxes u, areas a WHERE u.x0 <= a.x1 AND u.x1 >= a.x0 AND u.y0 <= a.y1 AND u.y1 >= a.y0"""))
def units_meeting_areas(spark, sf):
    a = B.areas(spark, sf).select("area_id", F.col("rings").alias("other_rings"))
    return SP.intersects_join(B.unit_boxes(spark, sf), a, 0.02).select("code", "area_id")


def _box_distance(alias: str = "") -> str:
    w, e, s, n = B.mx("lon - half"), B.mx("lon + half"), B.my("lat - half"), B.my("lat + half")
    return f"SELECT *, {w} AS w, {e} AS e, {s} AS s, {n} AS n FROM buildings"


_NEAR_BUILDINGS = f"""
, boxes AS ({_box_distance()}),
d AS (SELECT target_id, building_id, levels, sqrt(pow(greatest(w - x, x - e, 0e0), 2) + pow(greatest(s - y, y - n, 0e0), 2)) AS d
  FROM targets, boxes WHERE x >= w - 200 AND x <= e + 200 AND y >= s - 200 AND y <= n + 200)"""


@query("building_distances", "G11 G12", B.sql("targets buildings", _NEAR_BUILDINGS + """
SELECT target_id, count(*) AS near, round(min(d), 3) AS nearest, count(CASE WHEN d = 0 THEN 1 END) AS inside FROM d WHERE d <= 200 GROUP BY 1"""))
def building_distances(spark, sf):
    near = SP.distance_join(B.targets(spark, sf).select("target_id", "x", "y"), B.buildings(spark, sf).select("building_id", "mrings"),
                            200.0, rings="mrings")
    return near.groupBy("target_id").agg(F.count(F.lit(1)).alias("near"), F.round(F.min("distance"), 3).alias("nearest"),
                                         F.count_if(F.col("distance") == 0).alias("inside"))


@query("built_form", "A3 G11 P9", B.sql("targets buildings", _NEAR_BUILDINGS + """
, g AS (SELECT target_id, count(*) AS c, avg(try_cast(levels AS double)) AS l FROM d WHERE d <= 100 GROUP BY 1)
SELECT target_id, coalesce(c, 0) AS building_count, round(coalesce(c, 0) / (pi() * 100 * 100), 9) AS building_density,
  round(coalesce(l, 0e0), 6) AS average_levels, 0e0 AS floor_area_per_capita FROM targets LEFT JOIN g USING (target_id)"""))
def built_form(spark, sf):
    out = FT.built_form(B.targets(spark, sf), B.buildings(spark, sf), rings="mrings")
    return out.select("target_id", "building_count", F.round("building_density", 9).alias("building_density"),
                      r6("average_levels").alias("average_levels"), "floor_area_per_capita")


@query("dissolved_parts", "G14 G3", B.sql("areas buildings", """
SELECT home, count(*) AS parts, round(sum(4 * half * half) * 1e6, 6) AS area
FROM (SELECT c_nationkey AS home, half FROM buildings JOIN customer ON owner = c_custkey) GROUP BY 1"""))
def dissolved_parts(spark, sf):
    b = B.buildings(spark, sf).select("owner", "rings")
    home = B.targets(spark, sf).select(F.col("target_id").alias("owner"), "home")
    shape = b.join(home, "owner").select("home", "rings").withColumn("whole", G.dissolve("rings")).select(
        "home", G.area("whole").alias("a"), F.size("whole").alias("n"))
    return shape.groupBy("home").agg(F.sum("n").alias("parts"), F.round(F.sum("a") * 1e6, 6).alias("area"))


@query("union_outlines", "G14 G3", B.sql("unit_boxes", """
, xs AS (SELECT DISTINCT home, x FROM (SELECT home, x0 AS x FROM unit_boxes UNION ALL SELECT home, x1 FROM unit_boxes)),
slabs AS (SELECT home, x AS a, lead(x) OVER (PARTITION BY home ORDER BY x) AS b FROM xs),
live AS (SELECT s.home, a, b, y0, y1, max(y1) OVER (PARTITION BY s.home, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM slabs s JOIN unit_boxes u ON u.home = s.home AND u.x0 <= a AND u.x1 >= b)
SELECT home, round(sum((b - a) * greatest(y1 - greatest(y0, coalesce(top, y0)), 0)) * 1e6, 3) AS area FROM live GROUP BY 1"""))
def union_outlines(spark, sf):
    """Overlapping unit boxes of each home as one outline without inner edges; the SQL adds covered lengths slab by slab."""
    out = SH.union_shapes(B.unit_boxes(spark, sf), ["home"], snap=1e-11)
    return out.select("home", F.round(G.area("rings") * 1e6, 3).alias("area"))


_HAV = ("2 * 6371009e0 * asin(least(sqrt(pow(sin((radians(n.lat) - radians(t.lat)) / 2), 2) + cos(radians(t.lat)) * cos(radians(n.lat))"
        " * pow(sin(radians(n.lon - t.lon) / 2), 2)), 1e0))")


@query("snap_to_nodes", "G15 J9", B.sql("targets nodes", f"""
, d AS (SELECT target_id, node_id, {_HAV} AS d FROM targets t, nodes n),
best AS (SELECT target_id, min(d) AS d FROM d GROUP BY 1)
SELECT target_id, min(node_id) AS node_id, round(min(best.d), 3) AS distance FROM best JOIN d USING (target_id) WHERE d.d = best.d GROUP BY 1"""))
def snap_to_nodes(spark, sf):
    n = B.nodes(spark, sf).select("node_id", F.col("lon").alias("node_lon"), F.col("lat").alias("node_lat"))
    out = SP.snap_to_nodes(B.targets(spark, sf), n, id_col="target_id")
    return out.select("target_id", "node_id", F.round("distance", 3).alias("distance"))


@query("geometry_validity", "G16 Q17", B.sql("buildings", """
SELECT owner % 7 AS grp, count(*) AS geometries, count(CASE WHEN building_id % 9 = 4 THEN 1 END) AS invalid_geometries FROM buildings GROUP BY 1"""))
def geometry_validity(spark, sf):
    """Every ninth footprint is twisted into a bow tie, which must be the ones found."""
    from footreach.operators.checks import check_geometry
    b = B.buildings(spark, sf)
    r = F.col("rings")[0]
    tie = F.array(F.array(r[0], r[1], r[3], r[2], r[4]))
    shapes = b.select((F.col("owner") % 7).alias("grp"), F.when(F.col("building_id") % 9 == 4, tie).otherwise(F.col("rings")).alias("rings"))
    return check_geometry(shapes, by=["grp"])


@query("total_bounds", "G17 Q16", B.sql("services", """
SELECT round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax,
  min(lon) >= 2.2e0 AND min(lat) >= 48.8e0 AND max(lon) <= 2.4e0 AND max(lat) <= 48.9e0 AS inside FROM services"""))
def total_bounds(spark, sf):
    out = SP.check_bounds(B.services(spark, sf), (2.2, 48.8, 2.4, 48.9))
    return out.select(*[r6(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], "inside")


@query("wkt_points", "G18", B.sql("targets", "SELECT target_id, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS is_point FROM targets"))
def wkt_points(spark, sf):
    t = B.targets(spark, sf).withColumn("wkt", G.to_wkt("lon", "lat")).withColumn("p", G.from_wkt("wkt"))
    return t.select("target_id", r6("p.x").alias("lon"), r6("p.y").alias("lat"), F.col("wkt").startswith("POINT").alias("is_point"))


@query("features_by_tag", "G19 J5", B.sql("tagged areas", """
SELECT area_id, count(*) AS features FROM tagged, areas WHERE (amenity IN ('cafe', 'school', 'bank', 'pharmacy') OR leisure IS NOT NULL)
  AND lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY 1"""))
def features_by_tag(spark, sf):
    a = B.areas(spark, sf).select("area_id", "rings")
    got = SP.select_features(B.tagged(spark, sf), a, {"amenity": ["cafe", "school", "bank", "pharmacy"], "leisure": []}, 0.02, x="lon", y="lat")
    return got.groupBy("area_id").agg(F.count(F.lit(1)).alias("features"))


# ---- street network ------------------------------------------------------------------------------

@query("shortest_path_lengths", "N1", B.sql("edges nodes", """
, pairs AS (SELECT node_id AS pair_id, node_id AS a, CAST((node_id * 3 + 1) % (SELECT count(*) FROM supplier) AS bigint) AS b FROM nodes),
hop AS (SELECT src, dst, min(length) AS length FROM edges GROUP BY 1, 2),
walk(s, node, d) USING KEY (s, node) AS (SELECT DISTINCT a, a, 0e0 FROM pairs
  UNION SELECT w.s, h.dst, min(w.d + h.length) FROM walk w JOIN hop h ON h.src = w.node LEFT JOIN recurring.walk r ON r.s = w.s AND r.node = h.dst
  WHERE r.d IS NULL OR w.d + h.length < r.d GROUP BY 1, 2)
SELECT pair_id, coalesce(round(d, 6), -1e0) AS path_length FROM pairs LEFT JOIN walk ON s = a AND node = b""", recursive=True))
def shortest_path_lengths(spark, sf):
    """One pair per node, each from its own start; no path is shown as -1."""
    n = B.nodes(spark, sf)
    total = n.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    pairs = n.select(F.col("node_id").alias("pair_id"), F.col("node_id").alias("from_node"), ((F.col("node_id") * 3 + 1) % total).alias("to_node"))
    out = N.path_length(B.edges(spark, sf), pairs)
    return out.select("pair_id", F.when(F.col("path_length") == float("inf"), F.lit(-1.0)).otherwise(r6("path_length")).alias("path_length"))


_NETWORK = f"""
, hop AS (SELECT src, dst, min(length) AS length FROM edges GROUP BY 1, 2),
dt AS (SELECT target_id AS id, node_id, {_HAV} AS d FROM targets t, nodes n),
ds AS (SELECT service_id AS id, category_index, node_id, {_HAV} AS d FROM services t, nodes n),
tn AS (SELECT id, arg_min(node_id, d) AS node FROM dt GROUP BY 1),
sn AS (SELECT DISTINCT category_index AS c, node FROM (SELECT id, category_index, arg_min(node_id, d) AS node FROM ds GROUP BY 1, 2)),
walk(c, node, d) USING KEY (c, node) AS (SELECT c, node, 0e0 FROM sn
  UNION SELECT w.c, h.src, min(w.d + h.length) FROM walk w JOIN hop h ON h.dst = w.node LEFT JOIN recurring.walk r ON r.c = w.c AND r.node = h.src
  WHERE r.d IS NULL OR w.d + h.length < r.d GROUP BY 1, 2),
filled AS (SELECT tn.id, k.category_index AS c, coalesce(w.d, 2400e0) AS d FROM tn CROSS JOIN categories k LEFT JOIN walk w ON w.c = k.category_index AND w.node = tn.node),
lists AS (SELECT id AS target_id, list(d ORDER BY c) AS ds FROM filled GROUP BY 1)"""


@query("nearest_service_by_network", "N2 G15 F1 W1 J9", B.sql("targets services nodes edges categories", _NETWORK + f"""
, p AS (SELECT target_id, ds, {B.sql_softmax("list_transform(ds, lambda q: -q / 200)")} AS p FROM lists)
SELECT target_id, {', '.join(f'round(ds[{i + 1}], 3) AS d{i}' for i in range(8))}, round(list_max(p), 6) AS top_prob FROM p""", recursive=True))
def nearest_service_by_network(spark, sf):
    """Suppliers are the junctions; only one service in many starts on a given one."""
    nodes = B.nodes(spark, sf).select("node_id", F.col("lon").alias("node_lon"), F.col("lat").alias("node_lat"))
    d = N.nearest_by_network(B.targets(spark, sf), B.services(spark, sf), nodes, B.edges(spark, sf), category="category_index")
    d = N.target_probabilities(d)
    return d.select("target_id", *[F.round(F.get("distances", F.lit(i)), 3).alias(f"d{i}") for i in range(8)],
                    r6(F.array_max("target_prob_vector")).alias("top_prob"))


@query("street_intersections", "N3", B.sql("nodes edges", """
, e AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT node_id, count(*) AS degree FROM e GROUP BY 1)
SELECT node_id, degree FROM nodes JOIN g USING (node_id) WHERE degree >= 3"""))
def street_intersections(spark, sf):
    return N.intersections(B.nodes(spark, sf), B.edges(spark, sf)).select("node_id", "degree")


@query("component_share", "N4 Q11", B.sql("nodes edges", """
, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
lab(node, comp) USING KEY (node) AS (SELECT node_id, node_id FROM nodes
  UNION SELECT e.b, min(l.comp) FROM lab l JOIN both_ways e ON e.a = l.node JOIN recurring.lab r ON r.node = e.b WHERE l.comp < r.comp GROUP BY 1),
sizes AS (SELECT comp, count(*) AS size FROM lab GROUP BY 1)
SELECT count(*) AS components, max(size) AS largest, CAST(sum(size) AS bigint) AS nodes, round(max(size) / sum(size), 6) AS share FROM sizes""", recursive=True))
def component_share(spark, sf):
    return N.component_share(B.nodes(spark, sf), B.edges(spark, sf)).withColumn("share", r6("share"))


@query("edge_statistics", "N5 Q12 Q13", B.sql("edges", "SELECT count(*) AS edges, round(avg(length), 6) AS mean_length, max(length) AS max_length FROM edges"))
def edge_statistics(spark, sf):
    return N.edge_stats(B.edges(spark, sf)).withColumn("mean_length", r6("mean_length"))


@query("graph_counts", "N6 Q9 Q10", B.sql("nodes edges", """
SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / count(*), 6) AS edges_per_node FROM nodes"""))
def graph_counts(spark, sf):
    return N.graph_counts(B.nodes(spark, sf), B.edges(spark, sf)).withColumn("edges_per_node", r6("edges_per_node"))


_CENTRES = """
, deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
dn AS (SELECT x AS fx, y AS fy, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id)),
centres AS (SELECT (a.x + b.x) / 2 AS fx, (a.y + b.y) / 2 AS fy, length FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst),
ped AS (SELECT fx, fy FROM services WHERE size <= 10)"""


def _near(r: int) -> str:
    return f"(t.x - f.fx) * (t.x - f.fx) + (t.y - f.fy) * (t.y - f.fy) <= {r}e0 * {r}e0"


@query("intersection_density", "N8", B.sql("targets nodes edges services", _CENTRES + f"""
SELECT target_id, count(CASE WHEN degree >= 3 THEN 1 END) AS intersections, round(count(CASE WHEN degree >= 3 THEN 1 END) / (pi() * 1500 * 1500) * 1e6, 6) AS density_per_km2
FROM targets t LEFT JOIN dn f ON {_near(1500)} GROUP BY 1"""))
def intersection_density(spark, sf):
    deg = N.node_degrees(B.nodes(spark, sf), B.edges(spark, sf)).select(F.col("x").alias("fx"), F.col("y").alias("fy"), "degree")
    out = N.intersection_density(B.targets(spark, sf), deg, 1500.0)
    return out.select("target_id", "intersections", r6(F.col("intersection_density") * 1e6).alias("density_per_km2"))


@query("block_length", "N9", B.sql("targets nodes edges services", _CENTRES + f"""
SELECT target_id, round(coalesce(avg(length), 0e0), 6) AS average_block_length FROM targets t LEFT JOIN centres f ON {_near(1500)} GROUP BY 1"""))
def block_length(spark, sf):
    c = N.edge_centres(B.edges(spark, sf), B.nodes(spark, sf))
    out = N.block_length(B.targets(spark, sf), c, 1500.0)
    return out.select("target_id", r6("average_block_length").alias("average_block_length"))


@query("pedestrian_ratio", "N10", B.sql("targets nodes edges services", _CENTRES + f"""
, p AS (SELECT target_id, count(f.fx) AS ped FROM targets t LEFT JOIN ped f ON {_near(1500)} GROUP BY 1),
s AS (SELECT target_id, count(f.fx) AS streets FROM targets t LEFT JOIN centres f ON {_near(1500)} GROUP BY 1)
SELECT target_id, round(ped / greatest(streets, 1), 6) AS pedestrian_street_ratio, CASE WHEN ped > 0 THEN 1e0 ELSE 0e0 END AS sidewalk_presence FROM p JOIN s USING (target_id)"""))
def pedestrian_ratio(spark, sf):
    ped = B.services(spark, sf).filter(F.col("size") <= 10).select("fx", "fy")
    c = N.edge_centres(B.edges(spark, sf), B.nodes(spark, sf))
    out = N.pedestrian_ratio(B.targets(spark, sf), ped, c, 1500.0)
    return out.select("target_id", r6("pedestrian_street_ratio").alias("pedestrian_street_ratio"), "sidewalk_presence")
