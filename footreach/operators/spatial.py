"""Spatial joins, lattices and walking discs.

All joins are equi joins on integer cell keys with an exact test behind them; no cross join, no all-pairs scan.
Planar coordinates are metres (see `with_mercator`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach.constants import GRID_CELL_M, LATTICE_STEP_M, WALK_RADIUS_M
from footreach.functions import geometry as G
from footreach.operators.discs import sums_by_tile
from footreach.operators.routing import ranked_blocks
from footreach.operators.shapes import related
from footreach.operators.skew import number_rows
from footreach.session import cut_lineage


def with_mercator(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn(x, G.mercator_x(lon)).withColumn(y, G.mercator_y(lat))


def cell_of_sql(v: str, size: float) -> str:
    return f"floor({v} / {float(size)!r}D)"


def cell_of(v: str, size: float) -> Column:
    return F.expr(cell_of_sql(v, size))


def _cover(df: DataFrame, box: Column, size: float, grow: float = 0.0) -> DataFrame:
    """One row per cell that the box, grown by `grow`, touches; adds _cx, _cy and the box as _box."""
    def span(c):
        lo, hi = (cell_of_sql(f"(_box.{c}{end} {sign} {float(grow)!r}D)", size) for end, sign in (("min", "-"), ("max", "+")))
        return F.expr(f"explode(sequence({lo}, {hi}))")
    return df.withColumn("_box", box).withColumn("_cx", span("x")).withColumn("_cy", span("y"))


def _by_cell(df: DataFrame) -> DataFrame:
    """Rows dealt by cell before an exact test, whose work is not in their bytes: as many tasks as the session has partitions.

    Without it a small file, or a join that Spark turns into a broadcast, leaves all geometry to the tasks that read.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cx", "_cy")


def _point_box(x: str, y: str) -> Column:
    return F.expr(f"named_struct('xmin', {x}, 'ymin', {y}, 'xmax', {x}, 'ymax', {y})")


def _offset_array(offsets, kind: str = "bigint", scale: int = 1) -> Column:
    """Literal array of (i, j) structs, in one piece."""
    pairs = ", ".join(f"({i * scale}, {j * scale})" for i, j in offsets)
    return F.expr(f"CAST(array({pairs}) AS array<struct<i:{kind},j:{kind}>>)")


# ---- joins ---------------------------------------------------------------------------------------

def distance_join(points: DataFrame, features: DataFrame, radius: float, *, x: str = "x", y: str = "y",
                  fx: str = "fx", fy: str = "fy", rings: str | None = None, cell: float | None = None,
                  how: str = "inner", spread: str = "features") -> DataFrame:
    """Every (point, feature) within `radius`, with `distance`.

    A point sits in one cell; a feature is repeated over the few cells its box, grown by the radius, touches, so each
    pair meets once and nothing has to be deduplicated. With spread="points", for narrow points that are fewer than the features,
    a feature lies in the cells of its own box, and a point is repeated over those it can reach; the first cell common to both keeps
    the pair (inner joins only). With `rings`, the
    distance is to the polygon (0 inside), not to its centroid; a polygon that is its own box is measured as one.
    """
    size = cell or radius
    features = _boxed(features, rings) if rings else features.withColumn("_box", _point_box(fx, fy))
    r = f"{float(radius)!r}D"
    if spread == "points":
        if how != "inner":
            raise ValueError("points are spread for inner joins only")
        reach = {v: f"({r} + least(1e-14D * (abs({v}) + {r}), {r}))" for v in (x, y)}  # a little more than the radius, whatever is rounded
        lo = {v: cell_of_sql(f"({v} - {reach[v]})", size) for v in (x, y)}
        span = {v: F.expr(f"explode(sequence({lo[v]}, {cell_of_sql(f'({v} + {reach[v]})', size)}))") for v in (x, y)}
        left = _by_cell(points.filter(_finite(x, y)).withColumn("_cx", span[x]).withColumn("_cy", span[y]))
        right = _exploded(_cover(features, F.col("_box"), size))
        once = "".join(f" AND {c} = greatest({lo[v]}, {cell_of_sql(f'_box.{v0}min', size)})" for c, v, v0 in (("_cx", x, "x"), ("_cy", y, "y")))
    else:
        left = _by_cell(points.withColumn("_cx", cell_of(x, size)).withColumn("_cy", cell_of(y, size)))
        right, once = _exploded(_cover(features, F.col("_box"), size, radius)), ""
    same = F.expr(f"_cx = _rx AND _cy = _ry{once} AND {x} >= _box.xmin - {r} AND {x} <= _box.xmax + {r} AND {y} >= _box.ymin - {r} AND {y} <= _box.ymax + {r}")
    exact = G.polygon_distance(rings, x, y) if rings else G.distance(x, y, fx, fy)
    if how == "inner":  # the exact distance is computed once and filtered
        def met(features: DataFrame, exact: Column) -> DataFrame:
            return left.join(features, same).withColumn("distance", exact).filter(F.col("distance") <= F.expr(r)).drop("_cx", "_cy", "_rx", "_ry", "_box", "_flat")
        if not rings:
            return met(right, exact)
        return met(right.filter("_flat"), G.box_distance("_box", x, y)).unionByName(met(right.filter("not _flat"), exact))
    # else the exact test belongs to the join, so that a left join keeps each point once, null attributes and copies included
    return left.join(right, same & (exact <= F.expr(r)), how).withColumn("distance", exact).drop("_cx", "_cy", "_rx", "_ry", "_box", "_flat")


def _boxed(polygons: DataFrame, rings: str) -> DataFrame:
    """Polygons with their box and whether they are it, written: pushed into the scan, a filter on them would rebuild the rings at each mention."""
    return cut_lineage(polygons.withColumn("_box", G.bounds(rings)).withColumn("_flat", G.is_rectangle(rings)))


def _exploded(cover: DataFrame) -> DataFrame:
    """A join's side of rows repeated over cells. Spark would take its size from the rows before that and send it through the driver."""
    return cover.withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"}).hint("merge")


def within_join(points: DataFrame, polygons: DataFrame, cell: float, *, x: str = "x", y: str = "y",
                rings: str = "rings", strict: bool = True, how: str = "left") -> DataFrame:
    """Point in polygon by cell key, box and exact test (a polygon that is its own box needs no other); with `left`, points outside every polygon stay, with nulls."""
    test = G.contains_point if strict else G.covers_point
    left = _by_cell(points.withColumn("_cx", cell_of(x, cell)).withColumn("_cy", cell_of(y, cell)))
    right = _cover(_boxed(polygons, rings), F.col("_box"), cell)
    le = "<" if strict else "<="
    inside = F.expr(f"_cx = _rx AND _cy = _ry AND _box.xmin {le} {x} AND {x} {le} _box.xmax AND _box.ymin {le} {y} AND {y} {le} _box.ymax")

    def met(some: DataFrame, more: Column) -> DataFrame:
        return left.join(_exploded(some), inside & more, how).drop("_cx", "_cy", "_rx", "_ry", "_box", "_flat")
    exact = test(rings, x, y)
    if how == "inner":
        return met(right.filter("_flat"), F.lit(True)).unionByName(met(right.filter("not _flat"), exact))
    return met(right, F.col("_flat") | exact)


def least_within(points: DataFrame, polygons: DataFrame, cell: float, *, by: list[str], code: str = "code", x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """by..., code: the least code of the polygons that a group of points lies strictly in; groups in none are left out.

    The codes' ranks are compared, not the codes: numbers stay in a hash aggregate beside the join, text would be sorted, a row a pair.
    """
    ranks = cut_lineage(ranked_blocks(polygons.select(F.col(code).alias("node")).filter("node is not null").distinct(), F.col("node"), 1))
    ranked = polygons.select(F.col(code).alias("node"), rings).join(ranks, "node").select("block", rings)
    least = within_join(points.select(*by, x, y), ranked, cell, x=x, y=y, rings=rings, how="inner").groupBy(*by).agg(F.min("block").alias("block"))
    return least.join(ranks, "block").select(*by, F.col("node").alias(code))


def intersects_join(left: DataFrame, right: DataFrame, cell: float, *, rings: str = "rings",
                    other: str = "other_rings", relation: str = "intersects") -> DataFrame:
    """Polygon pairs that intersect (or `within`: left inside right).

    Both boxes may share several cells; only the cell of the lower-left corner of the common box keeps the pair.
    """
    a = _by_cell(_cover(left, G.bounds(rings), cell)).withColumnRenamed("_box", "_a")
    b = _cover(right, G.bounds(other), cell).withColumnRenamed("_box", "_b")
    lo_x, lo_y = "greatest(_a.xmin, _b.xmin)", "greatest(_a.ymin, _b.ymin)"
    met = a.join(b, ["_cx", "_cy"]).filter(
        f"{lo_x} <= least(_a.xmax, _b.xmax) AND {lo_y} <= least(_a.ymax, _b.ymax)"
        f" AND {cell_of_sql(lo_x, cell)} = _cx AND {cell_of_sql(lo_y, cell)} = _cy")
    return related(met.drop("_cx", "_cy", "_a", "_b"), rings, other, relation)


def _finite(*cols: str) -> str:
    return " AND ".join(f"abs({c}) < double('infinity')" for c in cols)


def radius_aggregate(points: DataFrame, features: DataFrame, radius: float, measures: dict[str, Column], *,
                     x: str = "x", y: str = "y", fx: str = "fx", fy: str = "fy") -> DataFrame:
    """Sums over all features within `radius` of each point; points keep all their columns, sums are 0 when none.

    Features are summed per place and each distinct place of the points is looked at once; places meet in tiles, where a
    disc adds runs of places by running totals (`discs`), so the pairs are neither listed nor tested one by one.
    """
    names = list(measures)
    placed = features.select(F.col(fx).cast("double").alias("_fx"), F.col(fy).cast("double").alias("_fy"), *[e.alias(n) for n, e in measures.items()])
    places = placed.filter(_finite("_fx", "_fy")).groupBy("_fx", "_fy").agg(*[F.sum(n).alias(n) for n in names])
    types = {n: places.schema[n].dataType.simpleString() for n in names}
    kinds = {n: t if t == "bigint" else "double" for n, t in types.items()}
    places = places.select("_fx", "_fy", *[F.coalesce(F.col(n).cast(k), F.lit(0).cast(k)).alias(n) for n, k in kinds.items()])
    spots = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(_finite("_x", "_y")).distinct()
    found = sums_by_tile(spots, places, radius, kinds)
    found = found.select("_x", "_y", *[F.col(n).cast(t).alias(n) for n, t in types.items()])
    out = points.join(found, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")
    return out.fillna(0, names)


def _extent(df: DataFrame, x: str, y: str):
    """One row of bounds and a count; the only thing brought to the driver."""
    return df.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.count(F.lit(1))).first()


STEP = 4  # a cell of the search tree has STEP x STEP children
CELL_PLACES = 64  # a cell with more places than this is split
START_PLACES = 8  # most places a cell would hold at the first level if they lay evenly: a point looks at nine cells there
TREE_DEPTH = 14


def _tree(feats: DataFrame, group: list[str], fx: str, fy: str, n: int, x0: float, y0: float, width: float) -> tuple[int, list[DataFrame], DataFrame]:
    """(first level made, cells of each level, features with their leaf) of a tree over the features' places, split only where they are dense.

    cells: group..., _cx, _cy, _leaf. Levels above the average density are rolled up from the level below; from there on
    a cell of more than CELL_PLACES places is split, and so is nothing else, so a dense spot leaves the other cells as they are.
    """
    start = max(1, min(TREE_DEPTH, math.ceil(math.log(max(n, 1) / START_PLACES, STEP * STEP))))
    rest, levels, placed = feats, [], None
    for level in range(start, TREE_DEPTH + 1):
        size = width / STEP**level
        here = cut_lineage(rest.withColumn("_cx", F.floor((F.col(fx) - F.lit(x0)) / F.lit(size))).withColumn("_cy", F.floor((F.col(fy) - F.lit(y0)) / F.lit(size))))
        leaf = F.col("_n") <= CELL_PLACES if level < TREE_DEPTH else F.lit(True)
        cells = cut_lineage(here.groupBy(*group, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).withColumn("_leaf", leaf).drop("_n"))
        levels.append(cells)
        marked = here.join(cells, [*group, "_cx", "_cy"])
        done = marked.filter("_leaf").drop("_leaf").withColumn("_level", F.lit(level))
        placed = done if placed is None else placed.unionByName(done)
        rest = marked.filter("not _leaf").drop("_leaf", "_cx", "_cy")
        if cells.filter("not _leaf").isEmpty():
            break
    for _ in range(start - 1):
        above = levels[0].selectExpr(*group, f"floor(_cx / {STEP}) AS _cx", f"floor(_cy / {STEP}) AS _cy").distinct().withColumn("_leaf", F.lit(False))
        levels.insert(0, cut_lineage(above))
    return start, levels, placed


def _around(df: DataFrame) -> DataFrame:
    """Each row in its cell and the eight cells around it."""
    return df.withColumn("_o", F.explode(_offset_array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))).withColumn(
        "_cx", F.col("_cx") + F.col("_o.i")).withColumn("_cy", F.col("_cy") + F.col("_o.j")).drop("_o")


def nearest_join(points: DataFrame, features: DataFrame, *, id_col: str, feature_id: str, by: str | None = None,
                 by_values: list | None = None, max_distance: float | None = None, x: str = "x", y: str = "y",
                 fx: str = "fx", fy: str = "fy", exact: Column | None = None, shrink: float = 1.0) -> DataFrame:
    """Nearest feature of each point (per value of `by`): id_col, [by], feature_id, distance.

    The features' places make a tree of cells that is fine only where they are dense (`_tree`). At the level of the average
    density a point looks at the 3 x 3 cells around it: what is found there within one cell size is proven nearest, if none of
    them is split. The other points go down from the top, level by level; of a point's cells only those stay that begin
    before the nearest of them certainly ends, and only cells that are split go on. So a point meets the few places of a few leaves, however many features there are and wherever they
    crowd. Features at one place count once. `exact` replaces planar distance, with shrink * planar <= exact <= planar.
    Ties go to the smaller feature id. Points with nothing within `max_distance` give no row.
    """
    keys = [id_col] + ([by] if by else [])
    group = [by] if by else []
    feats = features.groupBy(fx, fy, *group).agg(F.min(feature_id).alias(feature_id))
    todo = points.select(F.col(id_col), F.col(x), F.col(y))
    if by:
        if by_values is None:
            raise ValueError("by_values (a short list of the group values) is needed with by")
        feats = feats.filter(F.col(by).isin(list(by_values)))
        todo = todo.withColumn(by, F.explode(F.array(*[F.lit(v) for v in by_values])))
    x0, y0, x1, y1, n = _extent(feats, fx, fy)
    if not n:
        return todo.select(*keys).withColumn(feature_id, F.lit(None).cast(features.schema[feature_id].dataType)).withColumn(
            "distance", F.lit(None).cast("double")).filter(F.lit(False))
    width = max(x1 - x0, y1 - y0, 1e-6) * (1 + 1e-9)
    start, levels, placed = _tree(feats, group, fx, fy, n // (len(by_values) if by else 1), x0, y0, width)
    d = exact if exact is not None else G.distance(x, y, fx, fy)

    def best_of(met: DataFrame, limit: float | None) -> DataFrame:
        met = met.withColumn("distance", d)
        if limit is not None:
            met = met.filter(F.col("distance") <= F.lit(float(limit)))
        return met.groupBy(*keys).agg(F.min(F.struct("distance", feature_id)).alias("_b")).select(
            *keys, F.col(f"_b.{feature_id}").alias(feature_id), F.col("_b.distance").alias("distance"))

    size = width / STEP**start
    sure = size * shrink * (1 - 1e-9) if max_distance is None else min(size * shrink * (1 - 1e-9), max_distance)
    here = todo.withColumn("_cx", F.floor((F.col(x) - F.lit(x0)) / F.lit(size))).withColumn("_cy", F.floor((F.col(y) - F.lit(y0)) / F.lit(size)))
    if len(levels) > start:
        crowded = _around(levels[start - 1].filter("not _leaf").drop("_leaf")).distinct().hint("merge")
        here = here.join(crowded, ["_cx", "_cy", *group], "left_anti")
    near = cut_lineage(best_of(here.join(_around(placed.filter(F.col("_level") == start)).hint("merge"), ["_cx", "_cy", *group]), sure))
    if max_distance is not None and sure == max_distance and len(levels) == start:
        return near
    todo = cut_lineage(todo.join(near.select(*keys), keys, "left_anti"))
    if todo.isEmpty():
        return near

    def reach(cx: str, cy: str, level: str) -> tuple[str, str]:
        """Least and greatest distance from a point to anything in a cell."""
        w, tiny = f"({width!r}D / pow({STEP}, {level}))", 1e-9 * width
        gap_x, gap_y = (f"greatest({o!r}D + {c} * {w} - {v}, {v} - {o!r}D - ({c} + 1) * {w}, 0D)" for c, v, o in ((cx, x, x0), (cy, y, y0)))
        far_x, far_y = (f"greatest(abs({v} - {o!r}D - {c} * {w}), abs({v} - {o!r}D - ({c} + 1) * {w}))" for c, v, o in ((cx, x, x0), (cy, y, y0)))
        return f"(sqrt({gap_x} * {gap_x} + {gap_y} * {gap_y}) * {shrink!r}D - {tiny!r}D)", f"(sqrt({far_x} * {far_x} + {far_y} * {far_y}) + {tiny!r}D)"

    # the top level is at most STEP x STEP cells a group, for by_values groups: a row per group, pruned inside the points' rows
    top = levels[0].withColumn("_top", F.lit(1)).groupBy("_top", *group).agg(F.collect_list(F.struct("_cx", "_cy", "_leaf")).alias("_cells"))
    begins, ends = reach("_c._cx", "_c._cy", "1")
    first = todo.withColumn("_top", F.lit(1)).join(F.broadcast(top), ["_top", *group]).withColumn("_end", F.array_min(F.expr(f"transform(_cells, _c -> {ends})")))
    first = first.select(*todo.columns, F.expr(f"inline(filter(_cells, _c -> {begins} <= {'_end' if max_distance is None else f'least(_end, {float(max_distance)!r}D)'}))"), "_end")
    cand = cut_lineage(first.withColumn("_level", F.lit(1)))
    for level, cells in enumerate(levels[1:], 2):
        finer = cells.groupBy(*group, F.floor(F.col("_cx") / STEP).alias("_px"), F.floor(F.col("_cy") / STEP).alias("_py")).agg(F.collect_list(F.struct("_cx", "_cy", "_leaf")).alias("_cells"))  # at most STEP x STEP
        split = cand.filter("not _leaf").drop("_leaf", "_level").withColumnsRenamed({"_cx": "_px", "_cy": "_py"})
        begins, ends = reach("_c._cx", "_c._cy", str(level))
        down = split.join(finer, ["_px", "_py", *group]).withColumn("_end", F.least("_end", F.array_min(F.expr(f"transform(_cells, _c -> {ends})"))))
        down = down.select(*todo.columns, F.expr(f"inline(filter(_cells, _c -> {begins} <= {'_end' if max_distance is None else f'least(_end, {float(max_distance)!r}D)'}))"), "_end").withColumn("_level", F.lit(level))
        both = cand.filter("_leaf").unionByName(down)
        # the group is one point's own cells, few after each round of pruning
        both = both.withColumn("_end", F.min("_end").over(Window.partitionBy(*keys)))
        begins, _ = reach("_cx", "_cy", "_level")
        # a chain of such joins would drown the optimizer in inferred constraints, so each level is written
        cand = cut_lineage(both.filter(f"{begins} <= _end"))
    return near.unionByName(best_of(cand.drop("_leaf", "_end").join(placed, ["_level", "_cx", "_cy", *group]), max_distance))


def snap_to_nodes(points: DataFrame, nodes: DataFrame, *, id_col: str, lon: str = "lon", lat: str = "lat",
                  node_id: str = "node_id", node_lon: str = "node_lon", node_lat: str = "node_lat") -> DataFrame:
    """Nearest network node of each point by great circle: id_col, node_id, distance."""
    top = points.agg(F.max(F.abs(F.col(lat)))).first()[0] or 0.0
    top = max(top, nodes.agg(F.max(F.abs(F.col(node_lat)))).first()[0] or 0.0)
    p = points.select(id_col, G.mercator_x(lon).alias("x"), G.mercator_y(lat).alias("y"))
    n = nodes.select(node_id, G.mercator_x(node_lon).alias("fx"), G.mercator_y(node_lat).alias("fy"))
    exact = G.haversine(G.lon_of_sql("x"), G.lat_of_sql("y"), G.lon_of_sql("fx"), G.lat_of_sql("fy"))
    return nearest_join(p, n, id_col=id_col, feature_id=node_id, exact=exact,
                        shrink=math.cos(math.radians(top)) * 0.99)


# ---- lattices and discs --------------------------------------------------------------------------

def target_lattice(areas: DataFrame, step: float = LATTICE_STEP_M, *, key: str = "neighborhood_name",
                   rings: str = "rings", keep: list[str] = (), numbered: bool = True,
                   step_col: str | None = None) -> DataFrame:
    """Points of a square lattice strictly inside each area, from the lower-left corner of its box, in metres.

    Columns are exploded first and spread, then rows, so that one huge area does not become one task. Ids run
    per area, column by column.
    """
    size = F.col(step_col) if step_col else F.lit(float(step))
    extra = [*keep, *([step_col] if step_col else [])]
    base = areas.select(key, *extra, G.rings_to_mercator(rings).alias("_m")).withColumn("_b", G.bounds("_m"))
    cols = base.withColumn("ix", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil((F.col("_b.xmax") - F.col("_b.xmin")) / size))))
    cols = cols.repartition(F.col(key), F.col("ix"))
    pts = (
        cols.withColumn("iy", F.explode(F.sequence(
            F.lit(0).cast("long"), F.ceil((F.col("_b.ymax") - F.col("_b.ymin")) / size))))
        .withColumn("x", F.col("_b.xmin") + F.col("ix") * size)
        .withColumn("y", F.col("_b.ymin") + F.col("iy") * size)
        .filter(G.contains_point("_m", "x", "y"))
        .drop("_m", "_b")
    )
    if numbered:
        part = [key, *([step_col] if step_col else [])]
        pts = number_rows(pts, part, [F.col("iy")], F.col("ix"), "target_id")
    return pts.withColumn("lon", G.lon_of("x")).withColumn("lat", G.lat_of("y"))


def disc_offsets(radius: float = WALK_RADIUS_M, cell: float = GRID_CELL_M, factor: float | None = 1.0) -> list:
    """Integer (i, j) of the cells in the square of side 2 x radius; with `factor`, only those in its disc."""
    m = int(math.floor(radius / cell + 1e-9))
    limit = None if factor is None else (radius * factor / cell) ** 2 + 1e-9
    return [(i, j) for i in range(-m, m + 1) for j in range(-m, m + 1)
            if limit is None or i * i + j * j <= limit]


def disc_cells(targets: DataFrame, radius: float = WALK_RADIUS_M, cell: float = GRID_CELL_M, *,
               factor: float | None = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """Cells around each target (itself included): i, j, dx, dy, euclidean_distance, network_distance, cell_x, cell_y.

    factor=None keeps the whole square, 1.25 is the looser filter, 1.0 the walking disc. The membership test is on
    integers, so cells exactly at the radius are in. network_distance is the Euclidean stand-in.
    """
    c = f"{float(cell)!r}D"
    d = f"sqrt(CAST(_o.i * _o.i + _o.j * _o.j AS double)) * {c}"
    return targets.withColumn("_o", F.explode(_offset_array(disc_offsets(radius, cell, factor), "int"))).selectExpr(
        *targets.columns, "_o.i", "_o.j", f"_o.i * {c} AS dx", f"_o.j * {c} AS dy", f"{d} AS euclidean_distance",
        f"{d} AS network_distance", f"{x} + _o.i * {c} AS cell_x", f"{y} + _o.j * {c} AS cell_y")


def lattice_impact(areas: DataFrame, steps: list[float], *, key: str = "neighborhood_name",
                   rings: str = "rings") -> DataFrame:
    """Lattice size per area and in total at several steps, with the growth against the widest step."""
    stepped = areas.select(key, rings).withColumn("step_m", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    counts = target_lattice(stepped, key=key, rings=rings, numbered=False, step_col="step_m").groupBy(
        key, "step_m").agg(F.count(F.lit(1)).alias("points"))
    names = {s: f"points_{int(s)}" for s in steps}
    wide = counts.rollup(key).agg(*[
        F.coalesce(F.sum(F.when(F.col("step_m") == s, F.col("points"))), F.lit(0)).alias(n) for s, n in names.items()])
    base = names[max(steps)]
    return wide.select(
        F.coalesce(F.col(key), F.lit("TOTAL")).alias(key), *names.values(),
        *[F.try_divide(F.col(n).cast("double"), F.col(base).cast("double")).alias(f"growth_{int(s)}")
          for s, n in names.items() if n != base])


def select_features(features: DataFrame, polygons: DataFrame, tags: dict[str, list[str]], cell: float, *,
                    x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """Features carrying one of the tags and lying in a polygon; the tag filter reaches the scan."""
    wanted = None
    for col, values in tags.items():
        hit = F.col(col).isNotNull() if not values else F.col(col).isin(values)
        wanted = hit if wanted is None else (wanted | hit)
    return within_join(features.filter(wanted), polygons, cell, x=x, y=y, rings=rings, how="inner")


def check_bounds(df: DataFrame, expected: tuple[float, float, float, float], x: str = "lon", y: str = "lat") -> DataFrame:
    """Total bounds beside an expected box, and whether they stay inside."""
    x0, y0, x1, y1 = expected
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")
                  ).withColumn("inside", (F.col("xmin") >= x0) & (F.col("ymin") >= y0)
                               & (F.col("xmax") <= x1) & (F.col("ymax") <= y1))
