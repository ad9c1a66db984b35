"""Shapes whose edges are too many for one row: edges as rows, met in buckets that follow their density.

Expressions in `functions.geometry` look at all pairs of edges of a row, which is right for shapes of some dozens of
edges. Here a shape's edges are rows. Edges that may meet share a bucket: a bucket of more than `BUCKET` edges is split in
4 x 4, into the parts that an edge really touches, until it holds few or is `DEPTH` levels down (edges that run through
one point stay together at any depth; only those are compared in a crowded bucket). So a ring of any length, dense
anywhere, is compared in bounded pieces on all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach.functions import geometry as G
from footreach.session import cut_lineage

BUCKET, DEPTH, STEP = 64, 14, 4
ROW_EDGES = 64  # shapes up to so many edges are compared inside their row


def edges_of(shapes: DataFrame, rings: str, *keep: str) -> DataFrame:
    """keep..., ring, edge, ax, ay, bx, by: one row per edge, numbered along its ring; edges without length are left out."""
    each = shapes.select(*keep, F.posexplode(rings).alias("ring", "_r")).select(*keep, "ring", F.posexplode(F.expr(G._ring_segments("_r"))).alias("edge", "_e"))
    return each.select(*keep, "ring", "edge", *[F.col(f"_e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]).filter("ax <> bx OR ay <> by")


def _touches_cell(x: str, y: str, w: str) -> str:
    """Whether the edge (ax, ay)-(bx, by) may touch the square [x, x + w] x [y, y + w]; errs towards yes."""
    tiny = f"({w} * 1e-9D)"
    box = f"least(ax, bx) <= {x} + {w} + {tiny} AND greatest(ax, bx) >= {x} - {tiny} AND least(ay, by) <= {y} + {w} + {tiny} AND greatest(ay, by) >= {y} - {tiny}"
    side = lambda u, v: f"((bx - ax) * ({y} + {v} - ay) - (by - ay) * ({x} + {u} - ax))"
    corners = [side("0D", "0D"), side("0D", w), side(w, "0D"), side(w, w)]
    slack = f"((abs(bx - ax) + abs(by - ay)) * {tiny})"
    return f"({box} AND least({', '.join(corners)}) <= {slack} AND greatest({', '.join(corners)}) >= -{slack})"


def bucketed(edges: DataFrame, group: list[str], side: str | None = None) -> DataFrame:
    """Edges with _bucket, each row in the buckets of its group that it touches: rows that may meet share one.

    With `side`, only edges of different sides need to share a bucket, and buckets of one side only are dropped.
    """
    box = edges.groupBy(*group).agg(F.min(F.least("ax", "bx")).alias("_x"), F.min(F.least("ay", "by")).alias("_y"),
                                    F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("_w"))
    rows = cut_lineage(edges.join(box, group).withColumn("_bucket", F.lit("")))
    out = None
    for level in range(DEPTH + 1):
        sizes = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *([F.count_distinct(side).alias("_sides")] if side else []))
        sizes = sizes.filter("_sides > 1") if side else sizes.filter("_n > 1")
        sized = rows.join(sizes.select(*group, "_bucket", "_n"), [*group, "_bucket"])
        fine = F.lit(True) if level == DEPTH else F.col("_n") <= BUCKET
        sized = cut_lineage(sized.withColumn("_fine", fine | (F.col("_w") <= 0)).drop("_n"))
        done = sized.filter("_fine").select(*edges.columns, "_bucket")
        out = done if out is None else out.unionByName(done)
        rows = sized.filter("not _fine").drop("_fine")
        if level == DEPTH or rows.isEmpty():
            return out
        w = f"(_w / {STEP})"
        parts = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1))))
        parts = parts.withColumn("_x", F.expr(f"_x + _i * {w}")).withColumn("_y", F.expr(f"_y + _j * {w}")).withColumn("_w", F.expr(w))
        rows = cut_lineage(parts.filter(_touches_cell("_x", "_y", "_w")).withColumn("_bucket", F.concat("_bucket", F.lit("/"), (F.col("_i") * STEP + F.col("_j")).cast("string"))).drop("_i", "_j"))
    return out


def _struct(prefix: str) -> str:
    return f"named_struct('a', named_struct('x', {prefix}.ax, 'y', {prefix}.ay), 'b', named_struct('x', {prefix}.bx, 'y', {prefix}.by))"


def _pairs(left: DataFrame, right: DataFrame, group: list[str], more: str = "true") -> DataFrame:
    """Edges of two bucketed tables in one bucket of one group, as structs _s and _t."""
    same = " AND ".join([f"l.{c} <=> r.{c}" for c in [*group, "_bucket"]])
    return left.alias("l").join(right.alias("r"), F.expr(f"{same} AND {more}")).select(*[f"l.{c}" for c in group], F.expr(_struct("l")).alias("_s"), F.expr(_struct("r")).alias("_t"))


def crossed_rings(edges: DataFrame, group: list[str]) -> DataFrame:
    """The groups (of edges of one ring) in which two edges cross properly."""
    b = bucketed(edges, group)
    return _pairs(b, b, group, "l.edge < r.edge").filter(G._cross("_s", "_t")).select(*group).distinct()


def with_validity(shapes: DataFrame, rings: str = "rings", name: str = "is_valid") -> DataFrame:
    """Adds whether a shape is valid: rings closed, of four points at least, finite, not flat, and without a crossing of their own edges."""
    long = f"exists({rings}, _q -> size(_q) > {ROW_EDGES + 1})"
    plain = shapes.withColumn("_long", F.coalesce(F.expr(long), F.lit(False)))
    short = plain.filter("not _long").withColumn(name, G.valid_geometry(rings)).drop("_long")
    big = cut_lineage(plain.filter("_long").drop("_long").withColumn("_shape", F.monotonically_increasing_id()))
    if big.isEmpty():
        return short
    crossed = crossed_rings(edges_of(big, rings, "_shape"), ["_shape", "ring"]).select("_shape").distinct().withColumn("_crossed", F.lit(True))
    sound = F.coalesce(G.sound_rings(rings), F.lit(False))
    return short.unionByName(big.join(crossed, "_shape", "left").withColumn(name, sound & F.col("_crossed").isNull()).select(*shapes.columns, name))


# ---- two shapes ----------------------------------------------------------------------------------

def _vertices_outside(pairs: DataFrame, p: str, q: str) -> DataFrame:
    """_pair of the pairs with a vertex of p that is neither in q nor on its edge, slab by slab of the height.

    A vertex is in q when more of its shells than holes hold it; a shape's rings count as one when they do not overlap.
    """
    slabs = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(F.flatten(q)).cast("double")))).cast("int")
    sized = pairs.select("_pair", F.col(p).alias("_p"), F.col(q).alias("_q"), G.bounds(q).alias("_b"), slabs.alias("_slabs")).withColumn("_h", F.expr("greatest((_b.ymax - _b.ymin) / _slabs, 1e-300D)"))
    at = lambda v: f"CAST(least(greatest(floor(({v} - _y) / _h), 0), _slabs - 1) AS int)"
    points = sized.select("_pair", "_slabs", "_h", F.col("_b.ymin").alias("_y"), F.explode(F.array_distinct(F.flatten("_p"))).alias("_v")).withColumn("slab", F.expr(at("_v.y")))
    walls = edges_of(sized.withColumn("_y", F.col("_b.ymin")), "_q", "_pair", "_slabs", "_h", "_y").withColumn(
        "slab", F.expr(f"explode(sequence({at('least(ay, by)')}, {at('greatest(ay, by)')}))"))
    cross = "((w.ay > v._v.y) <> (w.by > v._v.y)) AND ((w.by > w.ay) = ((v._v.x - w.ax) * (w.by - w.ay) < (w.bx - w.ax) * (v._v.y - w.ay)))"
    touch = ("((w.bx - w.ax) * (v._v.y - w.ay) - (w.by - w.ay) * (v._v.x - w.ax)) = 0 AND v._v.x BETWEEN least(w.ax, w.bx) AND greatest(w.ax, w.bx)"
             " AND v._v.y BETWEEN least(w.ay, w.by) AND greatest(w.ay, w.by)")
    met = points.alias("v").join(walls.alias("w"), F.expr("v._pair = w._pair AND v.slab = w.slab"), "left")
    found = met.groupBy("v._pair", "v._v").agg(F.count_if(F.expr(cross)).alias("_n"), F.count_if(F.expr(touch)).alias("_on"))
    return found.filter("_n % 2 = 0 AND _on = 0").select("_pair").distinct()


def related(pairs: DataFrame, p: str, q: str, relation: str) -> DataFrame:
    """The pairs of shapes of which p `intersects` q or lies `within` it. Small shapes are compared inside the row, large ones by their edges."""
    small = F.size(F.flatten(p)).cast("bigint") * F.size(F.flatten(q)) <= ROW_EDGES * ROW_EDGES
    test = G.polygon_intersects if relation == "intersects" else G.polygon_within
    near = pairs.filter(small & test(p, q))
    big = cut_lineage(pairs.filter(~small).withColumn("_pair", F.monotonically_increasing_id()))
    if big.isEmpty():
        return near
    both = edges_of(big, p, "_pair").withColumn("_side", F.lit(0)).unionByName(edges_of(big, q, "_pair").withColumn("_side", F.lit(1)))
    b = bucketed(both, ["_pair"], "_side")
    met = _pairs(b.filter("_side = 0"), b.filter("_side = 1"), ["_pair"])
    if relation == "intersects":
        yes = met.filter(G._touch("_s", "_t")).select("_pair").distinct().withColumn("_met", F.lit(True))
        inside = G.covers_point(q, f"{p}[0][0].x", f"{p}[0][0].y") | G.covers_point(p, f"{q}[0][0].x", f"{q}[0][0].y")
        far = big.join(yes, "_pair", "left").filter(F.col("_met").isNotNull() | inside)
    else:
        no = met.filter(G._cross("_s", "_t")).select("_pair").unionByName(_vertices_outside(big, p, q)).distinct()
        far = big.join(no, "_pair", "left_anti")
    return near.unionByName(far.select(*pairs.columns))


# ---- union of parts ------------------------------------------------------------------------------

def _oriented_parts(shapes: DataFrame, by: list[str], rings: str) -> DataFrame:
    """by..., _part, _rings: each shell with its holes, shells counter-clockwise, holes clockwise; empty shapes are left out."""
    parts = shapes.filter(F.size(rings) > 0).select(*by, F.explode(G.parts(rings)).alias("_rings"))
    turned = F.expr(f"transform(_rings, (_q, _i) -> CASE WHEN (_i = 0) = ({G._cross_sum('_q')} < 0D) THEN reverse(_q) ELSE _q END)")
    return cut_lineage(parts.withColumn("_rings", turned).withColumn("_part", F.monotonically_increasing_id()))


def union_edges(shapes: DataFrame, by: list[str], rings: str = "rings", snap: float = 1e-9) -> DataFrame:
    """by..., ax, ay, bx, by: the directed outline of the union of all parts of a group, its inside on the left.

    Edges are cut where edges of other parts meet them (to a grid of `snap`). A piece stays unless another part holds its
    middle, or another part's piece runs along it the other way (both sides are inside); of equal pieces one stays.
    """
    parts = _oriented_parts(shapes, by, rings)
    edges = edges_of(parts, "_rings", *by, "_part")
    round_ = lambda c: F.round(c / F.lit(snap)) * F.lit(snap)
    edges = edges.select(*by, "_part", "ring", "edge", *[round_(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")]).filter("ax <> bx OR ay <> by")
    edges = cut_lineage(edges.withColumn("_id", F.monotonically_increasing_id()))
    met = bucketed(edges, by, "_part")
    same = " AND ".join([f"l.{c} <=> r.{c}" for c in [*by, "_bucket"]])
    other = met.alias("l").join(met.alias("r"), F.expr(f"{same} AND l._part <> r._part"))
    # places along l where r crosses or touches it: the crossing of the lines, or r's ends if these lie on l
    d = "((l.bx - l.ax) * (r.by - r.ay) - (l.by - l.ay) * (r.bx - r.ax))"
    u = f"(((r.ax - l.ax) * (r.by - r.ay) - (r.ay - l.ay) * (r.bx - r.ax)) / {d})"
    v = f"(((r.ax - l.ax) * (l.by - l.ay) - (r.ay - l.ay) * (l.bx - l.ax)) / {d})"
    long2 = "((l.bx - l.ax) * (l.bx - l.ax) + (l.by - l.ay) * (l.by - l.ay))"

    def on(end: str) -> str:
        along = f"((r.{end}x - l.ax) * (l.bx - l.ax) + (r.{end}y - l.ay) * (l.by - l.ay)) / {long2}"
        off = f"abs((l.bx - l.ax) * (r.{end}y - l.ay) - (l.by - l.ay) * (r.{end}x - l.ax)) / sqrt({long2})"
        return f"CASE WHEN {off} <= {2 * snap!r}D AND {along} > 0 AND {along} < 1 THEN named_struct('t', {along}, 'x', r.{end}x, 'y', r.{end}y) END"

    eps = 1e-12
    cross = (f"CASE WHEN {d} <> 0 AND {u} > 0 AND {u} < 1 AND {v} >= -{eps}D AND {v} <= 1 + {eps}D "
             f"THEN named_struct('t', {u}, 'x', CASE WHEN l._id < r._id THEN l.ax + {u} * (l.bx - l.ax) ELSE r.ax + {v} * (r.bx - r.ax) END, "
             f"'y', CASE WHEN l._id < r._id THEN l.ay + {u} * (l.by - l.ay) ELSE r.ay + {v} * (r.by - r.ay) END) END")  # the same point for both edges
    cuts = other.select(F.col("l._id").alias("_id"), F.explode(F.array_compact(F.expr(f"array({cross}, {on('a')}, {on('b')})"))).alias("_c")).select(
        "_id", F.struct(F.col("_c.t").alias("t"), round_(F.col("_c.x")).alias("x"), round_(F.col("_c.y")).alias("y")).alias("_c"))
    cuts = cuts.groupBy("_id").agg(F.array_sort(F.collect_set("_c")).alias("_cuts"))
    at = F.concat(F.array(F.struct("ax", "ay")), F.coalesce(F.transform("_cuts", lambda c: F.struct(c["x"].alias("ax"), c["y"].alias("ay"))), F.array()), F.array(F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"))))
    pieces = edges.join(cuts, "_id", "left").withColumn("_at", at).select(*by, "_part", F.explode(F.expr("transform(sequence(1, size(_at) - 1), _i -> named_struct('a', _at[_i - 1], 'b', _at[_i]))")).alias("_e"))
    pieces = pieces.select(*by, "_part", F.col("_e.a.ax").alias("ax"), F.col("_e.a.ay").alias("ay"), F.col("_e.b.ax").alias("bx"), F.col("_e.b.ay").alias("by")).filter("ax <> bx OR ay <> by")
    # pieces along each other: an opposite one takes both away, equal ones are one
    flip = F.expr("ax > bx OR (ax = bx AND ay > by)")
    line = [F.when(flip, F.col(q)).otherwise(F.col(p)).alias(f"_{p}") for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    lines = pieces.select(*by, "_part", *line, flip.alias("_flip")).groupBy(*by, "_ax", "_ay", "_bx", "_by").agg(
        F.count_if("_flip").alias("_back"), F.count_if(~F.col("_flip")).alias("_forth"), F.collect_set("_part").alias("_own"))
    lines = cut_lineage(lines.filter("_back = 0 OR _forth = 0").withColumn("_line", F.monotonically_increasing_id()))
    held = _held(lines, parts, by)
    rest = lines.join(held, "_line", "left_anti")
    turn = F.col("_back") > 0
    return rest.select(*by, *[F.when(turn, F.col(q)).otherwise(F.col(p)).alias(n) for n, p, q in (("ax", "_ax", "_bx"), ("ay", "_ay", "_by"), ("bx", "_bx", "_ax"), ("by", "_by", "_ay"))])


def _held(lines: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """_line of the pieces whose middle lies in a part that they don't belong to: parts and middles meet in cells of the parts' median size."""
    boxed = parts.withColumn("_b", G.bounds("_rings"))
    size = boxed.agg(F.percentile_approx(F.greatest(F.expr("_b.xmax - _b.xmin"), F.expr("_b.ymax - _b.ymin")), 0.5).alias("s")).first()["s"] or 1.0  # one number
    size = max(float(size), 1e-12)
    cell = lambda c: F.floor(F.expr(c) / F.lit(size))
    middles = lines.select(*by, "_line", "_own", F.expr("(_ax + _bx) / 2").alias("_mx"), F.expr("(_ay + _by) / 2").alias("_my")).withColumn("_cx", cell("_mx")).withColumn("_cy", cell("_my"))
    spread = boxed.withColumn("_cx", F.explode(F.sequence(cell("_b.xmin"), cell("_b.xmax")))).withColumn("_cy", F.explode(F.sequence(cell("_b.ymin"), cell("_b.ymax"))))
    same = " AND ".join([f"m.{c} <=> p.{c}" for c in [*by, "_cx", "_cy"]])
    near = middles.alias("m").join(spread.alias("p"), F.expr(f"{same} AND m._mx BETWEEN p._b.xmin AND p._b.xmax AND m._my BETWEEN p._b.ymin AND p._b.ymax AND NOT array_contains(m._own, p._part)"))
    inside = near.select("m._line", "m._mx", "m._my", "p._rings").filter(G.contains_point("_rings", "_mx", "_my"))
    return inside.select("_line").distinct()


def union_area(shapes: DataFrame, by: list[str], rings: str = "rings", snap: float = 1e-9) -> DataFrame:
    """by..., area: area of the union of a group's parts, from its outline; no group is gathered."""
    e = union_edges(shapes, by, rings, snap)
    first = Window.partitionBy(*by)
    e = e.withColumn("_ox", F.min("ax").over(first)).withColumn("_oy", F.min("ay").over(first)) if by else e.withColumn("_ox", F.lit(0.0)).withColumn("_oy", F.lit(0.0))
    return e.groupBy(*by).agg((F.sum(F.expr("(ax - _ox) * (by - _oy) - (bx - _ox) * (ay - _oy)")) / 2).alias("area"))


def _stitch(edges: list[tuple[float, float, float, float]]) -> list[list[dict]]:
    """Closed rings from directed edges with the inside on the left; where several leave a point, the sharpest left turn keeps rings apart."""
    import math

    leaving: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for ax, ay, bx, by in sorted(edges):
        leaving.setdefault((ax, ay), []).append((bx, by))
    rings = []
    while leaving:
        start = min(leaving)
        ring, at, came = [start], start, None
        while True:
            ways = leaving[at]
            if came is None or len(ways) == 1:
                to = ways[0]
            else:
                back = math.atan2(came[1] - at[1], came[0] - at[0])
                to = min(ways, key=lambda w: (back - math.atan2(w[1] - at[1], w[0] - at[0])) % (2 * math.pi) or 2 * math.pi)
            ways.remove(to)
            if not ways:
                del leaving[at]
            came, at = at, to
            ring.append(at)
            if at == start:
                break
            if at not in leaving:
                ring = []
                break
        if len(ring) >= 4:
            rings.append([{"x": x, "y": y} for x, y in _straight(ring)])
    return rings


def _straight(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A closed ring without the points on its straight runs."""
    open_ring = ring[:-1]
    kept = []
    for i, (x, y) in enumerate(open_ring):
        (px, py), (qx, qy) = open_ring[i - 1], open_ring[(i + 1) % len(open_ring)]
        if abs((x - px) * (qy - y) - (y - py) * (qx - x)) > 1e-12 * (abs(x - px) + abs(y - py)) * (abs(qx - x) + abs(qy - y)):
            kept.append((x, y))
    return kept + kept[:1]


def union_shapes(shapes: DataFrame, by: list[str], rings: str = "rings", snap: float = 1e-9) -> DataFrame:
    """by..., rings: one shape per group, the union of its parts without inner edges. A group's outline meets in one task; it is one row of the result."""
    import pandas as pd

    e = union_edges(shapes, by, rings, snap)
    fields = ", ".join(f"`{c}` {shapes.schema[c].dataType.simpleString()}" for c in by)

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _stitch(list(pdf[["ax", "ay", "bx", "by"]].itertuples(index=False, name=None)))
        out = pdf[by].iloc[:1].copy()
        out["rings"] = [found]
        return out

    return e.groupBy(*by).applyInPandas(outline, f"{fields}, rings {G.RINGS_TYPE}")
