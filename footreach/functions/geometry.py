"""Planar geometry as SQL expressions over doubles.

A ring is ``array<struct<x:double,y:double>>``, closed; a polygon is an array of rings: the shells of its parts and
their holes. A hole is a ring that lies in another one and runs against it; parts may overlap and run in any order.
Nothing here needs a UDF or a UDT.

The shape functions take column names or SQL text and return a Column made by one `expr`: long expressions built
call by call from Python cost seconds per query. Names ending in `_sql` return the text. Lambda variables start with an underscore, which no shape column should.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from footreach.constants import EARTH_RADIUS_M, MERCATOR_RADIUS_M, METERS_PER_DEGREE

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


def _col(c) -> Column:
    return F.expr(c) if isinstance(c, str) else c


# ---- coordinates ---------------------------------------------------------------------------------

def mercator_x_sql(lon: str) -> str:
    return f"(radians({lon}) * {MERCATOR_RADIUS_M}D)"


def mercator_y_sql(lat: str) -> str:
    return f"(ln(tan({math.pi / 4}D + radians({lat}) / 2D)) * {MERCATOR_RADIUS_M}D)"


def mercator_x(lon: str) -> Column:
    return F.expr(mercator_x_sql(lon))


def mercator_y(lat: str) -> Column:
    return F.expr(mercator_y_sql(lat))


def lon_of_sql(mx: str) -> str:
    return f"degrees({mx} / {MERCATOR_RADIUS_M}D)"


def lat_of_sql(my: str) -> str:
    return f"degrees(2D * atan(exp({my} / {MERCATOR_RADIUS_M}D)) - {math.pi / 2}D)"


def lon_of(mx: str) -> Column:
    return F.expr(lon_of_sql(mx))


def lat_of(my: str) -> Column:
    return F.expr(lat_of_sql(my))


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle metres."""
    return F.expr(
        f"{2.0 * radius}D * asin(least(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2D), 2D) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2D), 2D)), 1D))")


def distance_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"


def distance(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.expr(distance_sql(x1, y1, x2, y2))


# ---- building and rewriting shapes ---------------------------------------------------------------

def box(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Closed rectangle, counter-clockwise."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.expr("array(array(" + ", ".join(
        f"named_struct('x', CAST({x} AS double), 'y', CAST({y} AS double))" for x, y in corners) + "))")


def rings_to_mercator_sql(rings: str) -> str:
    return (f"transform({rings}, _r -> transform(_r, _v -> named_struct('x', {mercator_x_sql('_v.x')}, 'y', {mercator_y_sql('_v.y')})))")


def rings_to_mercator(rings: str) -> Column:
    return F.expr(rings_to_mercator_sql(rings))


def _ring_segments(r: str) -> str:
    n = f"greatest(size({r}) - 1, 0)"
    return f"zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), (_a, _b) -> named_struct('a', _a, 'b', _b))"


def segments_sql(rings: str) -> str:
    return f"flatten(transform({rings}, _r -> {_ring_segments('_r')}))"


def bounds(rings: str) -> Column:
    """struct(xmin, ymin, xmax, ymax)."""
    xs, ys = (f"transform(flatten({rings}), _v -> _v.{c})" for c in "xy")
    return F.expr(f"named_struct('xmin', array_min({xs}), 'ymin', array_min({ys}), 'xmax', array_max({xs}), 'ymax', array_max({ys}))")


def is_rectangle(rings: str) -> Column:
    """One closed ring of four sides along the axes, none of length 0: such a shape is its box."""
    r = [f"{rings}[0][{i}]" for i in range(5)]
    turns = (f"({r[0]}.{c} = {r[1]}.{c} AND {r[1]}.{d} = {r[2]}.{d} AND {r[2]}.{c} = {r[3]}.{c} AND {r[3]}.{d} = {r[0]}.{d})" for c, d in ("xy", "yx"))
    shape = f"({' OR '.join(turns)}) AND {r[0]}.x = {r[4]}.x AND {r[0]}.y = {r[4]}.y AND {r[0]}.x <> {r[2]}.x AND {r[0]}.y <> {r[2]}.y"
    return F.expr(f"CASE WHEN size({rings}) = 1 THEN size({rings}[0]) = 5 AND coalesce({shape}, false) ELSE false END")


def box_distance(box: str, x: str, y: str) -> Column:
    """Distance to a box, 0 in it."""
    dx, dy = (f"greatest({box}.{c}min - {v}, {v} - {box}.{c}max, 0D)" for c, v in (("x", x), ("y", y)))
    return F.expr(f"sqrt({dx} * {dx} + {dy} * {dy})")


def _hole(h: str, rings: str) -> str:
    """Whether more of the rings around a ring run against it than with it: a hole. All others are shells of parts."""
    around = covers_point_sql("array(_w)", "_v.x", "_v.y")
    return (f"aggregate({rings}, 0D, (_n, _w) -> _n + CASE WHEN _w <> {h} AND forall({h}, _v -> {around})"
            f" THEN -signum({_cross_sum('_w')}) * signum({_cross_sum(h)}) ELSE 0D END) > 0D")


def oriented_sql(rings: str) -> str:
    """The same rings with shells counter-clockwise and holes clockwise, whatever their order was."""
    return (f"(CASE WHEN size({rings}) <= 1 THEN {rings} ELSE transform({rings}, _q -> CASE WHEN ({_cross_sum('_q')} < 0D) = ({_hole('_q', rings)})"
            f" THEN _q ELSE reverse(_q) END) END)")


def parts(rings: str) -> Column:
    """array of polygons: each shell with the holes that lie in it."""
    o = "_shape"
    own = f"filter({o}, _k -> size({o}) > 1 AND {_cross_sum('_k')} < 0D AND forall(_k, _v -> {covers_point_sql('array(_z)', '_v.x', '_v.y')}))"
    return F.expr(f"transform(array({oriented_sql(rings)}), {o} -> transform(filter({o}, _z -> {_cross_sum('_z')} >= 0D OR size({o}) = 1), _z -> concat(array(_z), {own})))[0]")


def dissolve(rings: str, strict: bool = False) -> Column:
    """One shape from several parts. All rings are kept; with `strict`, disjoint parts give an empty shape."""
    if not strict:
        return F.expr(rings)
    near = (f"exists({_ring_segments('_p')}, _s -> exists({_ring_segments('_o')}, _t -> {_touch('_s', '_t')}))"
            f" OR {covers_point_sql('array(_o)', '_p[0].x', '_p[0].y')} OR {covers_point_sql('array(_p)', '_o[0].x', '_o[0].y')}")
    apart = f"exists({rings}, _p -> NOT exists({rings}, _o -> _p <> _o AND ({near})))"
    return F.expr(f"CASE WHEN size({rings}) > 1 AND {apart} THEN CAST(array() AS {RINGS_TYPE}) ELSE {rings} END")


# ---- measures ------------------------------------------------------------------------------------

def _cross_sum(r: str) -> str:
    return (f"aggregate({_ring_segments(r)}, 0D, (_acc, _s) -> _acc + (_s.a.x - {r}[0].x) * (_s.b.y - {r}[0].y)"
            f" - (_s.b.x - {r}[0].x) * (_s.a.y - {r}[0].y))")


def area_sql(rings: str) -> str:
    return f"(abs(aggregate({oriented_sql(rings)}, 0D, (_total, _u) -> _total + {_cross_sum('_u')})) / 2D)"


def area(rings: str) -> Column:
    """Shoelace area in the units of the coordinates: parts add, holes subtract, whatever the order of their vertices."""
    return F.expr(area_sql(rings))


def area_m2(rings: str, mode: str = "mercator") -> Column:
    """'degrees': degrees^2 x 111320^2; 'mercator': projected metres^2 (stretched by 1 / cos^2 of the latitude)."""
    if mode == "degrees":
        return F.expr(f"{area_sql(rings)} * {METERS_PER_DEGREE * METERS_PER_DEGREE}D")
    return F.expr(area_sql(rings_to_mercator_sql(rings)))


def centroid(rings: str) -> Column:
    """struct(x, y), area-weighted; the mean of the vertices when the area is zero."""
    ox, oy = f"{rings}[0][0].x", f"{rings}[0][0].y"
    w = f"((_s.a.x - {ox}) * (_s.b.y - {oy}) - (_s.b.x - {ox}) * (_s.a.y - {oy}))"
    step = (f"named_struct('w', _acc.w + {w}, 'x', _acc.x + (_s.a.x + _s.b.x - 2D * {ox}) * {w}, "
            f"'y', _acc.y + (_s.a.y + _s.b.y - 2D * {oy}) * {w})")

    def mean(c):
        return f"aggregate(flatten({rings}), 0D, (_t, _v) -> _t + _v.{c}) / size(flatten({rings}))"

    def end(c, o):
        return f"CASE WHEN _acc.w = 0 THEN {mean(c)} ELSE {o} + try_divide(_acc.{c}, _acc.w * 3D) END"
    return F.expr(f"aggregate({segments_sql(oriented_sql(rings))}, named_struct('w', 0D, 'x', 0D, 'y', 0D), (_acc, _s) -> {step}, "
                  f"_acc -> named_struct('x', {end('x', ox)}, 'y', {end('y', oy)}))")


# ---- predicates ----------------------------------------------------------------------------------

def _side(a: str, b: str, x: str, y: str) -> str:
    return f"(({b}.x - {a}.x) * ({y} - {a}.y) - ({b}.y - {a}.y) * ({x} - {a}.x))"


def on_boundary_sql(rings: str, x: str, y: str) -> str:
    return (f"exists({segments_sql(rings)}, _g -> {_side('_g.a', '_g.b', x, y)} = 0"
            f" AND {x} >= least(_g.a.x, _g.b.x) AND {x} <= greatest(_g.a.x, _g.b.x)"
            f" AND {y} >= least(_g.a.y, _g.b.y) AND {y} <= greatest(_g.a.y, _g.b.y))")


def _inside(rings: str, x: str, y: str) -> str:
    """Inside more shells than holes; a single ring needs no look at kinds, nor does a point that one ring holds."""
    around = f"filter({rings}, _c -> {_odd_crossings('array(_c)', x, y)})"
    return (f"(CASE WHEN size({rings}) = 1 THEN {_odd_crossings(rings, x, y)} ELSE aggregate(array({around}), false, (_acc, _in) -> "
            f"CASE WHEN size(_in) <= 1 THEN size(_in) = 1 ELSE 2 * size(filter(_in, _h -> {_hole('_h', '_in')})) < size(_in) END) END)")


def _odd_crossings(rings: str, x: str, y: str) -> str:
    return (f"(size(filter({segments_sql(rings)}, _g -> ((_g.a.y > {y}) <> (_g.b.y > {y})) AND ((_g.b.y > _g.a.y) = "
            f"(({x} - _g.a.x) * (_g.b.y - _g.a.y) < (_g.b.x - _g.a.x) * ({y} - _g.a.y))))) % 2 = 1)")


def contains_point_sql(rings: str, x: str, y: str) -> str:
    return f"({_inside(rings, x, y)} AND NOT {on_boundary_sql(rings, x, y)})"


def covers_point_sql(rings: str, x: str, y: str) -> str:
    if rings.startswith("array("):
        return f"({_odd_crossings(rings, x, y)} OR {on_boundary_sql(rings, x, y)})"  # one ring
    return f"({_inside(rings, x, y)} OR {on_boundary_sql(rings, x, y)})"


def contains_point(rings: str, x: str, y: str) -> Column:
    """Strictly inside: the boundary does not count."""
    return F.expr(contains_point_sql(rings, x, y))


def covers_point(rings: str, x: str, y: str) -> Column:
    return F.expr(covers_point_sql(rings, x, y))


def _signs(p: str, q: str, u: str, v: str) -> str:
    """Product of the sides of line p-q on which u and v lie."""
    return f"signum({_side(p, q, u + '.x', u + '.y')}) * signum({_side(p, q, v + '.x', v + '.y')})"


def _touch(s: str, t: str) -> str:
    """Two closed segments share a point: their boxes meet and neither lies wholly on one side of the other."""
    boxes = " AND ".join(
        f"greatest({p}.a.{c}, {p}.b.{c}) >= least({q}.a.{c}, {q}.b.{c})" for c in "xy" for p, q in ((s, t), (t, s)))
    return f"({boxes} AND {_signs(f'{s}.a', f'{s}.b', f'{t}.a', f'{t}.b')} <= 0 AND {_signs(f'{t}.a', f'{t}.b', f'{s}.a', f'{s}.b')} <= 0)"


def _cross(s: str, t: str) -> str:
    """Two segments cross properly."""
    return f"({_signs(f'{s}.a', f'{s}.b', f'{t}.a', f'{t}.b')} < 0 AND {_signs(f'{t}.a', f'{t}.b', f'{s}.a', f'{s}.b')} < 0)"


def polygon_intersects(p: str, q: str) -> Column:
    return F.expr(f"exists({segments_sql(p)}, _s -> exists({segments_sql(q)}, _t -> {_touch('_s', '_t')}))"
                  f" OR {covers_point_sql(q, p + '[0][0].x', p + '[0][0].y')} OR {covers_point_sql(p, q + '[0][0].x', q + '[0][0].y')}")


def polygon_within(p: str, q: str) -> Column:
    """p lies in q: every vertex in q (its edge allowed) and no edge crosses."""
    return F.expr(f"forall(flatten({p}), _v -> {covers_point_sql(q, '_v.x', '_v.y')})"
                  f" AND NOT exists({segments_sql(p)}, _s -> exists({segments_sql(q)}, _t -> {_cross('_s', '_t')}))")


def boundary_distance_sql(rings: str, x: str, y: str) -> str:
    dx, dy = "(_g.b.x - _g.a.x)", "(_g.b.y - _g.a.y)"
    t = (f"least(greatest(coalesce(try_divide(({x} - _g.a.x) * {dx} + ({y} - _g.a.y) * {dy}, {dx} * {dx} + {dy} * {dy}), 0D), 0D), 1D)")
    near = f"named_struct('x', _g.a.x + {t} * {dx}, 'y', _g.a.y + {t} * {dy})"
    return (f"array_min(transform(transform({segments_sql(rings)}, _g -> {near}), _n -> {distance_sql(x, y, '_n.x', '_n.y')}))")


def polygon_distance(rings: str, x: str, y: str) -> Column:
    """0 inside the polygon, else the distance to its nearest edge."""
    return F.expr(f"CASE WHEN {_odd_crossings(rings, x, y)} THEN 0D ELSE {boundary_distance_sql(rings, x, y)} END")


def polygon_dwithin(rings: str, x: str, y: str, r: float) -> Column:
    return polygon_distance(rings, x, y) <= F.lit(float(r))


def within_buffer(rings: str, x: str, y: str, meters: float) -> Column:
    """Inside the polygon grown by `meters` (as degrees, metres / 111320), edge excluded."""
    if meters < 0:
        raise ValueError("buffer distance cannot be negative")
    if meters == 0:
        return contains_point(rings, x, y)
    return polygon_distance(rings, x, y) < F.lit(meters / METERS_PER_DEGREE)


def _sound_ring() -> str:
    inf = "double('infinity')"
    finite = f"forall(_q, _v -> NOT (isnan(_v.x) OR isnan(_v.y) OR abs(_v.x) = {inf} OR abs(_v.y) = {inf}))"
    return f"size(_q) >= 4 AND _q[0] = element_at(_q, -1) AND {finite} AND {_cross_sum('_q')} <> 0"


def sound_rings(rings: str) -> Column:
    """Each ring closed, >= 4 vertices, finite, not flat."""
    return F.expr(f"coalesce(size({rings}) > 0 AND forall({rings}, _q -> {_sound_ring()}), false)")


def valid_geometry(rings: str) -> Column:
    """Sound rings, none of which an edge of its own crosses. All pairs of a ring's edges: for long rings see `operators.shapes`."""
    simple = f"NOT exists({_ring_segments('_q')}, _s -> exists({_ring_segments('_q')}, _t -> {_cross('_s', '_t')}))"
    good = f"{_sound_ring()} AND {simple}"
    return F.expr(f"coalesce(size({rings}) > 0 AND forall({rings}, _q -> {good}), false)")


# ---- text ----------------------------------------------------------------------------------------

def to_wkt(x: str, y: str) -> Column:
    return F.expr(f"concat('POINT (', CAST({x} AS string), ' ', CAST({y} AS string), ')')")


WKT_POINT = r"^POINT\s*\(\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*\)$"


def from_wkt(text) -> Column:
    t = _col(text)
    return F.struct(F.regexp_extract(t, WKT_POINT, 1).try_cast("double").alias("x"),
                    F.regexp_extract(t, WKT_POINT, 2).try_cast("double").alias("y"))
