"""Shapes compared edge by edge in buckets, and the union of parts, against the in-row expressions and exact areas."""

import math
import random

import pytest
from footreach.functions import geometry as G
from footreach.functions.geometry import RINGS_TYPE
from footreach.operators import shapes as S
from footreach.operators import spatial as SP
from footreach.operators.checks import check_geometry
from pyspark.sql import functions as F


def closed(pts):
    return [(float(x), float(y)) for x, y in [*pts, pts[0]]]


def wheel(n, cx=0.0, cy=0.0, r=1.0, wobble=0.0, seed=1):
    rng = random.Random(seed)
    return closed([(cx + r * (1 + wobble * rng.random()) * math.cos(2 * math.pi * k / n), cy + r * (1 + wobble * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)])


def box(a, b, c, d):
    return closed([(a, b), (c, b), (c, d), (a, d)])


def test_long_rings_are_valid_like_short_ones(spark, monkeypatch):
    """The same verdict from buckets as from all pairs inside the row, on rings of all kinds."""
    rng = random.Random(5)
    rings = [wheel(n, wobble=w, seed=n) for n in (5, 30, 80) for w in (0.0, 0.5)]
    for n in (6, 20, 60):
        rings.append(closed([(rng.random(), rng.random()) for _ in range(n)]))
        good = wheel(n)
        good[n // 2], good[n // 2 + 1] = good[n // 2 + 1], good[n // 2]
        rings.append(good)
    rings += [closed([(0, 0), (1, 0), (2, 0)]), [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], closed([(0, 0), (0, 0), (1, 0), (1, 1)]), closed([(0, 0), (math.nan, 0), (1, 1)] * 5)]
    spokes = [p for k in range(40) for p in ((0, 0), (math.cos(k / 7), math.sin(k / 7)))]  # many edges through one point
    rows = [(i, [r]) for i, r in enumerate([*rings, closed(spokes)])] + [(900, [wheel(70), closed([(9, 9), (8, 8), (9, 8), (8, 9)])]), (901, []), (902, None)]
    df = spark.createDataFrame(rows, f"k int, rings {RINGS_TYPE}").repartition(5)
    want = {r.k: r.v for r in df.select("k", G.valid_geometry("rings").alias("v")).collect()}
    for edges in (64, 0):
        monkeypatch.setattr(S, "ROW_EDGES", edges)
        monkeypatch.setattr(S, "BUCKET", 8)
        got = {r.k: r.is_valid for r in S.with_validity(df).collect()}
        assert got == want
    total = check_geometry(df).first()
    assert (total.geometries, total.invalid_geometries) == (len(rows), sum(not v for v in want.values()))


def test_a_very_long_ring_in_small_buckets(spark):
    """30,000 edges, nearly all of them in one corner: no bucket holds many, and one crossing is found."""
    pts = [(1e-4 * math.cos(2 * math.pi * k / 30_000), 1e-4 * math.sin(2 * math.pi * k / 30_000)) for k in range(30_000)]
    ring = closed(pts[:15_000] + [(-2.0, 0.0), (-2.0, -1.0)] + pts[15_001:])
    crossed = list(ring)
    crossed[2000], crossed[2001] = crossed[2001], crossed[2000]
    df = spark.createDataFrame([(0, [ring]), (1, [crossed])], f"k int, rings {RINGS_TYPE}")
    assert {r.k: r.is_valid for r in S.with_validity(df).collect()} == {0: True, 1: False}
    b = S.bucketed(S.edges_of(df.filter("k = 0"), "rings", "k"), ["k"])
    sizes = b.groupBy("_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= S.BUCKET and b.count() < 4 * 30_000


def test_large_shapes_relate_like_small_ones(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        p = wheel(rng.choice([5, 20, 40]), rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0.2, 1.5), 0.3, k)
        q = wheel(rng.choice([6, 25]), 0, 0, rng.uniform(0.5, 2), 0.3, k + 100)
        rows.append((k, [p], [q]))
    donut = [box(0, 0, 8, 8), list(reversed(box(2, 2, 6, 6)))]
    rows += [(100, [box(0, 0, 1, 1)], [box(0, 0, 2, 2)]), (101, [box(3, 3, 4, 4)], donut), (102, [box(0, 0, 2, 8)], donut), (103, [box(8, 0, 9, 1)], donut), (104, [box(1, 1, 7, 7)], donut)]
    df = spark.createDataFrame(rows, f"k int, rings {RINGS_TYPE}, other {RINGS_TYPE}")
    for relation, test in (("intersects", G.polygon_intersects), ("within", G.polygon_within)):
        want = {r.k for r in df.filter(test("rings", "other")).select("k").collect()}
        monkeypatch.setattr(S, "ROW_EDGES", 0)
        monkeypatch.setattr(S, "BUCKET", 6)
        got = {r.k for r in S.related(df, "rings", "other", relation).select("k").collect()}
        monkeypatch.undo()
        assert got == want and want


def test_polygon_join_uses_the_same_relations(spark):
    left = spark.createDataFrame([(k, [wheel(90, k % 7, k // 7, 0.3)]) for k in range(30)], f"k int, rings {RINGS_TYPE}")
    right = spark.createDataFrame([(9, [wheel(200, 3, 2, 2.2)])], f"o int, other_rings {RINGS_TYPE}")
    for relation, test in (("intersects", G.polygon_intersects), ("within", G.polygon_within)):
        want = {r.k for r in left.crossJoin(right).filter(test("rings", "other_rings")).select("k").collect()}
        assert {r.k for r in SP.intersects_join(left, right, 1.0, relation=relation).select("k").collect()} == want and want


# ---- union ---------------------------------------------------------------------------------------

def raster(boxes):
    return len({(x, y) for a, b, c, d in boxes for x in range(a, c) for y in range(b, d)})


def test_union_of_overlapping_and_touching_boxes(spark):
    """Area equal to counted cells; the outline has no inner edge and the same area."""
    rng = random.Random(3)
    groups = {}
    for g in range(25):
        boxes = []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.randint(0, 12), rng.randint(0, 12)
            boxes.append((a, b, a + rng.randint(1, 6), b + rng.randint(1, 6)))
        groups[g] = boxes + boxes[:1]  # one part twice
    rows = [(g, [box(*x) if rng.random() < 0.5 else list(reversed(box(*x)))]) for g, boxes in groups.items() for x in boxes] + [(0, [])]
    df = spark.createDataFrame(rows, f"g int, rings {RINGS_TYPE}").repartition(4)
    assert {r.g: r.area for r in S.union_area(df, ["g"]).collect()} == pytest.approx({g: raster(b) for g, b in groups.items()})
    out = S.union_shapes(df, ["g"])
    assert {r.g: r.a for r in out.select("g", G.area("rings").alias("a")).collect()} == pytest.approx({g: raster(b) for g, b in groups.items()})
    probe = spark.createDataFrame([(x + 0.5, y + 0.5) for x in range(-1, 20) for y in range(-1, 20)], "px double, py double")
    inside = {(r.g, int(r.px - 0.5), int(r.py - 0.5)) for r in out.crossJoin(probe).filter(G.contains_point("rings", "px", "py")).collect()}
    assert inside == {(g, x, y) for g, boxes in groups.items() for a, b, c, d in boxes for x in range(a, c) for y in range(b, d)}


def test_frame_of_boxes_is_a_shell_and_a_hole(spark):
    parts = [box(0, 0, 6, 1), box(0, 5, 6, 6), box(0, 1, 1, 5), box(5, 1, 6, 5)]
    df = spark.createDataFrame([("a", [p]) for p in parts] + [("b", parts)], f"name string, rings {RINGS_TYPE}")
    for r in S.union_shapes(df, ["name"]).collect():
        assert sorted(len(x) for x in r.rings) == [5, 5]
    assert {r.name: r.area for r in S.union_area(df, ["name"]).collect()} == {"a": 20.0, "b": 20.0}


def clip(subject, by):
    """Convex clip, for the overlap of two triangles."""
    out = subject
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by_ - ay) * (p[0] - ax)  # noqa: E731, B023
        nxt = []
        for p, q in zip(out, out[1:] + out[:1]):
            a, b = side(p), side(q)
            if a >= 0:
                nxt.append(p)
            if a * b < 0:
                t = a / (a - b)
                nxt.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = nxt
    return out


def area(pts):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1])) / 2


def test_union_of_triangles_is_inclusion_and_exclusion(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for g in range(40):
        pair = []
        while len(pair) < 2:
            t = [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(3)]
            if area(t) > 0.2:
                pair.append(t)
        rows += [(g, [closed(t)]) for t in pair]
        want[g] = area(pair[0]) + area(pair[1]) - area(clip(*pair) or [(0, 0)])
    df = spark.createDataFrame(rows, f"g int, rings {RINGS_TYPE}")
    assert {r.g: r.area for r in S.union_area(df, ["g"]).collect()} == pytest.approx(want, abs=1e-6)
    assert {r.g: r.a for r in S.union_shapes(df, ["g"]).select("g", G.area("rings").alias("a")).collect()} == pytest.approx(want, abs=1e-6)
