"""Cases that small fixtures hide: null attributes, equal points, parts of any order, several files, falling logs."""

import json

import pytest
from footreach.functions import geometry as G
from footreach.functions.geometry import RINGS_TYPE
from footreach.operators import checks as CH
from footreach.operators import spatial as SP
from footreach.sources import readers as RD
from footreach.sources import writers as WR
from pyspark.sql import functions as F


def box(a, b, c, d, turn=False):
    ring = [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d)), (float(a), float(b))]
    return ring[::-1] if turn else ring


SHELL, HOLE, FAR = box(0, 0, 4, 4), box(1, 1, 3, 3, True), box(10, 0, 11, 1, True)


@pytest.fixture
def one(spark):
    return lambda rings, x=0.0, y=0.0: spark.createDataFrame([(rings, float(x), float(y))], f"p {RINGS_TYPE}, x double, y double")


def test_left_joins_keep_each_point_once(spark):
    points = spark.createDataFrame([(None, 1.0, 1.0), ("a", 1.0, 1.0), ("a", 1.0, 1.0), (None, 9.0, 9.0)], "name string, x double, y double")
    areas = spark.createDataFrame([("A", [box(0, 0, 2, 2)])], f"area string, rings {RINGS_TYPE}")
    got = sorted(((r.name or "", r.area or "") for r in SP.within_join(points, areas, 1.0).collect()))
    assert got == [("", ""), ("", "A"), ("a", "A"), ("a", "A")]
    near = SP.distance_join(points, spark.createDataFrame([("f", 1.5, 1.0)], "feature string, fx double, fy double"), 1.0, how="left").collect()
    assert sorted((r.name or "", r.feature or "", r.distance or -1.0) for r in near) == [("", "", -1.0), ("", "f", 0.5), ("a", "f", 0.5), ("a", "f", 0.5)]


@pytest.mark.parametrize("rings,area", [([box(0, 0, 1, 1), FAR], 2), ([SHELL, HOLE], 12), ([SHELL[::-1], HOLE[::-1]], 12), ([SHELL, HOLE, box(1.5, 1.5, 2, 2)], 12.25),
                                        ([SHELL, HOLE, FAR], 13), ([FAR, HOLE[::-1], SHELL[::-1]], 13)])
def test_parts_add_and_holes_subtract_in_any_order(one, rings, area):
    assert one(rings).select(G.area("p")).first()[0] == pytest.approx(area)


def test_overlapping_parts_are_one_inside(one):
    for second in (box(1, 1, 3, 3), box(1, 1, 3, 3)[::-1]):
        assert one([box(0, 0, 2, 2), second], 1.5, 1.5).select(G.contains_point("p", "x", "y")).first()[0]
    assert not one([SHELL, HOLE, FAR], 2, 2).select(G.contains_point("p", "x", "y")).first()[0]
    assert one([SHELL, HOLE, FAR], 10.5, 0.5).select(G.contains_point("p", "x", "y")).first()[0]


def test_centroid_of_parts_in_opposite_order(one):
    c = one([box(0, 0, 1, 1), box(10, 0, 11, 1, True)]).select(G.centroid("p")).first()[0]
    assert (c.x, c.y) == pytest.approx((5.5, 0.5))


def test_multipolygons_come_back(spark, one, tmp_path):
    rows = spark.createDataFrame([("two", [SHELL, HOLE, FAR[::-1]]), ("one", [SHELL, HOLE])], f"name string, rings {RINGS_TYPE}")
    WR.write_geojson(rows, str(tmp_path / "g"), ["name"], rings="rings")
    text = {json.loads(r.value)["properties"]["name"]: json.loads(r.value)["geometry"] for r in spark.read.text(str(tmp_path / "g")).collect()}
    assert text["two"]["type"] == "MultiPolygon" and [len(p) for p in text["two"]["coordinates"]] == [2, 1] and text["one"]["type"] == "Polygon"
    back = RD.with_properties(RD.read_geojson(spark, str(tmp_path / "g"), lines=True), ["name"])
    assert {r.name: r.geometry_type for r in back.collect()} == {"two": "MultiPolygon", "one": "Polygon"}
    assert {r.name: r.a for r in back.select("name", G.area("rings").alias("a")).collect()} == {"two": 13.0, "one": 12.0}


def test_reader_turns_rings_by_their_place(spark, tmp_path):
    """Files may hold shells clockwise and holes in the same order as their shell."""
    doc = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [SHELL[::-1], HOLE[::-1], box(3.2, 3.2, 3.8, 3.8)]}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = RD.read_geojson(spark, str(tmp_path / "a.json"), lines=True)
    assert got.select(G.area("rings")).first()[0] == pytest.approx(16 - 4 - 0.36)


def test_key_ids_belong_to_their_file(spark, tmp_path):
    for k, (x, y) in enumerate((("d1", "d2"), ("d2", "d1"))):
        (tmp_path / f"{k}.graphml").write_text(
            f'<graphml><key id="{x}" for="node" attr.name="x"/><key id="{y}" for="node" attr.name="y"/><key id="d{3 + k}" for="edge" attr.name="length"/>'
            f'<graph><node id="{k}1"><data key="{x}">2.5</data><data key="{y}">48.5</data></node>'
            f'<edge source="{k}1" target="{k}1" id="0"><data key="d{3 + k}">7</data></edge></graph></graphml>')
    nodes, edges = RD.read_graphml(spark, str(tmp_path))
    assert {(r.x, r.y) for r in nodes.collect()} == {(2.5, 48.5)} and [r.length for r in edges.collect()] == [7.0, 7.0]


def test_scan_log_takes_the_last_value(spark, tmp_path):
    for name, values in (("a", (0.9, 0.5)), ("b", (0.4, 0.8))):
        (tmp_path / f"{name}.log").write_text("".join(f"INFO Best validation loss: {v}\n" for v in values) + "Best validation loss: n/a\n")
    got = {r.path[-5:]: r.best_val_loss for r in RD.scan_log(spark, str(tmp_path)).collect()}
    assert got == {"a.log": 0.5, "b.log": 0.8}


@pytest.mark.parametrize("total,warnings", [(1.0, 0), (0.75, 1), (1.25, 1), (0.65, 2), (1.35, 2)])
def test_ratio_sums_warn_in_two_tiers(spark, total, warnings):
    df = spark.createDataFrame([("u", total, 0.0)], "id string, permanent_employment_ratio double, temporary_employment_ratio double")
    m = CH.ratio_sums(df, "id", {"contract_sum": ["permanent_employment_ratio", "temporary_employment_ratio"]})
    r = CH.status_rollup(CH.check_rules(m, CH.rules_table(spark)), ["entity"]).first()
    assert (r.status, r.warning_count) == ("warn" if warnings else "pass", warnings)
