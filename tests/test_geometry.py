import math

import pytest
from footreach.functions import geometry as G
from footreach.functions.geometry import RINGS_TYPE
from pyspark.sql import functions as F


def ring(*pts):
    return [tuple(map(float, p)) for p in pts]


SQUARE = [ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]
DONUT = SQUARE + [ring((1, 1), (1, 3), (3, 3), (3, 1), (1, 1))]
ELL = [ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))]
FAR = [ring((10, 10), (12, 10), (12, 12), (10, 12), (10, 10))]
TIE = [ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))]
SMALL = [ring((1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5), (1.5, 1.5))]
EDGE = [ring((4, 0), (6, 0), (6, 4), (4, 4), (4, 0))]


@pytest.fixture(scope="module")
def shape(spark):
    def make(**cols):
        schema = ", ".join(f"{n} {'double' if isinstance(v, (int, float)) else RINGS_TYPE}" for n, v in cols.items())
        return spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in cols.values())], schema)
    return make


def val(df, col):
    return df.select(col.alias("v")).first()[0]


@pytest.mark.parametrize("poly,x,y,inside", [
    (SQUARE, 2, 2, True), (SQUARE, 5, 2, False), (SQUARE, 0, 2, False), (SQUARE, 4, 4, False), (SQUARE, 2, 0, False),
    (DONUT, 2, 2, False), (DONUT, 0.5, 2, True), (DONUT, 1, 2, False), (ELL, 0.5, 3, True), (ELL, 3, 3, False), (ELL, 2, 1, False)])
def test_contains_is_strict(shape, poly, x, y, inside):
    assert val(shape(p=poly, x=x, y=y), G.contains_point("p", "x", "y")) is inside


def test_covers_includes_the_boundary(shape):
    assert val(shape(p=SQUARE, x=0, y=2), G.covers_point("p", "x", "y"))
    assert val(shape(p=DONUT, x=1, y=2), G.covers_point("p", "x", "y"))


@pytest.mark.parametrize("poly,area", [(SQUARE, 16), (DONUT, 12), (ELL, 7), (SQUARE + FAR, 20)])
def test_area(shape, poly, area):
    assert val(shape(p=poly), G.area("p")) == pytest.approx(area)


def test_area_modes(shape):
    unit = [ring((2.35, 48.85), (2.36, 48.85), (2.36, 48.86), (2.35, 48.86), (2.35, 48.85))]
    assert val(shape(p=unit), G.area_m2("p", "degrees")) == pytest.approx(1e-4 * 111320**2, rel=1e-6)
    assert val(shape(p=unit), G.area_m2("p")) == pytest.approx(1113.1949 * 1113.1949 / math.cos(math.radians(48.855)), rel=1e-4)


def test_centroid(shape):
    assert tuple(val(shape(p=SQUARE), G.centroid("p"))) == (2.0, 2.0)
    c = val(shape(p=ELL), G.centroid("p"))
    assert (c.x, c.y) == pytest.approx(((4 * 2 + 3 * 0.5) / 7, (4 * 0.5 + 3 * 2.5) / 7))
    flat = [ring((0, 0), (2, 0), (0, 0))]
    assert val(shape(p=flat), G.centroid("p")).y == 0.0


@pytest.mark.parametrize("p,q,meet,inside", [(SQUARE, FAR, False, False), (SMALL, SQUARE, True, True), (SQUARE, SMALL, True, False),
                                             (SQUARE, EDGE, True, False), (SMALL, DONUT, False, False), (ELL, SQUARE, True, True)])
def test_polygon_relations(shape, p, q, meet, inside):
    df = shape(p=p, q=q)
    assert val(df, G.polygon_intersects("p", "q")) is meet
    assert val(df, G.polygon_within("p", "q")) is inside


@pytest.mark.parametrize("x,y,d", [(2, 2, 0), (6, 2, 2), (7, 8, 5), (-1, 0, 1), (4, 2, 0)])
def test_distance_to_polygon(shape, x, y, d):
    assert val(shape(p=SQUARE, x=x, y=y), G.polygon_distance("p", "x", "y")) == pytest.approx(d)
    assert val(shape(p=SQUARE, x=x, y=y), G.polygon_dwithin("p", "x", "y", d))


def test_buffer(shape):
    df = shape(p=SQUARE, x=4.001, y=2)
    assert val(df, G.within_buffer("p", "x", "y", 500.0))
    assert not val(df, G.within_buffer("p", "x", "y", 50.0))
    assert not val(shape(p=SQUARE, x=4.0, y=2), G.within_buffer("p", "x", "y", 0))
    with pytest.raises(ValueError):
        G.within_buffer("p", "x", "y", -1)


@pytest.mark.parametrize("poly,ok", [(SQUARE, True), (DONUT, True), (TIE, False), ([ring((0, 0), (1, 0), (1, 1))], False), ([], False),
                                     ([ring((0, 0), (1, 0), (1, 1), (0, 1))], False), ([ring((0, 0), (math.nan, 0), (1, 1), (0, 0))], False)])
def test_validity(shape, poly, ok):
    assert val(shape(p=poly), G.valid_geometry("p")) is ok


def test_dissolve(shape):
    assert val(shape(p=SQUARE + FAR), F.size(G.dissolve("p"))) == 2
    assert val(shape(p=SQUARE + FAR), F.size(G.dissolve("p", strict=True))) == 0
    assert val(shape(p=SQUARE + EDGE), F.size(G.dissolve("p", strict=True))) == 2


def test_wkt_and_mercator(spark):
    df = spark.sql("SELECT 2.3522D AS lon, 48.8566D AS lat")
    w = df.select(G.to_wkt("lon", "lat").alias("w"))
    assert w.first()[0] == "POINT (2.3522 48.8566)"
    p = w.select(G.from_wkt("w").alias("p")).first().p
    assert (p.x, p.y) == (2.3522, 48.8566)
    assert spark.sql("SELECT 'POLYGON ((1 2))' w").select(G.from_wkt("w").alias("p")).first().p.x is None
    x, y = df.select(G.mercator_x("lon"), G.mercator_y("lat")).first()
    assert (x, y) == pytest.approx((261845.7, 6250564.3), abs=1)


def test_haversine(spark):
    d = spark.sql("SELECT 0D a, 0D b, 1D c, 0D d").select(G.haversine("a", "b", "c", "d")).first()[0]
    assert d == pytest.approx(math.radians(1) * 6371009)
