import pytest
from footreach.operators import census as C
from footreach.operators import checks as CH
from footreach.operators import features as FT
from footreach.operators import relational as R
from footreach.operators.quantiles import histogram, quantiles, ranks
from footreach.constants import CATEGORY_TAGS
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([("750101001", "75056", "1000", 100.0, 200.0), ("750101002", "75056", "2000", 200.0, 400.0), ("930010001", "93001", "1500", 50.0, 100.0),
                                  (None, None, "x", None, 0.0)], "IRIS string, COM string, P17_POP1564 string, C17_ACTOCC15P_VOIT double, P17_ACTOCC15P double")


def test_commune_and_code_filters(units):
    assert C.read_census(units).count() == 2
    assert C.read_census(units, codes=["930010001"]).count() == 1
    assert C.read_census(units, codes=units.select("IRIS").limit(0)).count() == 0
    with pytest.raises(ValueError, match="COM"):
        C.read_census(units.drop("COM"))


def test_car_commute_and_constant_age_ratios(spark, units):
    pop = spark.createDataFrame([(6000.0,)], "total_population double")
    rows = {r.IRIS: r for r in C.demographics(units, units, pop, ["IRIS"]).collect()}
    assert rows["750101001"].car_commute_ratio == 0.5
    assert rows[None].car_commute_ratio == 0.0  # nothing over nothing
    assert {round(r.working_age_ratio, 6) for k, r in rows.items() if k} == {0.75}
    assert {round(r.children_per_capita, 6) for k, r in rows.items() if k} == {round(0.47 * 0.25, 6)}
    assert rows["750101001"].median_income is None and rows["750101001"].population_density is None


def test_car_ownership(spark):
    h = spark.createDataFrame([("a", v) for v in "0123X"] + [("b", "X")], "IRIS string, VOIT string")
    r = {x.IRIS: x for x in C.car_ownership(h).collect()}
    assert (r["a"].P17_MEN, r["a"].C17_MEN_VOIT, r["a"].C17_MEN_VOIT1, r["a"].C17_MEN_VOIT2P, r["a"].car_ownership_rate) == (5, 3, 1, 2, 0.6)
    assert r["b"].car_ownership_rate == 0.0
    pct = spark.createDataFrame([(20.0, 100.0)], "PCT_MEN_VOIT double, P17_MEN double")
    assert pct.select(C.car_ownership_rate(pct).alias("r")).first().r == 0.2
    none = pct.select(F.lit(1).alias("z"))
    assert none.select(C.car_ownership_rate(none).alias("r")).first().r is None


def test_commune_population(spark):
    rows = spark.createDataFrame([("POP", "H", "1"), ("LOG", "ENS", "2"), ("POP", "ENS", "3")], "UNIT string, STOCD string, OBS_VALUE string")
    assert [r.total_population for r in C.commune_population(rows).collect()] == [3.0]
    assert C.commune_population(rows.filter("OBS_VALUE <> '3'")).count() == 0


def test_category_map(spark):
    assert sum(map(len, CATEGORY_TAGS.values())) == 91
    assert len({t for ts in CATEGORY_TAGS.values() for t in ts}) == 86
    objs = spark.createDataFrame([(1, "ice_cream", None, None), (2, "atm", None, None), (3, "cafe", "bakery", "park"), (4, None, None, None)],
                                 "id int, amenity string, shop string, leisure string")
    got = sorted((r.id, r.category) for r in R.categorise(objs, FT.tag_map(spark)).collect())
    assert got == [(1, "Grocery"), (1, "Sustenance"), (3, "Grocery"), (3, "Parks"), (3, "Sustenance")]


def test_match_or_mean(spark):
    pts = spark.createDataFrame([(1, " u1 ", "g"), (2, "zz", "g"), (3, None, "h"), (4, "u3", "g")], "id int, code string, grp string")
    cen = spark.createDataFrame([("u1", "g", 10.0), ("u2", "g", 30.0), ("u3", "g", None)], "code string, grp string, v double")
    assert {r.id: r.v for r in R.match_or_mean(pts, cen, "code", "grp", ["v"]).collect()} == {1: 10.0, 2: 20.0, 3: 0.0, 4: 0.0}


def test_required_columns_and_gate(spark):
    df = spark.createDataFrame([("Compliant", "verified"), ("Compliant", None), ("Non-Compliant", None)], "label string, verification_status string")
    assert R.compliant(df).count() == 1 and R.non_compliant(df).count() == 1
    with pytest.raises(ValueError, match="verification_status"):
        R.compliant(df.drop("verification_status"))
    assert R.gate(df, F.col("verification_status") == "verified").filter("status = 'skipped'").count() == 2


def test_checks(spark):
    m = spark.createDataFrame([("a", "service_count", 0.0), ("b", "service_count", 3.0), ("c", "service_count", 50.0), ("c", "edges_per_node", 3.0), ("d", "service_count", None)],
                              "entity string, metric string, value double")
    got = CH.check_rules(m, CH.rules_table(spark))
    assert {(r.entity, r.metric): r.severity for r in got.collect()} == {
        ("a", "service_count"): "fail", ("b", "service_count"): "warn", ("c", "service_count"): "pass", ("c", "edges_per_node"): "fail", ("d", "service_count"): "pass"}
    assert {r.entity: r.status for r in CH.status_rollup(got, ["entity"]).collect()} == {"a": "fail", "b": "warn", "c": "fail", "d": "pass"}


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "x int, y string")
    r = {x.measure: (x["count"], x.percent) for x in CH.quality_report(df).collect()}
    assert r == {"missing:x": (0, 0.0), "missing:y": (2, 40.0), "duplicate_rows": (3, 60.0)}


def test_quantiles_ranks_histogram(spark):
    vals = [5.0] * 40 + [float(i * i % 97) for i in range(80)] + [None]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "v double, g int")
    clean = sorted(v for v in vals if v is not None)

    def at(s, p):
        k = p * (len(s) - 1)
        lo, hi = s[int(k)], s[min(int(k) + 1, len(s) - 1)]
        return lo + (hi - lo) * (k - int(k))
    got = {r.prob: r.value for r in quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert got == pytest.approx({p: at(clean, p) for p in got})
    by = {(r.g, r.prob): r.value for r in quantiles(df, "v", [0.25, 0.75], ["g"]).collect()}
    for (g, p), v in by.items():
        assert v == pytest.approx(at(sorted(x for i, x in enumerate(vals) if i % 2 == g and x is not None), p))
    for r in ranks(df.filter("v IS NOT NULL"), "v", ascending=False).collect():
        assert r.rank_min == 1 + sum(x > r.v for x in clean)
        assert r.rank_avg == r.rank_min + (clean.count(r.v) - 1) / 2
    h = histogram(df, "v", 10).orderBy("bin").collect()
    assert len(h) == 10 and sum(x["count"] for x in h) == len(clean)


def test_unit_check_flags_constant_features(spark):
    df = spark.createDataFrame([("1", 5.0), ("2", 5.0)], "IRIS string, f double")
    r = C.check_units(df, "IRIS", "f").first()
    assert (r.unit_level, r.unique_codes, r.varies) == (True, True, False)


def test_name_containment_equals_all_pairs_and_stays_linear(spark):
    import random
    rng = random.Random(4)
    name = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    left = list({name(rng.randint(0, 9)) for _ in range(60)} | {"Éa b", "a" * 1000 + "b" + "a" * 500, "xyz uvw", "one qwertyuiop two", "q"})
    right = list({name(rng.randint(0, 6)) for _ in range(60)} | {"ÉA B", "a" * 700, "ab" + "a" * 499, "XYZ", "uv", "w", "qwertyuiop", "ertyuio", "a q b"})
    got = {r.name: (r.other, r.kind) for r in R.match_names(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "other string")).collect()}
    norm = lambda x: x.lower().replace(" ", "_")
    want = {}
    for x in left:
        a = norm(x)
        hits = [(0 if norm(y) == a else 1, y) for y in right if norm(y) == a or (a and norm(y) and (norm(y) in a or a in norm(y)))]
        if hits:
            kind, other = min(hits)
            want[x] = (other, kind)
    assert got == want
