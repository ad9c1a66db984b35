"""Filters, lookups, joins, set operations, census and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footreach.constants import CATEGORIES, DEMOGRAPHIC_FEATURES
from footreach.functions import geometry as G
from footreach.functions import scalars as S
from footreach.operators import census as C
from footreach.operators import features as FT
from footreach.operators import relational as R
from footreach.operators import spatial as SP
from footreach.plans import bindings as B
from footreach.plans.registry import query, r6
from footreach.sources import readers as RD
from footreach.sources import writers as WR

# ---- filters and columns -------------------------------------------------------------------------


@query("compliant_areas", "P1 P13", B.sql("areas", "SELECT area_id, name FROM areas WHERE label = 'Compliant' AND verification_status = 'verified'"))
def compliant_areas(spark, sf):
    return R.compliant(B.areas(spark, sf)).select("area_id", "name")


@query("non_compliant_areas", "P2", B.sql("areas", "SELECT area_id, name FROM areas WHERE label = 'Non-Compliant'"))
def non_compliant_areas(spark, sf):
    return R.non_compliant(B.areas(spark, sf)).select("area_id", "name")


@query("gated_areas", "P3 A23", B.sql("areas targets", """
SELECT CASE WHEN label = 'Compliant' AND coalesce(verification_status, '') = 'verified' THEN 'ready' ELSE 'skipped' END AS status, count(*) AS targets
FROM targets JOIN areas ON home = area_id GROUP BY 1"""))
def gated_areas(spark, sf):
    a = R.gate(B.areas(spark, sf), (F.col("label") == "Compliant") & (F.col("verification_status") == "verified")).select("area_id", "status")
    return R.lookup(B.targets(spark, sf).select(F.col("home").alias("area_id")), a, "area_id").groupBy("status").agg(F.count(F.lit(1)).alias("targets"))


@query("code_prefix_units", "P4 S6", B.sql("units", "SELECT IRIS, P17_POP1564 AS pop FROM units WHERE starts_with(COM, '75')"))
def code_prefix_units(spark, sf):
    return C.read_census(B.units(spark, sf)).select("IRIS", S.to_number("P17_POP1564").alias("pop"))


@query("units_in_codes", "P5 J12", B.sql("units", """
SELECT IRIS, P17_POP1564 AS pop FROM units WHERE IRIS IN (SELECT lpad(CAST(s_suppkey AS string), 9, '0') FROM supplier WHERE s_acctbal > 5000)"""))
def units_in_codes(spark, sf):
    codes = B.table(spark, sf, "supplier").filter(F.col("s_acctbal") > 5000).select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("code"))
    return C.read_census(B.units(spark, sf), codes=codes).select("IRIS", S.to_number("P17_POP1564").alias("pop"))


@query("unknown_tags", "P6 Q3", B.sql("tag_map tagged", "SELECT DISTINCT kind AS tag FROM (SELECT lower(p_type) AS kind FROM part UNION ALL SELECT amenity FROM tagged) t WHERE kind NOT IN (SELECT tag FROM tag_map)"))
def unknown_tags(spark, sf):
    tags = B.table(spark, sf, "part").select(F.lower("p_type").alias("tag")).unionByName(B.tagged(spark, sf).select(F.col("amenity").alias("tag")))
    return R.not_in(tags, "tag", FT.tag_map(spark).select("tag").distinct())


@query("resolved_columns", "P7 P9", "SELECT l_suppkey AS unit, round(sum(l_quantity), 6) AS first_match, round(sum(l_extendedprice), 3) AS by_substring, count(*) AS n FROM lineitem GROUP BY 1")
def resolved_columns(spark, sf):
    li = B.table(spark, sf, "lineitem")
    v = li.select("l_suppkey", S.resolve_col(li, ["NB_MEN", "L_QUANTITY", "l_tax"], numeric=True).alias("a"),
                  S.resolve_col(li, ["MED"], ["extended"], numeric=True).alias("b"), S.resolve_col(li, ["none"]).alias("c"))
    return v.groupBy(F.col("l_suppkey").alias("unit")).agg(r6(F.sum("a")).alias("first_match"), F.round(F.sum("b"), 3).alias("by_substring"),
                                                           F.count_if(F.col("c").isNull()).alias("n"))


@query("columns_by_pattern", "P8", B.sql("units", "SELECT IRIS, round(C17_ACT1564_CS1 + C17_ACT1564_CS2 + C17_ACT1564_CS3, 6) AS status_workers FROM units"))
def columns_by_pattern(spark, sf):
    u = B.units(spark, sf)
    cols = S.cols_like(u, ["C17_ACT1564_CS"])
    total = S.to_number(cols[0])
    for c in cols[1:]:
        total = total + S.to_number(c)
    return u.select("IRIS", r6(total).alias("status_workers"))


@query("text_to_number", "P9 P11", B.sql("buildings", """
SELECT trim(levels) AS levels, try_cast(levels AS double) AS number, count(*) AS n FROM buildings GROUP BY 1, 2"""))
def text_to_number(spark, sf):
    return B.buildings(spark, sf).groupBy(S.norm_code("levels").alias("levels"), S.to_number("levels").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("normalised_names", "P10 P12 U3", "SELECT DISTINCT replace(lower(n), ' ', '_') AS name_key FROM (SELECT p_name AS n FROM part UNION ALL SELECT replace(n_name, '_', ' ') FROM nation) t")
def normalised_names(spark, sf):
    a = R.project(B.table(spark, sf, "part"), {"p_name": "n"})
    b = R.project(B.areas(spark, sf), {"name": "n"})
    return R.dedupe_names(R.union_all(a, b), "n")


@query("matched_names", "P14", """
WITH l AS (SELECT DISTINCT p_name AS name, replace(lower(p_name), ' ', '_') AS a FROM part),
r AS (SELECT DISTINCT o AS other, replace(lower(o), ' ', '_') AS b FROM (SELECT lower(p_type) AS o FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part
  UNION ALL SELECT upper(p_name) FROM part WHERE p_size < 10) t),
m AS (SELECT name, other, CASE WHEN a = b THEN 0 ELSE 1 END AS kind FROM l, r WHERE a = b OR contains(a, b) OR contains(b, a)),
best AS (SELECT name, min(kind) AS kind FROM m GROUP BY 1)
SELECT name, min(other) AS other, kind FROM best JOIN m USING (name, kind) GROUP BY name, kind""")
def matched_names(spark, sf):
    p = B.table(spark, sf, "part")
    other = p.select(F.lower("p_type").alias("other")).unionByName(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("other"))).unionByName(
        p.filter(F.col("p_size") < 10).select(F.upper("p_name").alias("other")))
    return R.match_names(p.select(F.col("p_name").alias("name")), other)


@query("safe_ratios", "F17 F16 F18", B.sql("targets", """
SELECT target_id, round(CASE WHEN length(segment) = 9 THEN 0e0 ELSE balance / (length(segment) - 9) END, 6) AS ratio,
  round(abs(balance) / 1200e0, 6) AS quarter_hours, round(abs(balance) / 1000 / 5 * 60, 6) AS minutes,
  printf('%.1f%%', round(floor(abs(balance)) / 64 * 100, 1)) AS pct FROM targets"""))
def safe_ratios(spark, sf):
    t = B.targets(spark, sf)
    return t.select("target_id", r6(S.safe_ratio("balance", F.length("segment") - 9)).alias("ratio"), r6(S.norm_15min(F.abs("balance"))).alias("quarter_hours"),
                    r6(S.walk_minutes(F.abs("balance"))).alias("minutes"), S.fmt_pct(F.floor(F.abs("balance")) / 64).alias("pct"))


@query("coordinate_text", "F18", B.sql("services", "SELECT service_id, printf('%.4f, %.4f', lat, lon) AS place FROM services"))
def coordinate_text(spark, sf):
    return B.services(spark, sf).select("service_id", S.fmt_coord("lat", "lon").alias("place"))


@query("seeded_uniform", "W12", "SELECT c_custkey AS id, round(('0x' || substr(md5(c_custkey || '|42'), 1, 8))::UBIGINT / 4294967296.0, 9) AS u FROM customer")
def seeded_uniform(spark, sf):
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(S.uniform(42, "c_custkey"), 9).alias("u"))


# ---- joins ---------------------------------------------------------------------------------------

@query("boundary_census", "J1 J2", B.sql("units unit_boxes", """
, income AS (SELECT lpad(CAST(l_suppkey AS string), 9, '0') AS code_i, max(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT code, home, P17_POP1564 AS pop, med FROM unit_boxes JOIN units ON code = IRIS LEFT JOIN income ON code = code_i"""))
def boundary_census(spark, sf):
    u = B.units(spark, sf).select("IRIS", S.to_number("P17_POP1564").alias("pop"))
    income = B.table(spark, sf, "lineitem").groupBy(F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("code_i")).agg(
        F.max("l_extendedprice").alias("med"))
    joined = R.join_on(B.unit_boxes(spark, sf).select("code", "home"), u, "code", "IRIS").drop("IRIS")
    return R.add_tables(joined, "code", (income, "code_i")).select("code", "home", "pop", "med")


@query("area_lookup", "J4", B.sql("targets areas", "SELECT label, verification_status, count(*) AS targets FROM targets LEFT JOIN areas ON home = area_id GROUP BY 1, 2"))
def area_lookup(spark, sf):
    t = B.targets(spark, sf).select(F.col("home").alias("area_id"))
    return R.lookup(t, B.areas(spark, sf).select("area_id", "label", "verification_status"), "area_id").groupBy("label", "verification_status").agg(
        F.count(F.lit(1)).alias("targets"))


@query("categorised_tags", "J5 P6", B.sql("tagged tag_map", """
, t AS (SELECT service_id, amenity AS tag FROM tagged UNION ALL SELECT service_id, shop FROM tagged UNION ALL SELECT service_id, leisure FROM tagged)
SELECT category, count(*) AS matches, count(DISTINCT service_id) AS objects FROM t JOIN tag_map USING (tag) GROUP BY 1"""))
def categorised_tags(spark, sf):
    got = R.categorise(B.tagged(spark, sf).select("service_id", "amenity", "shop", "leisure"), FT.tag_map(spark))
    per = got.groupBy("category", "service_id").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("category").agg(F.sum("m").alias("matches"), F.count(F.lit(1)).alias("objects"))


@query("unit_or_mean", "J10 A4 J7", B.sql("targets unit_boxes units", """
, inside AS (SELECT target_id, home AS grp, (SELECT min(code) FROM unit_boxes b WHERE lon > b.x0 AND lon < b.x1 AND lat > b.y0 AND lat < b.y1) AS code FROM targets),
vals AS (SELECT IRIS, P17_POP1564 AS v, home AS grp FROM units JOIN unit_boxes ON code = IRIS),
m AS (SELECT grp, avg(v) AS m FROM vals GROUP BY 1)
SELECT target_id, round(CASE WHEN vals.IRIS IS NOT NULL THEN v ELSE coalesce(m, 0e0) END, 6) AS pop
FROM inside LEFT JOIN vals ON code = IRIS LEFT JOIN m ON m.grp = inside.grp"""))
def unit_or_mean(spark, sf):
    boxes = B.unit_boxes(spark, sf)
    t = B.targets(spark, sf).select("target_id", F.col("home").alias("grp"), "lon", "lat")
    hit = SP.least_within(t, boxes, 0.004, by=["target_id", "grp"], x="lon", y="lat").withColumnsRenamed({"target_id": "_t", "grp": "_g"})
    points = t.select("target_id", "grp").distinct().join(hit, F.expr("target_id <=> _t AND grp <=> _g"), "left").drop("_t", "_g")
    census = R.join_on(B.units(spark, sf).select("IRIS", "P17_POP1564"), boxes.select("code", F.col("home").alias("grp")), "IRIS", "code")
    out = R.match_or_mean(
        points, census.select(F.col("IRIS").alias("code"), "grp", "P17_POP1564"), "code", "grp", ["P17_POP1564"])
    return out.select("target_id", r6("P17_POP1564").alias("pop"))


@query("unit_fallback_means", "A4", B.sql("units unit_boxes", "SELECT home, round(avg(P17_POP1564), 6) AS pop, round(avg(DISP_MED17), 4) AS income FROM units JOIN unit_boxes ON code = IRIS GROUP BY 1"))
def unit_fallback_means(spark, sf):
    u = R.join_on(B.units(spark, sf), B.unit_boxes(spark, sf).select("code", "home"), "IRIS", "code")
    out = C.group_means(u, "home", ["P17_POP1564", "DISP_MED17"])
    return out.select("home", r6("P17_POP1564").alias("pop"), F.round("DISP_MED17", 4).alias("income"))


@query("targets_not_done", "J11 T1", "SELECT c_custkey AS target_id, c_nationkey AS home FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def targets_not_done(spark, sf):
    done = B.table(spark, sf, "orders").filter(F.col("o_totalprice") > 250000).select(F.col("o_custkey").alias("target_id"))
    return R.not_done(B.targets(spark, sf).select("target_id", "home"), done, ["target_id"])


@query("rows_of_groups", "J12", B.sql("targets areas", "SELECT target_id, home FROM targets WHERE home IN (SELECT area_id FROM areas WHERE label = 'Compliant' AND verification_status = 'verified')"))
def rows_of_groups(spark, sf):
    return R.keep_groups(B.targets(spark, sf).select("target_id", "home"), R.compliant(B.areas(spark, sf)).select(F.col("area_id").alias("home")), "home")


@query("missing_categories", "J13 U4 Q3", B.sql("services categories areas", """
, present AS (SELECT DISTINCT area_id, category_index FROM services, areas WHERE lon > x0 AND lon < x1 AND lat > y0 AND lat < y1)
SELECT area_id, c.category FROM areas CROSS JOIN categories c LEFT JOIN present p USING (area_id, category_index) WHERE p.area_id IS NULL"""))
def missing_categories(spark, sf):
    a = B.areas(spark, sf)
    s = B.services(spark, sf).select("category_index", "lon", "lat")
    present = SP.within_join(s, a.select("area_id", "rings"), 0.02, x="lon", y="lat", how="inner").select("area_id", "category_index")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    required = a.select("area_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("category_index"))
    return R.except_required(required, present).select("area_id", F.get(names, F.col("category_index")).alias("category"))


@query("share_of_total", "J14", "SELECT o_custkey AS owner, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 9) AS share FROM orders GROUP BY 1")
def share_of_total(spark, sf):
    o = B.table(spark, sf, "orders")
    per = o.groupBy(F.col("o_custkey").alias("owner")).agg(F.sum("o_totalprice").alias("t"))
    return R.with_scalar(per, o.agg(F.sum("o_totalprice").alias("total"))).select("owner", F.round(F.col("t") / F.col("total"), 9).alias("share"))


# ---- sets ----------------------------------------------------------------------------------------

@query("union_of_pulls", "U1", B.sql("tagged", """
SELECT src, count(*) AS n, count(amenity) AS amenities, count(shop) AS shops FROM (SELECT 'a' AS src, amenity, NULL AS shop FROM tagged
 UNION ALL SELECT 's', NULL, shop FROM tagged WHERE shop IS NOT NULL) t GROUP BY 1"""))
def union_of_pulls(spark, sf):
    t = B.tagged(spark, sf)
    both = R.union_features(t.select(F.lit("a").alias("src"), "amenity"), t.filter(F.col("shop").isNotNull()).select(F.lit("s").alias("src"), "shop"))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("amenity").alias("amenities"), F.count("shop").alias("shops"))


@query("tagged_union", "U2 U3", B.sql("services", """
SELECT feature_type, count(*) AS n, round(avg(lon), 6) AS lon FROM (SELECT 'pedestrian_way' AS feature_type, lon FROM services WHERE size <= 10
 UNION ALL SELECT 'sidewalk', lon FROM services WHERE size > 10 AND size <= 30 UNION ALL SELECT 'crosswalk', lon FROM services WHERE size > 20) t GROUP BY 1"""))
def tagged_union(spark, sf):
    s = B.services(spark, sf).select("size", "lon")
    u = R.union_tagged(pedestrian_way=s.filter("size <= 10"), sidewalk=s.filter("size > 10 AND size <= 30"), crosswalk=s.filter("size > 20"))
    return u.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("lon")).alias("lon"))


@query("units_without_large_orders", "U4", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def units_without_large_orders(spark, sf):
    req = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return R.except_required(req, B.table(spark, sf, "orders").filter(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("k")))


# ---- census --------------------------------------------------------------------------------------

@query("car_ownership", "A1 J3", B.sql("households", """
SELECT IRIS, count(*) AS P17_MEN, count(CASE WHEN VOIT IN ('1', '2', '3') THEN 1 END) AS C17_MEN_VOIT, count(CASE WHEN VOIT = '1' THEN 1 END) AS C17_MEN_VOIT1,
  count(CASE WHEN VOIT IN ('2', '3') THEN 1 END) AS C17_MEN_VOIT2P, round(count(CASE WHEN VOIT IN ('1', '2', '3') THEN 1 END) / count(*), 6) AS car_ownership_rate FROM households GROUP BY 1"""))
def car_ownership(spark, sf):
    return C.car_ownership(B.households(spark, sf)).withColumn("car_ownership_rate", r6("car_ownership_rate"))


@query("commune_population", "S7 S8", "SELECT 1.4e0 * sum(l_quantity) AS total_population FROM lineitem")
def commune_population(spark, sf):
    """The population row among rows of other units, with an empty first table and a fallback."""
    q = B.table(spark, sf, "lineitem").agg((F.sum("l_quantity") * 1.4).cast("string").alias("v"))
    rows = q.select(F.explode(F.array(*[F.struct(F.lit(u).alias("UNIT"), F.lit(s).alias("STOCD"), v.alias("OBS_VALUE")) for u, s, v in (
        ("LOG", "ENS", F.lit("12")), ("POP", "H", F.lit("n/a")), ("POP", "ENS", F.col("v")))])).alias("r")).select("r.*")
    return C.commune_population(R.first_nonempty(rows.filter(F.col("UNIT") == "NONE"), rows))


def _population(spark, sf):
    return B.table(spark, sf, "lineitem").agg((F.sum("l_quantity") * 1.4).alias("total_population"))


_R = "coalesce({a} / nullif({b}, 0), 0e0)"


def _ratio(a, b):
    return _R.format(a=a, b=b)


_DEMO = {
    "population_density": "tot / (iris_area_m2 / 1e6)",
    "ses_index": _ratio("(C17_ACT1564_CS1 + C17_ACT1564_CS2 + C17_ACT1564_CS3)", "C17_ACT1564"),
    "car_commute_ratio": _ratio("C17_ACTOCC15P_VOIT", "P17_ACTOCC15P"),
    "children_per_capita": _ratio("0.47e0 * (tot - P17_POP1564)", "tot"),
    "elderly_ratio": _ratio("0.53e0 * (tot - P17_POP1564)", "tot"),
    "unemployment_rate": _ratio("P17_CHOM1564", "P17_ACT1564"),
    "student_ratio": _ratio("P17_ETUD1564", "tot"),
    "walking_ratio": _ratio("C17_ACTOCC15P_PAS", "P17_ACTOCC15P"),
    "cycling_ratio": _ratio("C17_ACTOCC15P_VELO", "P17_ACTOCC15P"),
    "public_transport_ratio": _ratio("C17_ACTOCC15P_TCOM", "P17_ACTOCC15P"),
    "two_wheelers_ratio": _ratio("C17_ACTOCC15P_2ROUESMOT", "P17_ACTOCC15P"),
    "retired_ratio": _ratio("(P17_RETR1564 + 0.53e0 * (tot - P17_POP1564))", "tot"),
    "permanent_employment_ratio": _ratio("P17_SAL15P_CDI", "P17_SAL15P"),
    "temporary_employment_ratio": _ratio("P17_SAL15P_CDD", "P17_SAL15P"),
    "median_income": "DISP_MED17", "poverty_rate": "DISP_TP6017",
    "working_age_ratio": _ratio("P17_POP1564", "tot"),
}


@query("demographics", "D1 D2 D4 D5 D6 D7 D8 D9 D10 D11 D12 D13 D14 D15 D16 D17 A5 J14", B.sql("units", f"""
, t AS (SELECT *, P17_POP1564 / ((SELECT sum(P17_POP1564) FROM units) / (SELECT 1.4e0 * sum(l_quantity) FROM lineitem)) AS tot FROM units)
SELECT IRIS, {', '.join(f'round({e}, 5) AS {n}' for n, e in _DEMO.items())} FROM t"""))
def demographics(spark, sf):
    u = B.units(spark, sf)
    d = C.demographics(u, u, _population(spark, sf), ["IRIS"])
    return d.select("IRIS", *[F.round(c, 5).alias(c) for c in DEMOGRAPHIC_FEATURES])


@query("working_age_ratio", "A5 D7", "SELECT round(sum(l_quantity) / (1.4e0 * sum(l_quantity)), 6) AS working_ratio FROM lineitem")
def working_age_ratio(spark, sf):
    return C.working_age_ratio(B.units(spark, sf), _population(spark, sf)).withColumn("working_ratio", r6("working_ratio"))


@query("car_ownership_rate", "D3 A1", B.sql("households", """
SELECT IRIS, round(avg(CASE WHEN VOIT IN ('1', '2', '3') THEN 1e0 ELSE 0e0 END), 6) AS from_rate, round(avg(CASE WHEN VOIT IN ('1', '2', '3') THEN 1e0 ELSE 0e0 END), 6) AS from_counts,
 round(count(CASE WHEN VOIT = '1' THEN 1 END) / 100, 6) AS from_percent FROM households GROUP BY 1"""))
def car_ownership_rate(spark, sf):
    own = C.car_ownership(B.households(spark, sf))
    parts = own.select("IRIS", "P17_MEN", "C17_MEN_VOIT1", "C17_MEN_VOIT2P")
    pct = own.select("IRIS", "P17_MEN", F.col("C17_MEN_VOIT1").alias("PCT_MEN_VOIT"))
    a = own.select("IRIS", r6(C.car_ownership_rate(own)).alias("from_rate"))
    b = parts.select("IRIS", r6(C.car_ownership_rate(parts)).alias("from_counts"))
    c = pct.select("IRIS", r6(C.car_ownership_rate(pct)).alias("from_percent"))
    return a.join(b, "IRIS").join(c, "IRIS")


@query("null_census", "A25", B.sql("units", """
SELECT 'transport' AS keyword_group, 'C17_ACTOCC15P_TCOM' AS column_name, count(C17_ACTOCC15P_TCOM) AS non_null FROM units UNION ALL
SELECT 'transport', 'C17_ACTOCC15P_VELO', count(C17_ACTOCC15P_VELO) FROM units UNION ALL SELECT 'income', 'DISP_MED17', count(DISP_MED17) FROM units"""))
def null_census(spark, sf):
    return C.null_census(B.units(spark, sf), {"transport": ["TCOM", "VELO"], "income": ["_MED"]})


@query("column_coverage", "A26 P13", B.sql("buildings", """
SELECT 'levels' AS column_name, 'found' AS state, count(levels) AS non_null FROM buildings UNION ALL SELECT 'area_m2', 'found', count(area_m2) FROM buildings
UNION ALL SELECT 'floors', 'missing', 0 FROM (SELECT 1) t"""))
def column_coverage(spark, sf):
    return C.column_coverage(B.buildings(spark, sf), ["levels", "area_m2", "floors"])


@query("unit_level_check", "Q29 A24", B.sql("units", """
SELECT count(*) AS "rows", count(DISTINCT IRIS) AS codes, count(*) > 1 AS unit_level, count(*) = count(DISTINCT IRIS) AS unique_codes,
 max(P17_POP1564) > min(P17_POP1564) AS varies FROM units"""))
def unit_level_check(spark, sf):
    return C.check_units(B.units(spark, sf), "IRIS", "P17_POP1564")


@query("distinct_units", "A24", B.sql("targets households", "SELECT (SELECT count(DISTINCT home) FROM targets) AS areas, (SELECT count(DISTINCT IRIS) FROM households) AS units FROM (SELECT 1) t"))
def distinct_units(spark, sf):
    units = B.households(spark, sf).select("IRIS").distinct().agg(F.count(F.lit(1)).alias("units")).select("units")
    return B.targets(spark, sf).select("home").distinct().agg(F.count(F.lit(1)).alias("areas")).withColumn("units", units.scalar())


# ---- files ---------------------------------------------------------------------------------------

@query("geojson_points", "S1 K9", B.sql("services", "SELECT CAST(category_index AS string) AS category, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM services GROUP BY 1"))
def geojson_points(spark, sf):
    """Write the services as GeoJSON lines and read them back."""
    path = B.scratch(spark, "points")
    WR.write_geojson(B.services(spark, sf).withColumnRenamed("category_index", "category"), path, ["category"], x="lon", y="lat")
    back = RD.with_properties(RD.read_geojson(spark, path, lines=True), ["category"])
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("lon"), r6(F.avg("y")).alias("lat"))


@query("geojson_polygons", "S1 S9 K9", B.sql("unit_boxes", "SELECT code, round((x1 - x0) * (y1 - y0) * 1e6, 6) AS area FROM unit_boxes"))
def geojson_polygons(spark, sf):
    """Unit boundaries through GeoJSON, found as the first existing of several paths."""
    path = B.scratch(spark, "units")
    WR.write_geojson(B.unit_boxes(spark, sf).withColumnRenamed("code", "DCOMIRIS"), path, ["DCOMIRIS"], rings="rings")
    units = RD.read_boundaries(spark, [path + "-2021", path], lines=True)
    return units.select("code", r6(G.area("rings") * 1e6).alias("area"))


@query("graphml_network", "S2 N6", B.sql("nodes edges", """
SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, round(sum(length), 3) AS total_length, (SELECT round(sum(lon), 4) FROM nodes) AS lon_sum FROM edges"""))
def graphml_network(spark, sf):
    """The street network through GraphML, by the XML source."""
    path = B.scratch(spark, "graphml")
    WR.write_graphml(B.nodes(spark, sf).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y")),
                     B.edges(spark, sf).withColumn("key", F.lit(0)), path)
    nodes, edges = RD.read_graphml(spark, path)
    totals = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("x"), 4).alias("lon_sum"))
    return R.with_scalar(edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length"), 3).alias("total_length")), totals)


@query("feature_files", "S3 S4 K3", B.sql("targets areas", "SELECT label AS status, home, count(*) AS n FROM targets JOIN areas ON home = area_id GROUP BY 1, 2"))
def feature_files(spark, sf):
    """Targets written by status and area, then found again by a recursive scan."""
    path = B.scratch(spark, "features")
    t = B.targets(spark, sf).select("target_id", "home")
    a = B.areas(spark, sf).select(F.col("area_id").alias("home"), F.col("label").alias("status"), F.col("name").alias("neighborhood_name"))
    df = R.lookup(t, a, "home").withColumn("label", F.col("status"))
    WR.write_features(df, path)
    back = RD.read_features(spark, path, "*.parquet")
    return back.groupBy(F.col("label").alias("status"), "home").agg(F.count(F.lit(1)).alias("n"))


@query("csv_round_trip", "S5 K1", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_round_trip(spark, sf):
    path = B.scratch(spark, "orders-csv")
    WR.save_table(B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "csv")
    back = RD.load_table(spark, path, "csv", "o_orderkey bigint, o_orderpriority string, o_totalprice double")
    return back.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("services_by_category_files", "K2 J13", B.sql("services categories", """
SELECT category_index, c.category, count(s.service_id) AS "count" FROM categories c LEFT JOIN services s USING (category_index) GROUP BY 1, 2"""))
def services_by_category_files(spark, sf):
    """One folder per category; a category without services is still counted, as 0."""
    path = B.scratch(spark, "by-category")
    WR.write_by_category(B.services(spark, sf), path, "category_index", ["name", "kind", "lon", "lat"])
    return WR.read_by_category(spark.read.parquet(path), FT.category_dim(spark), "category_index").select("category_index", "category", "count")


@query("file_inventory", "S11 Q18 J13", B.sql("services", """
, need AS (SELECT unnest(generate_series(0, 9)) AS k)
SELECT 'category_index=' || k AS name, CASE WHEN EXISTS (SELECT 1 FROM services WHERE category_index = k) THEN 'found' ELSE 'missing' END AS state FROM need"""))
def file_inventory(spark, sf):
    """Category folders against a required list that names two too many."""
    path = B.scratch(spark, "inventory")
    WR.write_by_category(B.services(spark, sf), path, "category_index", ["name", "kind"])
    return RD.file_inventory(spark, path, [f"category_index={i}" for i in range(10)]).select("name", "state")
