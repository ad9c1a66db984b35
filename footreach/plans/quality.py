"""Data-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footreach.functions import geometry as G
from footreach.functions import scalars as S
from footreach.functions import vectors as V
from footreach.operators import checks as CH
from footreach.operators import features as FT
from footreach.operators import network as N
from footreach.operators import quantiles as Q
from footreach.operators import spatial as SP
from footreach.plans import bindings as B
from footreach.plans.models import stars
from footreach.plans.access import component_share, geometry_validity
from footreach.plans.registry import ORACLES, query, r6
from footreach.plans.tables import _DEMO
from footreach.plans.tables import demographics as demographics_query
from footreach.plans.tables import file_inventory, missing_categories, unknown_tags
from footreach.sources import writers as WR


def rules_sql() -> str:
    rows = ", ".join(f"('{c}', '{m}', '{s}', '{o}', {float(b)!r}e0)" for c, m, s, o, b in CH.RULES + CH.ratio_rules())
    return f"(SELECT * FROM (VALUES {rows}) v(chk, metric, severity, op, bound))"


def judged_sql(metrics: str) -> str:
    """Gravest rule per entity and metric, over a table metrics(entity, metric, value)."""
    return f""", rules AS {rules_sql()}, hit AS (SELECT entity, chk, metric, value, CASE WHEN coalesce(CASE op WHEN '<' THEN value < bound WHEN '<=' THEN value <= bound
  WHEN '>' THEN value > bound ELSE value >= bound END, false) THEN CASE severity WHEN 'fail' THEN 2 ELSE 1 END ELSE 0 END AS r FROM {metrics} JOIN rules USING (metric)),
judged AS (SELECT entity, chk, metric, max(value) AS value, CASE max(r) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS severity FROM hit GROUP BY 1, 2, 3)"""


def _long(source: str, entity: str, names) -> str:
    return " UNION ALL ".join(f"SELECT CAST({entity} AS string) AS entity, '{n}' AS metric, CAST({e} AS double) AS value FROM {source}" for n, e in names.items())


_KM2 = f"(({B.mx('x1')} - {B.mx('x0')}) * ({B.my('y1')} - {B.my('y0')}) / 1e6)"

_AREA_SQL = B.sql("areas services buildings", f"""
, s AS (SELECT area_id, count(*) AS n FROM areas, services WHERE lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY 1),
b AS (SELECT area_id, count(*) AS n, min(try_cast(levels AS double)) AS lo, max(try_cast(levels AS double)) AS hi, count(CASE WHEN try_cast(levels AS double) IS NULL THEN 1 END) / count(*) AS miss,
  min(area_m2) AS amin, max(area_m2) AS amax, sum(area_m2) AS asum FROM areas, buildings WHERE lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY 1),
w AS (SELECT area_id, {_KM2} AS km2, coalesce(s.n, 0) AS sn, coalesce(b.n, 0) AS bn, lo, hi, miss, amin, amax, asum FROM areas LEFT JOIN s USING (area_id) LEFT JOIN b USING (area_id)),
m AS ({_long('w', 'area_id', {'service_count': 'sn', 'service_density': 'sn / km2', 'building_count': 'bn', 'building_density': 'bn / km2', 'min_levels': 'lo', 'max_levels': 'hi',
                               'missing_levels_share': 'miss', 'min_area': 'amin', 'max_area': 'amax', 'built_area_ratio': 'asum / (km2 * 1e6)'})})""")


def area_checks_table(spark, sf):
    """Service and building measures of every area against the rules."""
    a = B.areas(spark, sf).select("area_id", "rings")
    s = SP.within_join(B.services(spark, sf).select("service_id", "lon", "lat"), a, 0.02, x="lon", y="lat", how="inner").groupBy("area_id").agg(
        F.count(F.lit(1)).alias("service_count"))
    lv = S.to_number("levels")
    b = SP.within_join(B.buildings(spark, sf).select("building_id", "lon", "lat", "levels", "area_m2"), a, 0.02, x="lon", y="lat", how="inner").groupBy("area_id").agg(
        F.count(F.lit(1)).alias("building_count"), F.min(lv).alias("min_levels"), F.max(lv).alias("max_levels"),
        (F.count_if(lv.isNull()) / F.count(F.lit(1))).alias("missing_levels_share"), F.min("area_m2").alias("min_area"), F.max("area_m2").alias("max_area"),
        F.sum("area_m2").alias("_sum"))
    w = a.select("area_id", G.area_m2("rings").alias("area_m2")).join(s, "area_id", "left").join(b, "area_id", "left").fillna(0, ["service_count", "building_count"])
    w = CH.densities(w, ["service_count", "building_count"])
    names = {"service_count": F.col("service_count"), "service_density": F.col("service_count_per_km2"), "building_count": F.col("building_count"),
             "building_density": F.col("building_count_per_km2"), **{c: F.col(c) for c in ("min_levels", "max_levels", "missing_levels_share", "min_area", "max_area")},
             "built_area_ratio": F.try_divide(F.col("_sum"), F.col("area_m2"))}
    return CH.check_rules(CH.long_metrics(w, "area_id", names), CH.rules_table(spark))


@query("area_checks", "Q1 Q2 Q4 Q5 Q6 Q7 Q8 A6", _AREA_SQL + judged_sql("m") + 'SELECT entity, chk AS "check", metric, round(value, 4) AS value, severity FROM judged')
def area_checks(spark, sf):
    return area_checks_table(spark, sf).withColumn("value", F.round("value", 4))


@query("check_status", "A22 K5", _AREA_SQL + judged_sql("m") + """
SELECT entity AS name, CASE WHEN count(CASE WHEN severity = 'fail' THEN 1 END) > 0 THEN 'fail' WHEN count(CASE WHEN severity = 'warn' THEN 1 END) > 0 THEN 'warn' ELSE 'pass' END AS status,
  count(CASE WHEN severity = 'fail' THEN 1 END) AS issue_count, count(CASE WHEN severity = 'warn' THEN 1 END) AS warning_count FROM judged GROUP BY 1""")
def check_status(spark, sf):
    """The report as files: checks as JSON, the roll-up as CSV, which is read back."""
    path = B.scratch(spark, "report")
    WR.write_check_report(area_checks_table(spark, sf), path)
    return spark.read.schema("name string, status string, issue_count bigint, warning_count bigint").option("header", True).csv(f"{path}/summary")


@query("check_counts", "A22", _AREA_SQL + judged_sql("m") + """
, st AS (SELECT entity, chk, max(CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM judged GROUP BY 1, 2)
SELECT chk AS "check", count(CASE WHEN r = 0 THEN 1 END) AS pass, count(CASE WHEN r = 1 THEN 1 END) AS warn, count(CASE WHEN r = 2 THEN 1 END) AS fail FROM st GROUP BY 1""")
def check_counts(spark, sf):
    return CH.status_counts(area_checks_table(spark, sf))


@query("network_checks", "Q9 Q10 Q12 Q13 Q14 Q15 Q16", B.sql("nodes edges", f"""
, deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
d AS (SELECT count(*) AS n, min(degree) AS lo, max(degree) AS hi FROM deg WHERE degree >= 3),
e AS (SELECT count(*) AS n, min(length) AS lo, max(length) AS hi, avg(length) AS mean FROM edges), g AS (SELECT count(*) AS n, min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS dd FROM nodes),
w AS (SELECT 'network' AS k, g.n AS gn, e.n AS en, e.lo AS elo, e.hi AS ehi, e.mean, d.n AS dn, d.lo AS dlo, d.hi AS dhi, g.a, g.b, g.c, g.dd FROM g, e, d),
m AS ({_long('w', 'k', {'node_count': 'gn', 'edge_count': 'en', 'edges_per_node': 'en / gn', 'min_edge_length': 'elo', 'max_edge_length': 'ehi', 'mean_block_length': 'mean',
                         'intersection_count': 'dn', 'intersection_density': 'dn / 40', 'min_degree': 'dlo', 'max_degree': 'dhi', 'min_lon': 'a', 'max_lon': 'b', 'min_lat': 'c', 'max_lat': 'dd'})})""")
       + judged_sql("m") + 'SELECT entity, chk AS "check", metric, round(value, 4) AS value, severity FROM judged')
def network_checks(spark, sf):
    n, e = B.nodes(spark, sf), B.edges(spark, sf)
    deg = N.intersections(n, e).agg(F.count(F.lit(1)).alias("intersection_count"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    ed = e.agg(F.count(F.lit(1)).alias("edge_count"), F.min("length").alias("min_edge_length"), F.max("length").alias("max_edge_length"), F.avg("length").alias("mean_block_length"))
    no = n.agg(F.count(F.lit(1)).alias("node_count"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))
    from footreach.operators.relational import with_scalar
    w = with_scalar(with_scalar(no, ed), deg).withColumn("k", F.lit("network"))
    names = {c: F.col(c) for c in w.columns if c != "k"}
    names["edges_per_node"] = F.try_divide(F.col("edge_count").cast("double"), F.col("node_count"))
    names["intersection_density"] = F.col("intersection_count") / 40
    return CH.check_rules(CH.long_metrics(w, "k", names), CH.rules_table(spark)).withColumn("value", F.round("value", 4))


_CENSUS_METRICS = ["population_density", "median_income", "children_per_capita", "elderly_ratio", "working_age_ratio", "ses_index", "unemployment_rate", "car_commute_ratio",
                   "walking_ratio", "cycling_ratio", "public_transport_ratio", "two_wheelers_ratio", "student_ratio", "retired_ratio", "permanent_employment_ratio", "temporary_employment_ratio"]
_D_SQL = B.sql("units", f"""
, t AS (SELECT *, P17_POP1564 / ((SELECT sum(P17_POP1564) FROM units) / (SELECT 1.4e0 * sum(l_quantity) FROM lineitem)) AS tot FROM units),
d AS (SELECT IRIS, {', '.join(f'round({e}, 5) AS {n}' for n, e in _DEMO.items())} FROM t)""")


@query("census_checks", "Q21 Q22 Q23", _D_SQL + f", m AS ({_long('d', 'IRIS', {**{n: n for n in _CENSUS_METRICS}, 'poverty_rate': 'poverty_rate / 100'})})" + judged_sql("m")
       + "SELECT metric, severity, count(*) AS units FROM judged GROUP BY 1, 2")
def census_checks(spark, sf):
    d = demographics_query(spark, sf)
    m = CH.long_metrics(d, "IRIS", {**{n: F.col(n) for n in _CENSUS_METRICS}, "poverty_rate": F.col("poverty_rate") / 100})
    return CH.check_rules(m, CH.rules_table(spark)).groupBy("metric", "severity").agg(F.count(F.lit(1)).alias("units"))


_AGES, _MODES = ["children_per_capita", "elderly_ratio", "working_age_ratio"], ["walking_ratio", "cycling_ratio", "public_transport_ratio", "two_wheelers_ratio", "car_commute_ratio"]
_CONTRACTS = ["permanent_employment_ratio", "temporary_employment_ratio"]


_SUMS = {"age_sum": " + ".join(_AGES), "mode_share_sum": " + ".join(_MODES), "contract_sum": " + ".join(_CONTRACTS)}


@query("ratio_sums", "Q24", _D_SQL + f""", m AS ({_long('d', 'IRIS', _SUMS)})
SELECT entity, metric, round(value, 6) AS value, CASE WHEN value < 0.8 OR value > 1.2 THEN 'warn' ELSE 'pass' END AS severity FROM m
UNION ALL SELECT entity, metric || '_wide', round(value, 6), CASE WHEN value < 0.7 OR value > 1.3 THEN 'warn' ELSE 'pass' END FROM m""")
def ratio_sums(spark, sf):
    m = CH.ratio_sums(demographics_query(spark, sf), "IRIS", {"age_sum": _AGES, "mode_share_sum": _MODES, "contract_sum": _CONTRACTS})
    return CH.check_rules(m, CH.rules_table(spark)).select("entity", "metric", F.round("value", 6).alias("value"), "severity")


@query("column_profile", "A7", _D_SQL + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 9) AS mean, round(min({m}), 9) AS min, round(max({m}), 9) AS max, count(CASE WHEN {m} < {lo} OR {m} > {hi} THEN 1 END) AS outside_hard,"
    f" count(CASE WHEN {m} < {a} OR {m} > {b} THEN 1 END) AS outside_typical FROM d" for m, (lo, hi, a, b) in CH.RATIO_BOUNDS.items() if m != "car_ownership_rate"))
def column_profile(spark, sf):
    bounds = {m: b for m, b in CH.RATIO_BOUNDS.items() if m != "car_ownership_rate"}
    return CH.profile(demographics_query(spark, sf), bounds).select("metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "min", "max")], "outside_hard", "outside_typical")


_HEALTH = """
WITH j AS (SELECT d.doc_id, n_chars, lang, CAST(quality AS double) AS quality, CASE WHEN toxic = 1 THEN 'Infinity'::DOUBLE WHEN toxic = 0 AND quality = 0 THEN 'NaN'::DOUBLE ELSE CAST(toxic AS double) END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def health_rows(spark, sf):
    j = B.table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(B.table(spark, sf, "labels"), "doc_id", "left")
    score = F.when(F.col("toxic") == 1, float("inf")).when((F.col("toxic") == 0) & (F.col("quality") == 0), float("nan")).otherwise(F.col("toxic").cast("double"))
    return j.select("doc_id", "n_chars", "lang", F.col("quality").cast("double").alias("quality"), score.alias("score"))


@query("column_health", "Q19 Q20", _HEALTH + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS entity, count(CASE WHEN {c} IS NULL THEN 1 END) / count(*) AS missing_share, {nan} AS nan_values, {inf} AS inf_values FROM j" for c, nan, inf in (
        ("n_chars", "0", "0"), ("quality", "0", "0"), ("score", "count(CASE WHEN isnan(score) THEN 1 END)", "count(CASE WHEN isinf(score) THEN 1 END)"))) + "), lm AS ("
       + _long("m", "entity", {c: c for c in ("missing_share", "nan_values", "inf_values")}) + ")" + judged_sql("lm") + "SELECT entity, metric, round(value, 6) AS value, severity FROM judged")
def column_health(spark, sf):
    h = CH.column_health(health_rows(spark, sf), ["n_chars", "quality", "score"])
    m = CH.long_metrics(h, "column_name", ["missing_share", "nan_values", "inf_values"])
    return CH.check_rules(m, CH.rules_table(spark)).select("entity", "metric", r6("value").alias("value"), "severity")


@query("quality_report", "A10", """
WITH j AS (SELECT d.text, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), n AS (SELECT count(*) AS n FROM j),
u AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM j))
SELECT 'missing:text' AS measure, count(*) - count(text) AS "count", round((count(*) - count(text)) * 100 / count(*), 6) AS percent FROM j UNION ALL
SELECT 'missing:lang', count(*) - count(lang), round((count(*) - count(lang)) * 100 / count(*), 6) FROM j UNION ALL
SELECT 'missing:source', count(*) - count(source), round((count(*) - count(source)) * 100 / count(*), 6) FROM j UNION ALL
SELECT 'missing:quality', count(*) - count(quality), round((count(*) - count(quality)) * 100 / count(*), 6) FROM j UNION ALL
SELECT 'duplicate_rows', n - u, round((n - u) * 100 / n, 6) FROM n, u""")
def quality_report(spark, sf):
    j = B.table(spark, sf, "documents").select("doc_id", "text", "lang", "source").join(B.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return CH.quality_report(j, ["text", "lang", "source", "quality"]).withColumn("percent", r6("percent"))


@query("value_counts", "A11", "SELECT source, count(*) AS \"count\" FROM documents GROUP BY 1")
def value_counts(spark, sf):
    return CH.value_counts(B.table(spark, sf, "documents"), "source")


_COUNTS = "SELECT c_nationkey AS neighborhood_name, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS int) AS num_neighbors FROM customer"


def _counts(spark, sf):
    o = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("num_neighbors"))
    c = B.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("neighborhood_name"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("neighborhood_name", F.coalesce("num_neighbors", F.lit(0)).alias("num_neighbors"))


@query("dataset_summary", "A8 F20", f"""
WITH t AS ({_COUNTS}) SELECT count(*) AS "rows", min(num_neighbors) AS min, max(num_neighbors) AS max, round(avg(num_neighbors), 6) AS mean, round(stddev_samp(num_neighbors), 6) AS std,
 count(CASE WHEN num_neighbors = 0 THEN 1 END) AS zero_count, count(DISTINCT neighborhood_name) AS groups, round(median(num_neighbors), 6) AS median,
 CAST(floor((avg(num_neighbors) + 1) * 132 + avg(num_neighbors) * 24 + 32) AS bigint) AS estimated_bytes FROM t""")
def dataset_summary(spark, sf):
    out = Q.dataset_summary(_counts(spark, sf))
    return out.select("rows", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"), "zero_count", "groups", r6("median").alias("median"), "estimated_bytes")


@query("neighbour_statistics", "A9", f"""
WITH t AS ({_COUNTS}) SELECT count(*) AS n, round(avg(num_neighbors), 6) AS mean, round(stddev_pop(num_neighbors), 6) AS std_pop, min(num_neighbors) AS min, max(num_neighbors) AS max,
 round(median(num_neighbors), 6) AS median FROM t""")
def neighbour_statistics(spark, sf):
    out = Q.neighbour_stats(_counts(spark, sf))
    return out.select("n", r6("mean").alias("mean"), r6("std_pop").alias("std_pop"), "min", "max", r6("median").alias("median"))


@query("cross_source_checks", "Q25 Q26 Q27", B.sql("unit_boxes units services", f"""
, s AS (SELECT code, count(*) AS n FROM unit_boxes, services WHERE lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY 1),
w AS (SELECT u.code, ({B.mx('x1')} - {B.mx('x0')}) * ({B.my('y1')} - {B.my('y0')}) AS a, iris_area_m2 AS b, P17_POP1564 * 40 AS dens, coalesce(s.n, 0) AS sn FROM unit_boxes u JOIN units ON u.code = IRIS LEFT JOIN s ON s.code = u.code),
m AS ({_long('w', 'code', {'area_difference': 'abs(a - b) / greatest(a, b)', 'dense_few_buildings': 'CASE WHEN dens > 50000 AND sn * 3 < 50 THEN 1 ELSE 0 END',
                            'dense_few_services': 'CASE WHEN dens > 50000 AND sn < 10 THEN 1 ELSE 0 END', 'network_coverage': 'sn * 1e5 / a'})})""")
       + judged_sql("m") + "SELECT entity, metric, round(value, 5) AS value, severity FROM judged")
def cross_source_checks(spark, sf):
    boxes = B.unit_boxes(spark, sf)
    s = SP.within_join(B.services(spark, sf).select("lon", "lat"), boxes.select("code", "rings"), 0.004, x="lon", y="lat", how="inner").groupBy("code").agg(F.count(F.lit(1)).alias("service_count"))
    u = B.units(spark, sf).select(F.col("IRIS").alias("code"), F.col("iris_area_m2").alias("area_b"), (S.to_number("P17_POP1564") * 40).alias("population_density"))
    w = boxes.select("code", G.area_m2("rings").alias("area_a")).join(u, "code").join(s, "code", "left").fillna(0, ["service_count"]).withColumn(
        "building_count", F.col("service_count") * 3).withColumn("network_area", F.col("service_count") * 1e5)
    return CH.check_rules(CH.cross_checks(w, "code"), CH.rules_table(spark)).select("entity", "metric", F.round("value", 5).alias("value"), "severity")


@query("feature_row_check", "Q28", B.sql("targets", """
SELECT rule, CAST(CASE rule WHEN 'vector_length' THEN (SELECT count(*) FROM targets WHERE home = 3) WHEN 'vector_sum' THEN (SELECT count(*) FROM targets WHERE home = 3)
 WHEN 'geometry' THEN (SELECT count(*) FROM targets WHERE home = 4) ELSE 0 END AS bigint) AS violations, (SELECT count(*) FROM targets) AS "rows"
FROM (VALUES ('feature_length'), ('vector_length'), ('vector_sum'), ('neighbor_count'), ('geometry'), ('finite')) v(rule)"""))
def feature_row_check(spark, sf):
    """Built stars, of which the rows of two areas are spoiled; the check must find exactly those."""
    s = stars(spark, sf)
    p = V.softmax(F.slice("target_features", 22, 8))
    rows = s.withColumn("target_prob_vector", F.when(F.col("home") == 3, F.array(F.lit(0.5))).otherwise(p)).withColumn(
        "target_geometry", F.when(F.col("home") == 4, "LINE").otherwise(G.to_wkt("ix", "iy")))
    return FT.check_feature_rows(rows)


# bounds written out once more, so that a wrong rule shows
_SEVERITY_SQL = f"""
WITH m AS (
 SELECT 'tags' AS entity, 'invalid_categories' AS metric, CAST(count(*) AS double) AS value FROM ({ORACLES['unknown_tags']}) a
 UNION ALL SELECT CAST(area_id AS string), 'absent_categories', CAST(count(category) AS double) FROM (SELECT n_nationkey AS area_id FROM nation) LEFT JOIN ({ORACLES['missing_categories']}) b USING (area_id) GROUP BY area_id
 UNION ALL SELECT 'network', 'largest_component_share', CAST(share AS double) FROM ({ORACLES['component_share']}) c
 UNION ALL SELECT CAST(grp AS string), 'invalid_geometries', CAST(invalid_geometries AS double) FROM ({ORACLES['geometry_validity']}) d
 UNION ALL SELECT 'files', 'missing_files', CAST(count(CASE WHEN state = 'missing' THEN 1 END) AS double) FROM ({ORACLES['file_inventory']}) e
 UNION ALL SELECT 'files', 'empty_files', 0e0)
SELECT entity, metric, round(value, 6) AS value, CASE
 WHEN metric IN ('invalid_categories', 'invalid_geometries', 'missing_files') AND value > 0 THEN 'fail' WHEN metric = 'largest_component_share' AND value < 0.8 THEN 'fail'
 WHEN metric IN ('absent_categories', 'empty_files') AND value > 0 THEN 'warn' ELSE 'pass' END AS severity FROM m"""


@query("measured_severities", "Q3 Q11 Q17 Q18", _SEVERITY_SQL)
def measured_severities(spark, sf):
    """Unknown tags, absent categories, the largest component, broken geometries and missing files, each judged by its rule."""
    tags = unknown_tags(spark, sf).agg(F.count(F.lit(1)).alias("invalid_categories")).withColumn("k", F.lit("tags"))
    absent = B.areas(spark, sf).select("area_id").join(missing_categories(spark, sf), "area_id", "left").groupBy(F.col("area_id").alias("k")).agg(F.count("category").alias("absent_categories"))
    largest = component_share(spark, sf).select(F.lit("network").alias("k"), F.col("share").alias("largest_component_share"))
    shapes = geometry_validity(spark, sf).withColumnRenamed("grp", "k")
    files = file_inventory(spark, sf).agg(F.count_if(F.col("state") == "missing").alias("missing_files"), F.count_if(F.col("state") == "empty").alias("empty_files")).withColumn("k", F.lit("files"))
    m = CH.long_metrics(tags, "k", ["invalid_categories"])
    for df, names in ((absent, ["absent_categories"]), (largest, ["largest_component_share"]), (shapes, ["invalid_geometries"]), (files, ["missing_files", "empty_files"])):
        m = m.unionByName(CH.long_metrics(df, "k", names))
    return CH.check_rules(m, CH.rules_table(spark)).select("entity", "metric", r6("value").alias("value"), "severity")
