"""Data checks: measure, compare with a table of rules, roll the severities up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.functions import vectors as V
from footreach.operators.shapes import with_validity
from footreach.session import inline_table

# --- fixed values: check, metric, severity, comparison, bound (a row fires when `metric <op> bound`) ---
RULES = [
    ("services", "service_count", "fail", "<=", 0), ("services", "service_count", "warn", "<", 5),
    ("services", "service_count", "warn", ">", 10000),
    ("services", "service_density", "fail", "<=", 0), ("services", "service_density", "fail", ">=", 500),
    ("services", "service_density", "warn", "<", 10), ("services", "service_density", "warn", ">", 300),
    ("services", "invalid_categories", "fail", ">", 0), ("services", "absent_categories", "warn", ">", 0),
    ("buildings", "building_count", "fail", "<=", 0), ("buildings", "building_count", "warn", "<", 10),
    ("buildings", "building_count", "warn", ">", 50000),
    ("buildings", "building_density", "fail", "<=", 0), ("buildings", "building_density", "fail", ">=", 5000),
    ("buildings", "building_density", "warn", "<", 50), ("buildings", "building_density", "warn", ">", 3000),
    ("buildings", "min_levels", "fail", "<", 1), ("buildings", "max_levels", "fail", ">", 60),
    ("buildings", "max_levels", "warn", ">", 12), ("buildings", "missing_levels_share", "warn", ">", 0.5),
    ("buildings", "min_area", "fail", "<=", 1), ("buildings", "max_area", "fail", ">=", 100000),
    ("buildings", "max_area", "warn", ">", 50000),
    ("buildings", "built_area_ratio", "fail", "<=", 0.1), ("buildings", "built_area_ratio", "fail", ">=", 0.8),
    ("buildings", "built_area_ratio", "warn", "<", 0.30),
    ("network", "node_count", "fail", "<=", 0), ("network", "node_count", "warn", "<", 10),
    ("network", "edge_count", "fail", "<=", 0), ("network", "edge_count", "warn", "<", 10),
    ("network", "edges_per_node", "fail", "<=", 0.5), ("network", "edges_per_node", "fail", ">=", 3.0),
    ("network", "largest_component_share", "fail", "<", 0.8),
    ("network", "min_edge_length", "fail", "<=", 1), ("network", "max_edge_length", "fail", ">=", 5000),
    ("network", "max_edge_length", "warn", ">", 2000),
    ("network", "mean_block_length", "fail", "<", 50), ("network", "mean_block_length", "fail", ">", 300),
    ("intersections", "intersection_count", "fail", "<=", 0), ("intersections", "intersection_count", "warn", "<", 5),
    ("intersections", "intersection_density", "fail", "<", 20), ("intersections", "intersection_density", "fail", ">", 500),
    ("intersections", "intersection_density", "warn", ">", 400),
    ("intersections", "min_degree", "fail", "<", 3), ("intersections", "max_degree", "fail", ">", 10),
    ("coordinates", "min_lon", "warn", "<", 2.2), ("coordinates", "max_lon", "warn", ">", 2.4),
    ("coordinates", "min_lat", "warn", "<", 48.8), ("coordinates", "max_lat", "warn", ">", 48.9),
    ("geometry", "invalid_geometries", "fail", ">", 0),
    ("pedestrian", "invalid_types", "fail", ">", 0), ("pedestrian", "file_missing", "warn", ">", 0),
    ("columns", "inf_values", "fail", ">", 0), ("columns", "nan_values", "warn", ">", 0),
    ("columns", "missing_share", "fail", ">", 0.20),
    ("census", "population_density", "fail", "<", 1000), ("census", "population_density", "fail", ">", 60000),
    ("census", "population_density", "warn", "<", 5000), ("census", "population_density", "warn", ">", 50000),
    ("census", "median_income", "fail", "<", 10000), ("census", "median_income", "fail", ">", 200000),
    ("census", "median_income", "warn", "<", 15000), ("census", "median_income", "warn", ">", 70000),
    ("sums", "age_sum", "warn", "<", 0.8), ("sums", "age_sum", "warn", ">", 1.2),
    ("sums", "mode_share_sum", "warn", "<", 0.8), ("sums", "mode_share_sum", "warn", ">", 1.2),
    ("sums", "contract_sum", "warn", "<", 0.8), ("sums", "contract_sum", "warn", ">", 1.2),
    ("sums", "age_sum_wide", "warn", "<", 0.7), ("sums", "age_sum_wide", "warn", ">", 1.3),
    ("sums", "mode_share_sum_wide", "warn", "<", 0.7), ("sums", "mode_share_sum_wide", "warn", ">", 1.3),
    ("sums", "contract_sum_wide", "warn", "<", 0.7), ("sums", "contract_sum_wide", "warn", ">", 1.3),
    ("cross", "area_difference", "fail", ">", 0.10), ("cross", "dense_few_buildings", "warn", ">", 0),
    ("cross", "dense_few_services", "warn", ">", 0), ("cross", "network_coverage", "warn", "<", 0.5),
    ("files", "missing_files", "fail", ">", 0), ("files", "empty_files", "warn", ">", 0),
]

# --- fixed values: hard and typical range of each ratio ---
RATIO_BOUNDS = {
    "children_per_capita": (0, 0.3, 0.08, 0.20), "elderly_ratio": (0, 0.4, 0.10, 0.25),
    "working_age_ratio": (0, 1, 0.6, 0.8), "ses_index": (0, 1, 0.1, 0.8),
    "unemployment_rate": (0, 0.5, 0.01, 0.30), "poverty_rate": (0, 0.5, 0.06, 0.40),
    "car_ownership_rate": (0, 0.9, 0.1, 0.6), "car_commute_ratio": (0, 0.8, 0.05, 0.5),
    "walking_ratio": (0, 1, 0.1, 0.6), "cycling_ratio": (0, 0.3, 0.01, 0.10),
    "public_transport_ratio": (0, 1, 0.30, 0.75), "two_wheelers_ratio": (0, 0.2, 0.01, 0.10),
    "student_ratio": (0, 0.4, 0.05, 0.25), "retired_ratio": (0, 0.4, 0.05, 0.35),
    "permanent_employment_ratio": (0, 1, 0.70, 0.95), "temporary_employment_ratio": (0, 1, 0.05, 0.5),
}


def ratio_rules() -> list[tuple]:
    out = []
    for m, (lo, hi, tlo, thi) in RATIO_BOUNDS.items():
        out += [("census", m, "fail", "<", lo), ("census", m, "fail", ">", hi),
                ("census", m, "warn", "<", tlo), ("census", m, "warn", ">", thi)]
    return out


def rules_table(spark, rules=None) -> DataFrame:
    rows = [(c, m, s, o, float(b)) for c, m, s, o, b in (rules or RULES + ratio_rules())]
    return inline_table(spark, rows, "check string, metric string, severity string, op string, bound double")


def long_metrics(df: DataFrame, entity: str, metrics: dict[str, Column] | list[str]) -> DataFrame:
    """Wide measures of an entity to rows (entity, metric, value); an aggregate is unfolded, never the raw rows."""
    items = metrics if isinstance(metrics, dict) else {m: F.col(m) for m in metrics}
    return df.select(F.col(entity).cast("string").alias("entity"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), e.cast("double").alias("value")) for n, e in items.items()])).alias("_m")
    ).select("entity", "_m.metric", "_m.value")


def check_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, check, metric, value, severity): the gravest rule that fires, pass when none does.

    The rules table has a fixed size, so it is broadcast; a null value fires nothing. A metric may belong to one check.
    """
    m = metrics.join(F.broadcast(rules), "metric")
    v, b = F.col("value"), F.col("bound")
    hit = (F.when(F.col("op") == "<", v < b).when(F.col("op") == "<=", v <= b)
           .when(F.col("op") == ">", v > b).when(F.col("op") == ">=", v >= b))
    rank = F.when(~F.coalesce(hit, F.lit(False)), 0).when(F.col("severity") == "fail", 2).otherwise(1)
    worst = m.groupBy("entity", "check", "metric").agg(F.max(rank).alias("_r"), F.max("value").alias("value"))
    return worst.select("entity", "check", "metric", "value", _severity("_r").alias("severity"))


def _severity(rank: str) -> Column:
    return F.when(F.col(rank) == 2, F.lit("fail")).when(F.col(rank) == 1, F.lit("warn")).otherwise(F.lit("pass"))


def _rank(severity: str) -> Column:
    return F.when(F.col(severity) == "fail", 2).when(F.col(severity) == "warn", 1).otherwise(0)


def status_rollup(checks: DataFrame, by: list[str]) -> DataFrame:
    """Status (any fail -> fail, else any warn -> warn, else pass) with the numbers of issues and warnings."""
    return checks.groupBy(*by).agg(
        F.max(_rank("severity")).alias("_r"), F.count_if(F.col("severity") == "fail").alias("issue_count"),
        F.count_if(F.col("severity") == "warn").alias("warning_count"),
    ).select(*by, _severity("_r").alias("status"), "issue_count", "warning_count")


def status_counts(checks: DataFrame, entity: str = "entity") -> DataFrame:
    """Per check: entities that pass, warn and fail."""
    return status_rollup(checks, [entity, "check"]).groupBy("check").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")])


def profile(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Per metric: rows, mean, min, max, rows outside the hard and the typical range; one pass, one wide aggregate."""
    aggs = []
    for i, (m, (lo, hi, tlo, thi)) in enumerate(bounds.items()):
        c = F.col(m).cast("double")
        aggs += [F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_a{i}"), F.min(c).alias(f"_l{i}"), F.max(c).alias(f"_h{i}"),
                 F.count_if((c < lo) | (c > hi)).alias(f"_o{i}"), F.count_if((c < tlo) | (c > thi)).alias(f"_t{i}")]
    one = df.agg(*aggs)
    entries = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mean"), F.col(f"_l{i}").alias("min"),
        F.col(f"_h{i}").alias("max"), F.col(f"_o{i}").alias("outside_hard"), F.col(f"_t{i}").alias("outside_typical"))
        for i, m in enumerate(bounds)])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def column_health(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: share of nulls, NaN and infinite values (one scan), ready for `check_rules`."""
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_m{i}"))
        is_num = c in numeric
        aggs.append((F.count_if(F.isnan(c)) if is_num else F.lit(0).cast("long")).alias(f"_q{i}"))
        aggs.append((F.count_if(F.abs(F.col(c)) == float("inf")) if is_num else F.lit(0).cast("long")).alias(f"_i{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.try_divide(F.col(f"_m{i}").cast("double"), F.col("_n").cast("double")).alias("missing_share"),
        F.col(f"_q{i}").alias("nan_values"), F.col(f"_i{i}").alias("inf_values")) for i, c in enumerate(cols)])).alias("e")).select("e.*")


def ratio_sums(df: DataFrame, entity: str, groups: dict[str, list[str]]) -> DataFrame:
    """Row-wise sums of ratio groups (ages, modes, contracts) as metrics.

    Each sum is a metric for both tiers of warnings: a sum beyond the wide bounds warns twice.
    """
    sums = {n: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0))) for n, cols in groups.items()}
    return long_metrics(df, entity, {**sums, **{f"{n}_wide": e for n, e in sums.items()}})


def cross_checks(df: DataFrame, entity: str) -> DataFrame:
    """Area from two sources, dense population with few buildings or services, share of the area the network covers."""
    dense = F.col("population_density") > 50000
    return long_metrics(df, entity, {
        "area_difference": F.try_divide(F.abs(F.col("area_a") - F.col("area_b")), F.greatest("area_a", "area_b")),
        "dense_few_buildings": F.when(dense & (F.col("building_count") < 50), 1).otherwise(0),
        "dense_few_services": F.when(dense & (F.col("service_count") < 10), 1).otherwise(0),
        "network_coverage": F.try_divide(F.col("network_area"), F.col("area_a")),
    })


def check_geometry(df: DataFrame, rings: str = "rings", by: list[str] = ()) -> DataFrame:
    """Shapes and invalid ones; rings of any length are compared edge by edge in buckets."""
    return with_validity(df, rings, "_valid").groupBy(*by).agg(F.count(F.lit(1)).alias("geometries"), F.count_if(~F.col("_valid")).alias("invalid_geometries"))


def densities(df: DataFrame, counts: list[str], area_m2: str = "area_m2") -> DataFrame:
    """Counts per km^2."""
    km2 = F.col(area_m2) / F.lit(1e6)
    return df.withColumns({f"{c}_per_km2": F.coalesce(F.try_divide(F.col(c).cast("double"), km2), F.lit(0.0)) for c in counts})


def quality_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows, missing values per column (count, percent), duplicate rows beyond the first (count, percent).

    Duplicates come from grouping whole rows: copies collapse on the map side, so a row with a billion copies is no hot group.
    """
    cols = cols or df.columns
    grouped = df.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    total = grouped.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("_n"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("_dup"),
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_copies")).otherwise(0)), F.lit(0)).alias(f"_m{i}")
          for i, c in enumerate(cols)])
    pct = lambda c: F.coalesce(F.try_divide(c.cast("double") * 100.0, F.col("_n").cast("double")), F.lit(0.0))
    entries = [F.struct(F.lit(f"missing:{c}").alias("measure"), F.col(f"_m{i}").alias("count"), pct(F.col(f"_m{i}")).alias("percent"))
               for i, c in enumerate(cols)]
    entries.append(F.struct(F.lit("duplicate_rows").alias("measure"), F.col("_dup").alias("count"), pct(F.col("_dup")).alias("percent")))
    return total.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def finite_rows(df: DataFrame, col: str) -> Column:
    return F.forall(V.as_double(col), V.is_finite)
