"""Census tables: reading rules, household aggregates and the demographic formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.functions import scalars as S
from footreach.operators import relational as R

# --- fixed values: column names of the census tables, in order of preference ---
POP = "P17_POP1564"
ACTIVE = "P17_ACTOCC15P"
CODE_COLUMNS = ["IRIS", "CODE_IRIS", "DCOMIRIS", "CODEGEO"]
INCOME_COLUMNS = ["DISP_MED17", "DEC_MED17", "DEC_MED14", "MED"]
POVERTY_COLUMNS = ["DISP_TP6017", "DISP_PIMPOT17", "DEC_PIMP17", "DEC_PIMP14", "PIMP", "TP60"]
PERCENT_CAR_COLUMNS = ["PCT_MEN_VOIT", "PCT_MEN_VOIT1", "P17_MEN_VOIT"]
MODE_COLUMNS = {
    "car_commute_ratio": ["C17_ACTOCC15P_VOIT"],
    "walking_ratio": ["C17_ACTOCC15P_PAS", "C17_ACTOCC15P_MAR"],
    "cycling_ratio": ["C17_ACTOCC15P_VELO"],
    "public_transport_ratio": ["C17_ACTOCC15P_TCOM"],
    "two_wheelers_ratio": ["C17_ACTOCC15P_2ROUESMOT"],
}
CHILD_SHARE, ELDERLY_SHARE = 0.47, 0.53


def read_census(df: DataFrame, codes=None, commune_prefix: str = "75", code: str = "IRIS", commune: str = "COM") -> DataFrame:
    """Units of a code list when one is given, else of a commune prefix."""
    if codes is not None:
        return R.in_codes(R.require_cols(df, [code]), code, codes)
    return R.code_prefix(R.require_cols(df, [commune]), commune, commune_prefix)


def commune_population(df: DataFrame, unit: str = "UNIT", stock: str = "STOCD", value: str = "OBS_VALUE") -> DataFrame:
    """The population row (UNIT = POP, STOCD = ENS) as total_population; no row when it is missing or null."""
    picked = df.filter((F.col(unit) == "POP") & (F.col(stock) == "ENS")).select(
        S.to_number(value).alias("total_population")).agg(
        F.first("total_population", ignorenulls=True).alias("total_population"))
    return picked.filter(F.col("total_population").isNotNull())


def car_ownership(households: DataFrame, unit: str = "IRIS", cars: str = "VOIT") -> DataFrame:
    """Households by number of cars per unit, in one pass; code X (unknown) counts as a household."""
    return households.groupBy(unit).agg(
        F.count(F.lit(1)).alias("P17_MEN"),
        F.count_if(F.col(cars).isin("1", "2", "3")).alias("C17_MEN_VOIT"),
        F.count_if(F.col(cars) == "1").alias("C17_MEN_VOIT1"),
        F.count_if(F.col(cars).isin("2", "3")).alias("C17_MEN_VOIT2P"),
    ).withColumn("car_ownership_rate", S.safe_ratio("C17_MEN_VOIT", "P17_MEN"))


def car_ownership_rate(df: DataFrame) -> Column:
    """A ready rate, else counts, else a percentage, else the number of households with a car."""
    def num(c):
        return F.coalesce(S.to_number(c), F.lit(0.0))
    have = set(df.columns)
    if "car_ownership_rate" in have:
        return num("car_ownership_rate")
    total = next((c for c in ["P17_MEN", "P17_LOG"] if c in have), None)
    if "P17_MEN" in have and "C17_MEN_VOIT" in have:
        return S.safe_ratio(num("C17_MEN_VOIT"), num("P17_MEN"))
    counts = [c for c in ["C17_MEN_VOIT1", "C17_MEN_VOIT2P"] if c in have]
    if "P17_MEN" in have and counts:
        return S.safe_ratio(sum((num(c) for c in counts[1:]), num(counts[0])), num("P17_MEN"))
    percent = next((c for c in PERCENT_CAR_COLUMNS if c in have), None)
    if percent and total:
        return num(percent) / F.lit(100.0)
    if "NB_MEN_VOIT" in have and total:
        return S.safe_ratio(num("NB_MEN_VOIT"), num(total))
    return F.lit(None).cast("double")


def working_age_ratio(census: DataFrame, population: DataFrame) -> DataFrame:
    """City-wide working-age people over the commune total: one row, column working_ratio."""
    total = census.agg(F.sum(S.to_number(POP)).alias("_w"))
    return total.select(F.try_divide(F.col("_w"), population.select("total_population").scalar()).alias("working_ratio"))


def demographics(matched: DataFrame, census_all: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    """The 17 demographic features and the car-ownership rate, one row per matched unit.

    The city-wide ratio enters as a scalar subquery; everything else is one projection over the matched units.
    """
    def ratio(candidates, denominator):
        return S.safe_ratio(S.resolve_col(matched, candidates, numeric=True),
                            S.resolve_col(matched, [denominator], numeric=True))

    df = R.with_scalar(matched, working_age_ratio(census_all, population))
    working = F.coalesce(S.to_number(POP), F.lit(0.0))
    df = df.withColumn("_tot", F.try_divide(working, F.col("working_ratio")))
    tot = F.col("_tot")
    area = F.coalesce(
        S.to_number("iris_area_m2") if "iris_area_m2" in matched.columns else F.lit(None).cast("double"),
        S.to_number("area_m2") if "area_m2" in matched.columns else F.lit(None).cast("double"))
    status = sum((F.coalesce(S.resolve_col(matched, [f"C17_ACT1564_CS{i}"], numeric=True), F.lit(0.0)) for i in (2, 3)),
                 F.coalesce(S.resolve_col(matched, ["C17_ACT1564_CS1"], numeric=True), F.lit(0.0)))
    elderly = F.lit(ELDERLY_SHARE) * (tot - working)
    retired = F.coalesce(S.resolve_col(matched, ["P17_RETR1564"], numeric=True), F.lit(0.0))
    known = tot.isNotNull()
    out = {
        "population_density": F.try_divide(tot, area / F.lit(1e6)),
        "ses_index": S.safe_ratio(status, S.resolve_col(matched, ["C17_ACT1564"], numeric=True)),
        "car_commute_ratio": ratio(MODE_COLUMNS["car_commute_ratio"], ACTIVE),
        "children_per_capita": F.when(known, S.safe_ratio(F.lit(CHILD_SHARE) * (tot - working), tot)),
        "elderly_ratio": F.when(known, S.safe_ratio(elderly, tot)),
        "unemployment_rate": ratio(["P17_CHOM1564"], "P17_ACT1564"),
        "student_ratio": F.when(known, S.safe_ratio(S.resolve_col(matched, ["P17_ETUD1564"], numeric=True), tot)),
        "walking_ratio": ratio(MODE_COLUMNS["walking_ratio"], ACTIVE),
        "cycling_ratio": ratio(MODE_COLUMNS["cycling_ratio"], ACTIVE),
        "public_transport_ratio": ratio(MODE_COLUMNS["public_transport_ratio"], ACTIVE),
        "two_wheelers_ratio": ratio(MODE_COLUMNS["two_wheelers_ratio"], ACTIVE),
        "retired_ratio": F.when(known, S.safe_ratio(retired + elderly, tot)),
        "permanent_employment_ratio": ratio(["P17_SAL15P_CDI"], "P17_SAL15P"),
        "temporary_employment_ratio": ratio(["P17_SAL15P_CDD"], "P17_SAL15P"),
        "median_income": S.resolve_col(matched, INCOME_COLUMNS, numeric=True),
        "poverty_rate": S.resolve_col(matched, POVERTY_COLUMNS, numeric=True),
        "working_age_ratio": F.when(known, S.safe_ratio(working, tot)),
        "car_ownership_rate": car_ownership_rate(matched),
    }
    return df.select(*keys, *[e.alias(n) for n, e in out.items()])


def group_means(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Mean of each numeric column per group: the fallback row for points outside every unit."""
    return df.groupBy(key).agg(*[F.avg(S.to_number(c)).alias(c) for c in features])


def null_census(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Non-null numeric values per column, for the columns whose name holds a keyword of a group; one scan."""
    picked = [(g, c) for g, words in groups.items() for c in S.cols_like(df, words, "contains")]
    if not picked:
        return df.sparkSession.createDataFrame([], "keyword_group string, column_name string, non_null bigint")
    cols = list(dict.fromkeys(c for _, c in picked))
    one = df.agg(*[F.count(S.to_number(F.col(f"`{c}`").cast("string"))).alias(f"_c{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(g).alias("keyword_group"), F.lit(c).alias("column_name"),
                                 F.col(f"_c{cols.index(c)}").alias("non_null")) for g, c in picked])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def column_coverage(df: DataFrame, expected: list[str]) -> DataFrame:
    """Each expected column, whether it is there, and how many values it holds."""
    here = [c for c in expected if c in df.columns]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(here)], F.count(F.lit(1)).alias("_n"))
    entries = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit("found" if c in here else "missing").alias("state"),
        (F.col(f"_c{here.index(c)}") if c in here else F.lit(0).cast("long")).alias("non_null")) for c in expected])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def check_units(df: DataFrame, code: str, feature: str) -> DataFrame:
    """Unit-level check: code there, more than one row, codes unique, feature varies."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(S.norm_code(code)).alias("codes"),
        F.min(S.to_number(feature)).alias("_lo"), F.max(S.to_number(feature)).alias("_hi"),
    ).select("rows", "codes", (F.col("rows") > 1).alias("unit_level"), (F.col("rows") == F.col("codes")).alias("unique_codes"),
             F.coalesce(F.col("_hi") > F.col("_lo"), F.lit(False)).alias("varies"))
