"""Exact quantiles and histograms that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach.functions.scalars import row_bytes
from footreach.session import cut_lineage


def _sliced(vals: DataFrame, by: list[str]) -> DataFrame:
    """by..., _v, _n, _b: distinct values with their counts in slices that rise with the value.

    Range partitioning on (by, value) is the slicing: equal keys stay together, a large group is spread over many
    partitions, a partition's number is the slice. Written once, so that counts and picks see the same slices.
    """
    uniq = vals.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(uniq.repartitionByRange(*by, "_v").withColumn("_b", F.spark_partition_id()))


def _slices(uniq: DataFrame, by: list[str]) -> DataFrame:
    """by..., _b, _bn rows in the slice, _before rows of the group in earlier slices; a group has at most as many rows here as there are partitions."""
    order = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return uniq.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn")).withColumn("_before", F.coalesce(F.sum("_bn").over(order), F.lit(0)))


def _same(by: list[str], *more: str) -> Column:
    """Join condition of `l` and `r` on the group (a null group is a group) and further columns."""
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    for c in more:
        cond = cond & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return cond


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: by..., prob, value.

    Equal values collapse first and are sliced by range. The slice counts say which slices hold the wanted ranks, and
    only those slices are ranked, each by itself.
    """
    by = list(by)
    vals = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    uniq = _sliced(vals, by)
    slices = _slices(uniq, by).withColumn("_total", F.sum("_bn").over(Window.partitionBy(*by)))
    want = slices.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_pos", F.col("prob") * (F.col("_total") - 1).cast("double"))
    ends = cut_lineage(want.withColumn("_rank", F.explode(F.array(F.floor("_pos"), F.ceil("_pos")))).distinct().filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bn"))))
    inside = Window.partitionBy(*by, "_b").orderBy("_v")
    needed = uniq.alias("l").join(ends.select(*by, "_b").distinct().alias("r"), _same(by, "_b"), "left_semi").withColumn(
        "_upto", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    picked = ends.alias("l").join(needed.alias("r"), _same(by, "_b")).filter(
        (F.col("_before") + F.col("_upto") > F.col("_rank")) & (F.col("_before") + F.col("_upto") - F.col("_n") <= F.col("_rank"))).select(
        "l.*", "r._v")
    low = F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v")))
    high = F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v")))
    part = F.max("_pos") - F.floor(F.max("_pos"))
    return picked.groupBy(*by, "prob").agg((low + (high - low) * part).alias("value"))


def ranks(df: DataFrame, col: str, by: list[str] = (), ascending: bool = True) -> DataFrame:
    """Add rank_min (1 + rows strictly before) and rank_avg (mean rank of the tie) without a one-task window.

    Same slices as `quantiles`: ranks are counted over distinct values, slice by slice, and joined back by value. Rows
    without a value have no rank.
    """
    by = list(by)
    sign = 1.0 if ascending else -1.0
    vals = df.withColumn("_v", F.col(col).cast("double") * F.lit(sign))
    uniq = _sliced(vals.filter(F.col("_v").isNotNull()).select(*by, "_v"), by)
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = uniq.alias("l").join(_slices(uniq, by).alias("r"), _same(by, "_b")).select("l.*", "r._before").withColumn(
        "rank_min", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1).withColumn(
        "rank_avg", F.col("rank_min") + (F.col("_n") - 1) / 2.0).select(*by, "_v", "rank_min", "rank_avg")
    return vals.alias("l").join(ranked.alias("r"), _same(by, "_v"), "left").select("l.*", "r.rank_min", "r.rank_avg").drop("_v")


def box_plot(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """q1, median, q3 in one row per group."""
    q = quantiles(df, col, [0.25, 0.5, 0.75], by)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width bins: bin, lo, hi, count, empty bins included; the last bin takes its upper edge."""
    vals = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ends = vals.agg(F.min("_v").alias("a"), F.max("_v").alias("b"))
    a = F.lit(float(lo)) if lo is not None else ends.select("a").scalar()
    b = F.lit(float(hi)) if hi is not None else ends.select("b").scalar()
    spread = df.sparkSession.range(1).select(a.alias("a"), b.alias("b")).select(
        "a", F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a") + 1.0).alias("b"))
    edges = spread.select("a", ((F.col("b") - F.col("a")) / bins).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = spread.select(((F.col("b") - F.col("a")) / bins).alias("w")).scalar()
    counted = vals.withColumn("_a", a).filter(F.col("_v") >= F.col("_a")).withColumn("_w", width).withColumn(
        "bin", F.least(F.floor((F.col("_v") - F.col("_a")) / F.col("_w")), F.lit(bins - 1)).cast("int")).filter(
        F.col("_v") <= b).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return edges.join(counted, "bin", "left").select(
        "bin", (F.col("a") + F.col("w") * F.col("bin")).alias("lo"), (F.col("a") + F.col("w") * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"))


def dataset_summary(df: DataFrame, group: str = "neighborhood_name", count_col: str = "num_neighbors") -> DataFrame:
    """Rows, groups, min / max / mean / median / sample std of the counts, zero counts, estimated bytes per row."""
    c = F.col(count_col)
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
                  F.stddev_samp(c).alias("std"), F.count_if(c == 0).alias("zero_count"))
    groups = df.select(group).distinct().agg(F.count(group).alias("g")).select("g")
    median = quantiles(df, count_col, [0.5]).select("value")
    return base.withColumn("groups", groups.scalar()).withColumn("median", median.scalar()).withColumn(
        "estimated_bytes", F.floor(row_bytes(F.col("mean"))))


def neighbour_stats(df: DataFrame, count_col: str = "num_neighbors") -> DataFrame:
    """Mean, median and population std of the neighbour counts."""
    c = F.col(count_col)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_pop"),
                  F.min(c).alias("min"), F.max(c).alias("max")).withColumn(
        "median", quantiles(df, count_col, [0.5]).select("value").scalar())
