"""Ranks, running values and joins that keep one hot key out of a single task.

Joins are plain equi joins: adaptive execution measures the shuffled sides and splits the partitions of a hot key, null
keys of a left join and copies of one row included, whatever the size of the tables. What it can't split is a window or
an aggregate over one key, so ranks and running values are built from bounded buckets here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, part: list[str], order: list[Column], bucket: Column, name: str = "row_id",
                start: int = 0) -> DataFrame:
    """Consecutive numbers per `part` in the order (bucket, *order), without one task per part.

    `bucket` must not decrease along `order` (e.g. a lattice column, a slice of time, a slice of a hash): rows are
    counted per bucket, the counts become offsets, and only rows of one bucket are ranked together.
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_bucket", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_offset"))
    keyed = [*part, "_bucket"]
    if part:
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keyed]
    else:
        on = [F.col("l._bucket").eqNullSafe(F.col("r._bucket"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = b.alias("l").join(offsets.alias("r"), cond).select("l.*", "r._offset")
    within = Window.partitionBy(*keyed).orderBy(*order)
    return joined.withColumn(name, F.row_number().over(within) + F.col("_offset") - 1 + F.lit(start)).drop(
        "_bucket", "_offset")


def rank_by_hash(df: DataFrame, u: Column, part: list[str] = (), tie: list[Column] = (), buckets: int = 4096,
                 name: str = "rank") -> DataFrame:
    """Ranks 0, 1, ... in the order of a uniform `u` in [0, 1): the buckets are slices of `u` and so equally full."""
    return number_rows(df.withColumn("_u", u), list(part), [F.col("_u"), *tie],
                       F.floor(F.col("_u") * buckets), name).drop("_u")


def running_last(df: DataFrame, part: list[str], order: list[Column], bucket: Column, cols: list[str]) -> DataFrame:
    """Carry the last non-null value of each column forward, buckets first, then inside a bucket."""
    seq = F.struct(*order)
    b = df.withColumn("_bucket", bucket)
    lasts = b.groupBy(*part, "_bucket").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(f"_last_{c}") for c in cols])
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = lasts.select(*part, "_bucket", *[
        F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_head_{c}") for c in cols])
    within = Window.partitionBy(*part, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = b.join(heads, [*part, "_bucket"], "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_head_{c}")))
    return joined.select(*df.columns)


def running_min(df: DataFrame, part: list[str], order: list[Column], bucket: Column, col: str, name: str) -> DataFrame:
    """Minimum of all earlier rows of the part (null on the first), buckets first, then inside a bucket."""
    b = df.withColumn("_bucket", bucket)
    mins = b.groupBy(*part, "_bucket").agg(F.min(col).alias("_m"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = mins.select(*part, "_bucket", F.min("_m").over(before).alias("_head"))
    within = Window.partitionBy(*part, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(heads, [*part, "_bucket"], "left")
        .withColumn(name, F.least(F.min(col).over(within), F.col("_head")))
        .drop("_bucket", "_head")
    )
