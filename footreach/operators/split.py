"""Group-disjoint splits, small-group filters, seeded samples. Randomness is a seeded md5 of the row's own key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.functions import scalars as S
from footreach.operators.skew import rank_by_hash


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return group_counts(df, key).orderBy(F.desc("count"), key).limit(n)


def small_groups(df: DataFrame, key: str = "neighborhood_name", max_points: int = 50, max_groups: int = 3) -> DataFrame:
    """Rows of at most `max_groups` groups below `max_points`, larger ones first; when none is small, of the largest."""
    counts = group_counts(df, key)
    small = counts.filter(F.col("count") < max_points)
    pool = small if not small.isEmpty() else counts
    picked = pool.orderBy(F.desc("count"), key).limit(max_groups).select(key)
    return df.join(F.broadcast(picked), key, "left_semi")


def assign_splits(df: DataFrame, key: str = "neighborhood_name", ratios=(0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """One row per group with its split: seeded order, cut at int(n x ratio), every split non-empty."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {sum(ratios)}")
    groups = df.select(key).distinct()
    n = groups.count()
    if n < 3:
        raise ValueError(f"need at least 3 groups for three splits, got {n}")
    n_train = max(int(n * ratios[0]), 1)
    n_val = max(int(n * ratios[1]), 1)
    if n_train + n_val >= n:
        n_train, n_val = max(1, n - 2), 1
    ranked = rank_by_hash(groups, S.uniform(seed, key), tie=[F.col(key)])
    return ranked.select(key, F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val")
                         .otherwise("test").alias("split"))


def group_split(df: DataFrame, key: str = "neighborhood_name", ratios=(0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Rows with their split; all rows of a group share one."""
    return df.join(assign_splits(df, key, ratios, seed), [key], "left")


def sample_n(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """At most n rows, the first ones in a seeded order. Ranks are counted slice by slice of the order, so n may be of any size."""
    return rank_by_hash(df, S.uniform(seed, *keys), tie=[F.col(k) for k in keys], name="_rank").filter(F.col("_rank") < n).drop("_rank")


def balanced_head(df: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """Half of n from the first group (by its first row), the rest from the second group."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_o")).orderBy("_o").limit(2)
    firsts = [r[0] for r in first.select(key).collect()]
    parts, left = [], n
    for i, g in enumerate(firsts):
        quota = n // 2 if i == 0 else left
        part = df.filter(F.col(key).eqNullSafe(F.lit(g))).orderBy(*order).limit(quota)
        left -= min(quota, part.count()) if i == 0 and len(firsts) > 1 else quota
        parts.append(part)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sample_neighbours(df: DataFrame, ratio: float = 0.8, min_n: int = 3, seed: int = 42, *, key: str = "target_id",
                      scale: float = 1000.0, keep_edge: bool = False) -> DataFrame:
    """Stratified sample inside each star: per distance band keep max(1, int(size x ratio)), top up to `min_n`.

    Bands are [0,.3) [.3,.6) [.6,.9) [.9,1) of the scale; a cell exactly at the scale belongs to none (it does with
    `keep_edge`). Works inside the row on the nested array: no shuffle. Order of the kept neighbours is theirs.
    """
    edges = [0.0, 0.3, 0.6, 0.9, 1.0 + 1e-9 if keep_edge else 1.0]
    n = F.size("neighbor_data")

    def seeded(own):  # as S.uniform orders (key, i), with the key's text made once a row
        return lambda s, i: F.struct(S.drawn(F.concat(own, i.cast("string"), F.lit(f"|{seed}"))).alias("u"), i.alias("i"),
                                     (s["euclidean_distance"].cast("double") / F.lit(float(scale))).alias("d"))

    own = F.coalesce(F.concat(F.col(key).cast("string"), F.lit("|")), F.lit(""))
    marks = F.get(F.transform(F.array(own), lambda own: F.transform("neighbor_data", seeded(own))), F.lit(0))

    def in_band(lo, hi):
        return lambda m: (m["d"] >= lo) & (m["d"] < hi)

    def least(marked, count):  # u and i are never null, so both ways of sorting agree; this one is compiled
        return F.slice(F.sort_array(marked), F.lit(1), count)["i"]

    kept = None
    for lo, hi in zip(edges, edges[1:]):
        band = F.filter(F.col("_marks"), in_band(lo, hi))
        quota = F.when(F.size(band) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.size(band) * F.lit(ratio)).cast("int")))
        part = least(band, quota)
        kept = part if kept is None else F.concat(kept, part)
    out = df.withColumn("_marks", marks).withColumn("_kept", kept)
    short = F.lit(min_n) - F.size("_kept")
    rest = F.filter("_marks", lambda m: ~F.array_contains(F.col("_kept"), m["i"]))
    fill = F.when(short > 0, least(rest, F.greatest(short, F.lit(0)))).otherwise(F.array().cast("array<int>"))  # its quadratic search only where it is needed
    out = out.withColumn("_all", F.sort_array(F.concat("_kept", fill)))
    chosen = F.transform("_all", lambda i: F.get(F.col("neighbor_data"), i))
    return out.withColumn("neighbor_data", F.when(n <= min_n, F.col("neighbor_data")).otherwise(chosen)).withColumn(
        "num_neighbors", F.size("neighbor_data")).drop("_marks", "_kept", "_all")


def pending_runs(specs: DataFrame, done: DataFrame, names: list[str] | None = None, key: str = "name") -> DataFrame:
    """Runs still to do, by priority (missing = 999), then name; optionally only the named ones."""
    todo = specs if names is None else specs.filter(F.col(key).isin(names))
    return todo.join(done.select(key).distinct(), key, "left_anti").withColumn(
        "priority", F.coalesce("priority", F.lit(999))).orderBy("priority", key)
