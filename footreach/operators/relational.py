"""Filters, column selection, lookups, joins and set operations of the data preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.functions import scalars as S


# ---- rows ----------------------------------------------------------------------------------------


def require_cols(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def compliant(df: DataFrame) -> DataFrame:
    require_cols(df, ["label", "verification_status"])
    return df.filter((F.col("label") == "Compliant") & (F.col("verification_status") == "verified"))


def non_compliant(df: DataFrame) -> DataFrame:
    require_cols(df, ["label"])
    return df.filter(F.col("label") == "Non-Compliant")


def gate(df: DataFrame, cond: Column, status: str = "skipped", passed: str = "ready") -> DataFrame:
    """Keep every row; those that fail the condition (or have it null) get `status`."""
    return df.withColumn("status", F.when(cond, F.lit(passed)).otherwise(F.lit(status)))


def code_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(col).cast("string").startswith(prefix), F.lit(False)))


def in_codes(df: DataFrame, col: str, codes) -> DataFrame:
    """Membership in a short list (pushed to the scan) or in a one-column table (semi join)."""
    if isinstance(codes, DataFrame):
        key = codes.columns[0]
        return df.join(codes.select(F.col(key).alias("_code")).distinct(), F.col(col) == F.col("_code"), "left_semi")
    return df.filter(F.col(col).isin(list(codes)))


def not_in(df: DataFrame, col: str, allowed: DataFrame) -> DataFrame:
    """Distinct values of the column that the allowed table lacks (null counts as a value)."""
    key = allowed.columns[0]
    return df.select(col).distinct().join(
        allowed.select(F.col(key).alias("_ok")), F.col(col) == F.col("_ok"), "left_anti")


def project(df: DataFrame, mapping: dict[str, str], suffix: str = "_right", taken=()) -> DataFrame:
    """Select and rename; a new name that is already taken gets the suffix."""
    return df.select(*[F.col(f"`{a}`").alias(b + suffix if b in taken else b) for a, b in mapping.items()])


def dedupe_names(df: DataFrame, col: str) -> DataFrame:
    return df.select(S.norm_name(col).alias("name_key")).distinct()


def match_names(left: DataFrame, right: DataFrame, *, left_name: str = "name", right_name: str = "other") -> DataFrame:
    """One match per left name: equal after normalising, else either one contains the other; least right name wins.

    Containment goes through an inverted index of three-letter pieces: the longer side stores its pieces (at most three a
    letter), the shorter side asks with its rarest piece only, and what meets is compared as a whole. Rows are linear in
    the names' lengths. An empty name is only equal to an empty name.
    """
    a = left.select(F.col(left_name), S.norm_name(left_name).alias("_a")).distinct()
    b = right.select(F.col(right_name), S.norm_name(right_name).alias("_b")).distinct()

    def pieces(df: DataFrame, col: str, sizes) -> DataFrame:
        n = F.length(col)
        def cut(q):
            return F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(F.col(col), i, F.lit(q)))

        each = [F.when(n >= q, cut(q)).otherwise(F.array()) for q in sizes(n)]
        return df.withColumn("_piece", F.explode(F.array_distinct(F.concat(*each) if len(each) > 1 else each[0])))

    def contained(hay: DataFrame, h: str, needle: DataFrame, n: str) -> DataFrame:
        index = pieces(hay, h, lambda _: (1, 2, 3))
        counts = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
        asked = needle.filter(F.length(n) > 0)
        own = pieces(asked, n, lambda size: (F.least(size, F.lit(3)),)).join(counts, "_piece", "left")
        rarest = own.groupBy(*needle.columns).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("piece"))).alias("_r"))
        asking = rarest.filter("_r.n > 0").select(*needle.columns, F.col("_r.piece").alias("_piece"))  # a piece that no name has: no match
        return index.join(asking, "_piece").filter(F.contains(F.col(h), F.col(n)))

    equal = a.join(b, F.col("_a") == F.col("_b")).select(left_name, right_name, F.lit(0).alias("kind"))
    inside = contained(a, "_a", b, "_b").select(left_name, right_name, F.lit(1).alias("kind"))
    around = contained(b, "_b", a, "_a").select(left_name, right_name, F.lit(1).alias("kind"))
    best = equal.unionByName(inside).unionByName(around).groupBy(left_name).agg(
        F.min(F.struct("kind", right_name)).alias("_m"))
    return best.select(left_name, F.col(f"_m.{right_name}").alias(right_name), F.col("_m.kind").alias("kind"))


# ---- joins ---------------------------------------------------------------------------------------

def join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi join on differently named keys; codes are trimmed text on both sides."""
    r = right.withColumn("_k", S.norm_code(right_key))
    clash = [c for c in right.columns if c in left.columns]
    for c in clash:
        r = r.withColumnRenamed(c, f"{c}_right")
    return left.withColumn("_k", S.norm_code(left_key)).join(r, ["_k"], how).drop("_k")


def add_tables(df: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """Left equi joins of (table, key) one after the other; colliding columns get the suffix _right."""
    return reduce(lambda acc, o: join_on(acc, o[0], key, o[1], "left").drop(
        *( [o[1]] if o[1] != key and o[1] not in acc.columns else [f"{key}_right"])), others, df)


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Left join to a dimension; Spark broadcasts it when its size at run time allows."""
    k = dim_key or key
    d = dim.withColumnRenamed(k, "_dk")
    return df.withColumn("_dk", F.col(key)).join(d, ["_dk"], "left").drop("_dk")


def categorise(df: DataFrame, tag_map: DataFrame, tag_cols=("amenity", "shop", "leisure"), dedupe: bool = False) -> DataFrame:
    """Tag to categories: one output row per matching tag, so an object may come out several times.

    `tag_map(tag, category, category_index)` is the fixed map of 91 rows. With `dedupe`, once per object and category.
    """
    tags = F.array_compact(F.array(*[F.col(c) for c in tag_cols]))
    out = df.withColumn("tag", F.explode(tags)).join(F.broadcast(tag_map), "tag")
    return out.drop("tag").distinct() if dedupe else out


def match_or_mean(points: DataFrame, census: DataFrame, code: str, group: str, features: list[str]) -> DataFrame:
    """Value of the unit the point lies in, else the mean of all units of its group, else 0."""
    units = census.select(S.norm_code(code).alias("_code"), *[S.to_number(c).alias(f"_u_{c}") for c in features])
    means = census.groupBy(F.col(group).alias("_group")).agg(*[F.avg(S.to_number(c)).alias(f"_m_{c}") for c in features])
    out = points.withColumn("_code", S.norm_code(code)).join(units.withColumn("_hit", F.lit(True)), ["_code"], "left")
    out = out.withColumn("_group", F.col(group)).join(means, ["_group"], "left")
    return out.select(*points.columns, *[
        F.when(F.col("_hit"), F.coalesce(F.col(f"_u_{c}"), F.lit(0.0)))
        .otherwise(F.coalesce(F.col(f"_m_{c}"), F.lit(0.0))).alias(c) for c in features])


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return df.join(groups.select(key).distinct(), key, "left_semi")


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")


def with_scalar(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries (no cross join)."""
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


# ---- sets ----------------------------------------------------------------------------------------

def union_features(*dfs: DataFrame) -> DataFrame:
    """Bag union of tables with different columns, nothing removed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_tagged(col: str = "feature_type", **dfs: DataFrame) -> DataFrame:
    return union_features(*[d.withColumn(col, F.lit(tag)) for tag, d in dfs.items()])


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def except_required(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.subtract(present.select(*required.columns))


def first_nonempty(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """`first`, or `fallback` when it has no row: one `limit 1` probe decides at plan time."""
    return fallback if first.isEmpty() else first
