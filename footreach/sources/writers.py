"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.functions import geometry as G
from footreach.functions import scalars as S
from footreach.operators.checks import status_rollup
from footreach.session import inline_table


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    w = df.write.mode(mode)
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def write_by_category(df: DataFrame, path: str, category: str = "category", keep=("name", "amenity", "x", "y")) -> None:
    """One directory per category, only the columns asked for; rows of one category are spread over several files."""
    df.select(category, *keep).write.mode("overwrite").partitionBy(category).parquet(path)


def read_by_category(df: DataFrame, dim: DataFrame, category: str = "category") -> DataFrame:
    """Counts per category with the empty ones present (right join to the category table)."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("count"))
    return dim.join(counts, category, "left").fillna(0, ["count"])


def write_features(df: DataFrame, path: str, status: str = "status", group: str = "neighborhood_name") -> None:
    """Partitioned by status and area; a rerun replaces only the areas it holds."""
    out = df.withColumn("neighborhood", S.norm_name(group))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(status, "neighborhood").parquet(path)


def write_run_log(df: DataFrame, path: str, counts: list[str]) -> None:
    """Whole log as JSON, and a flat CSV with 0 for counts that are absent."""
    df.write.mode("overwrite").json(f"{path}/log")
    flat = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in df.columns else F.lit(0).alias(c) for c in counts]
    df.select("name", "status", *flat).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def write_check_report(checks: DataFrame, path: str) -> None:
    checks.write.mode("overwrite").json(f"{path}/checks")
    status_rollup(checks, ["entity"]).withColumnRenamed("entity", "name").write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def array_text(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in cols})


def write_predictions(df: DataFrame, path: str, arrays=("predicted_probs", "target_probs")) -> None:
    """CSV with array columns as JSON text."""
    array_text(df, list(arrays)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_evaluation(summary: DataFrame, path: str, split: str) -> None:
    """One JSON object: the split and its metrics."""
    summary.select(F.to_json(F.struct(F.lit(split).alias("split"), *summary.columns)).alias("value")).write.mode("overwrite").text(path)


def geojson_lines(df: DataFrame, properties: list[str], x: str | None = "x", y: str | None = "y", rings: str | None = None) -> DataFrame:
    """One GeoJSON feature per row as text; several parts make a MultiPolygon."""
    if rings:
        coords = F.transform(G.parts(rings), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
        one = F.size(coords) == 1
        kind, text = F.when(one, "Polygon").otherwise("MultiPolygon"), F.when(one, F.to_json(F.get(coords, F.lit(0)))).otherwise(F.to_json(coords))
    else:
        kind, text = F.lit("Point"), F.to_json(F.array(F.col(x), F.col(y)))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":{"type":"'), kind,
                              F.lit('","coordinates":'), text, F.lit("}}")).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str], **kw) -> None:
    geojson_lines(df, properties, **kw).write.mode("overwrite").text(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(node_id, x, y) and edges(src, dst, key, length) as GraphML parts: every file is a whole document."""
    spark = nodes.sparkSession

    def put(df: DataFrame, tag: str) -> None:
        df.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{path}/{tag}s")

    def data(**values):
        return F.array(*[F.struct(F.col(c).cast("string").alias("_VALUE"), F.lit(k).alias("_key")) for k, c in values.items()]).alias("data")

    put(inline_table(spark, [("d1", "node", "x"), ("d2", "node", "y"), ("d3", "edge", "length")], "_id string, _for string, name string")
        .withColumnRenamed("name", "_attr.name"), "key")
    put(nodes.select(F.col("node_id").alias("_id"), data(d1="x", d2="y")), "node")
    put(edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.col("key").alias("_id"), data(d3="length")), "edge")
