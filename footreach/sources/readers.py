"""Readers. Everything lands as plain columns; nothing is downloaded."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach.functions import scalars as S
from footreach.functions.geometry import RINGS_TYPE
from footreach.operators import runs as R
from footreach.session import inline_table

GEOJSON_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_geojson(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Features as properties (map), geometry_type, x, y (points), line (vertices), rings (polygons, all parts).

    `lines`: newline-delimited features. A FeatureCollection is cut where its features begin (`_feature_mark`), so one large
    file is read by many tasks and a feature on the border of two splits comes once; a collection whose features do not
    begin with their type is read as one record. A missing file raises, an unreadable one raises at the first action (FAILFAST).
    """
    mark = None if lines else _feature_mark(spark, path)
    if mark:
        feats = _marked_features(spark, path, mark)
    else:
        schema = f"type string, features array<{GEOJSON_FEATURE}>" if not lines else (
            "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>")
        raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
        feats = raw if lines else raw.select(F.explode("features").alias("f")).select("f.*")
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")

    def parsed(depth: int):
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    def as_ring(r):
        return F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    def as_part(p):
        """First ring the shell, the others its holes: shells run counter-clockwise and holes clockwise from here on."""
        def turned(r, i):
            twice = F.aggregate(F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
                                           lambda a, b: (a["x"] - r[0]["x"]) * (b["y"] - r[0]["y"]) - (b["x"] - r[0]["x"]) * (a["y"] - r[0]["y"])), F.lit(0.0), lambda t, v: t + v)
            return F.when((twice < 0) == (i > 0), r).otherwise(F.reverse(r))
        return F.transform(F.transform(p, as_ring), turned)

    polygon = F.when(kind == "Polygon", as_part(parsed(3))).when(
        kind == "MultiPolygon", F.flatten(F.transform(parsed(4), as_part)))
    return feats.select(
        "properties", kind.alias("geometry_type"),
        F.when(kind == "Point", F.get(parsed(1), F.lit(0))).alias("x"), F.when(kind == "Point", F.get(parsed(1), F.lit(1))).alias("y"),
        F.when(kind == "LineString", as_ring(parsed(2))).alias("line"), polygon.cast(RINGS_TYPE).alias("rings"))


FEATURE_START = r'^\s*"type"\s*:\s*"Feature"'


def _feature_mark(spark: SparkSession, path) -> str | None:
    """The bytes that every feature of a collection begins with, from the first pieces between braces; none if there is no such beginning."""
    for row in spark.read.option("lineSep", "{").text(path).limit(4).collect():  # pieces end at braces, so a few are a few members
        found = re.match(FEATURE_START, row.value)
        if found:
            return "{" + found[0]
    return None


def _marked_features(spark: SparkSession, path, mark: str) -> DataFrame:
    """type, properties, geometry of the features between marks. In JSON text the quotes of a mark are escaped, so it stands nowhere else."""
    head = F.col("value").rlike(r'(?s)"features"\s*:\s*\[\s*(\].*)?\z')  # what stands before a file's first feature, or a file without any
    rest = spark.read.option("lineSep", mark).text(path).filter(~head)
    parsed = rest.withColumn("f", F.from_json(F.concat(F.lit(mark), F.col("value")), GEOJSON_FEATURE))
    odd = F.col("value").rlike(r'"type"\s*:\s*"Feature"') | F.col("f.type").isNull()
    said = F.raise_error(F.concat(F.lit("not a feature, or features that do not begin alike: "), F.substring("value", 1, 200)))
    return parsed.select(F.when(odd, said).otherwise(F.col("f")).alias("f")).select("f.*")


def with_properties(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.try_element_at("properties", F.lit(n)).alias(n) for n in names], *[c for c in df.columns if c != "properties"])


def read_areas(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return with_properties(read_geojson(spark, path, lines), ["name", "label", "verification_status"])


def read_graphml(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) and edges (src, dst, key, length) of GraphML street networks.

    Key ids mean what their own graph says. A graph is one file, or the folder of parts that `write_graphml` makes, so
    the ids are looked up by the folder above `keys`, `nodes` and `edges`, else by the file.
    """
    def rows(tag, schema):
        read = spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", tag).schema(schema).load(path)
        return read.withColumn("_graph", F.regexp_replace(F.input_file_name(), "/(keys|nodes|edges)/[^/]*$", ""))

    # a map of key ids per graph: as small as the files' headers, and joined, never gathered
    names = rows("key", "`_id` string, `_attr.name` string").select("_graph", F.col("`_attr.name`").alias("_name"), "_id").distinct().groupBy("_graph").agg(
        F.collect_list(F.struct("_name", "_id")).alias("_names"))
    data = "data array<struct<_VALUE:string,_key:string>>"

    def value(name):
        ids = F.transform(F.filter("_names", lambda n: n["_name"] == name), lambda n: n["_id"])
        hit = F.filter("data", lambda d: F.array_contains(ids, d["_key"]))
        return F.get(hit, F.lit(0))["_VALUE"].try_cast("double")

    nodes = rows("node", f"_id string, {data}").join(names, "_graph", "left").select(F.col("_id").cast("bigint").alias("node_id"), value("x").alias("x"), value("y").alias("y"))
    edges = rows("edge", f"_source string, _target string, _id string, {data}").join(names, "_graph", "left").select(
        F.col("_source").cast("bigint").alias("src"), F.col("_target").cast("bigint").alias("dst"),
        F.coalesce(F.col("_id").try_cast("int"), F.lit(0)).alias("key"), value("length").alias("length"))
    return nodes, edges


def load_table(spark: SparkSession, path, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    r = spark.read.schema(schema) if schema else spark.read
    return r.option("header", True).csv(path) if fmt == "csv" else r.parquet(path)


def read_features(spark: SparkSession, root, name: str = "target_points.parquet") -> DataFrame:
    """Every feature file under a tree as one table; raises when there is none."""
    df = (spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
          .option("pathGlobFilter", name if "*" in name else f"{name}*").parquet(root))
    if not df.columns:
        raise FileNotFoundError(f"no {name} under {root}")
    return df


def _lookup(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder, null when it does not exist; asked of the file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for p in paths:
        if _lookup(spark, p) is not None:
            return p
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def read_boundaries(spark: SparkSession, paths: list[str], codes=("CODE_IRIS", "DCOMIRIS", "IRIS"), lines: bool = False) -> DataFrame:
    """Unit boundaries of the first existing file, with `code` from the column its vintage has."""
    df = read_geojson(spark, first_existing(spark, paths), lines)
    code = F.coalesce(*[F.try_element_at("properties", F.lit(c)) for c in codes])
    return df.select(S.norm_code(code).alias("code"), "properties", "rings")


def read_runs(spark: SparkSession, glob, schema=None, lines: bool = True) -> DataFrame:
    """History or metadata JSON files with the file they came from; without `lines` a file is one value or array."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.option("multiLine", not lines).json(glob).withColumn("path", F.input_file_name())


def file_inventory(spark: SparkSession, root, required: list[str]) -> DataFrame:
    """Required files or folders under a root: found, empty or missing. One name-node lookup each, no data is read.

    (The file sources skip files of zero bytes, so a scan could not tell an empty file from a missing one.)
    """
    rows = [(n, _lookup(spark, f"{root}/{n}")) for n in required]
    return inline_table(spark, rows, "name string, length bigint").withColumn("state", F.when(
        F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").otherwise("found"))


def scan_log(spark: SparkSession, path) -> DataFrame:
    """Last value of each result line per file: lines are ordered by their place, the split's start and the line in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    return R.parse_log(lines, order="place")
