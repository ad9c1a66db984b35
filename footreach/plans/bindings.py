"""The test tables seen as areas, points of interest, streets, census units, predictions and histories.

Each role is a projection (or one aggregate) of a given table, written once as SQL text that Spark and DuckDB read
alike, so both sides of a check start from the same rows. Places follow a low-discrepancy sequence over a fixed
window: distinct for every key, evenly spread, denser as the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach.constants import CATEGORY_TAGS
from footreach.functions import geometry as G
from footreach.functions import vectors as V
from footreach.session import ensure_checkpoint_dir

LON0, LAT0, LON_SPAN, LAT_SPAN = 2.2, 48.8, 0.2, 0.1


def place(key: str, shift: float = 0.0) -> tuple[str, str]:
    """lon and lat of a key as SQL text."""
    a = f"({key} * 0.7548776662466927e0 + {shift}e0)"
    b = f"({key} * 0.5698402909980532e0 + {shift}e0)"
    return f"2.2e0 + 0.2e0 * ({a} - floor({a}))", f"48.8e0 + 0.1e0 * ({b} - floor({b}))"


_T, _S, _B, _N = place("c_custkey"), place("p_partkey", 0.37), place("o_orderkey", 0.11), place("s_suppkey", 0.73)
TAGS = [t for tags in CATEGORY_TAGS.values() for t in tags]

# role -> (table, select list)
ROLES: dict[str, tuple[str, list[str]]] = {
    "areas": ("nation", [
        "n_nationkey AS area_id", "replace(n_name, '_', ' ') AS name",
        "CASE WHEN n_nationkey % 3 = 0 THEN 'Compliant' ELSE 'Non-Compliant' END AS label",
        "CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'verified' ELSE 'pending' END END AS verification_status",
        "2.2e0 + 0.04e0 * (n_nationkey % 5) AS x0", "48.8e0 + 0.02e0 * floor(n_nationkey / 5) AS y0",
        "2.2e0 + 0.04e0 * (n_nationkey % 5 + 1) AS x1", "48.8e0 + 0.02e0 * (floor(n_nationkey / 5) + 1) AS y1",
    ]),
    "targets": ("customer", ["c_custkey AS target_id", "c_nationkey AS home", "c_name AS name", f"{_T[0]} AS lon", f"{_T[1]} AS lat",
                             "c_acctbal AS balance", "c_mktsegment AS segment"]),
    "services": ("part", ["p_partkey AS service_id", "p_name AS name", "p_type AS kind", "p_size AS size", f"{_S[0]} AS lon", f"{_S[1]} AS lat",
                          "CAST((length(p_type) + p_size) % 8 AS int) AS category_index"]),
    "buildings": ("orders", [
        "o_orderkey AS building_id", f"{_B[0]} AS lon", f"{_B[1]} AS lat", "0.00005e0 + 0.00001e0 * (o_orderkey % 7) AS half",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'x' ELSE CAST(o_orderkey % 14 AS string) END AS levels",
        "o_totalprice AS area_m2", "o_custkey AS owner"]),
    "nodes": ("supplier", ["s_suppkey AS node_id", f"{_N[0]} AS lon", f"{_N[1]} AS lat", "s_nationkey AS home", "s_acctbal AS balance"]),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def role(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tab, exprs = ROLES[name]
    return table(spark, sf, tab).selectExpr(*exprs)


def areas(spark, sf) -> DataFrame:
    return role(spark, sf, "areas").withColumn("rings", G.box("x0", "y0", "x1", "y1"))


def _planar(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn(x, G.mercator_x("lon")).withColumn(y, G.mercator_y("lat"))


def targets(spark, sf) -> DataFrame:
    return _planar(role(spark, sf, "targets"), "x", "y")


def services(spark, sf) -> DataFrame:
    return _planar(role(spark, sf, "services"), "fx", "fy")


def tag_expr(sql: bool, key: str, step: int) -> str:
    """An element of the tag list picked by a key, in either dialect."""
    items = ", ".join(f"'{t}'" for t in TAGS)
    i = f"CAST(({key}) * {step} % {len(TAGS)} AS int) + 1"
    return f"([{items}])[{i}]" if sql else f"element_at(array({items}), {i})"


def tagged_exprs(sql: bool) -> list[str]:
    return ["p_partkey AS service_id", f"{tag_expr(sql, 'p_partkey', 7)} AS amenity",
            f"CASE WHEN p_size % 3 = 0 THEN {tag_expr(sql, 'p_size', 5)} END AS shop",
            "CASE WHEN p_size % 11 = 0 THEN 'park' END AS leisure", f"{_S[0]} AS lon", f"{_S[1]} AS lat"]


def tagged(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*tagged_exprs(False))


def buildings(spark, sf) -> DataFrame:
    """Square footprints in degrees (rings) and in metres (mrings)."""
    return role(spark, sf, "buildings").withColumn("rings", G.box("lon - half", "lat - half", "lon + half", "lat + half")).withColumn("mrings", G.rings_to_mercator("rings"))


def nodes(spark, sf) -> DataFrame:
    return _planar(role(spark, sf, "nodes"), "x", "y")


EDGES_SQL = """
SELECT s_suppkey AS src, CAST(s_suppkey + 1 AS bigint) AS dst, 50e0 + (s_suppkey * 13) % 400 AS length
FROM supplier WHERE s_suppkey + 1 < (SELECT count(*) FROM supplier) AND s_acctbal > 0
UNION ALL
SELECT s_suppkey, CAST((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS bigint), 80e0 + (s_suppkey * 29) % 700
FROM supplier WHERE s_acctbal > 3000
"""


def edges(spark, sf) -> DataFrame:
    """Directed edges between suppliers; those with a low balance send none, so the graph falls into components."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    n = s.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    k = F.col("s_suppkey")
    step = s.filter((k + 1 < n) & (F.col("s_acctbal") > 0)).select(
        k.alias("src"), (k + 1).alias("dst"), (F.lit(50.0) + (k * 13) % 400).alias("length"))
    jump = s.filter(F.col("s_acctbal") > 3000).select(
        k.alias("src"), ((k * 7 + 3) % n).alias("dst"), (F.lit(80.0) + (k * 29) % 700).alias("length"))
    return step.unionByName(jump)


# ---- census --------------------------------------------------------------------------------------

_Q = "l_quantity"
UNIT_MEASURES = {
    "P17_POP1564": f"sum({_Q})",
    "P17_ACTOCC15P": f"sum(CASE WHEN l_linestatus = 'O' THEN {_Q} ELSE {_Q} / 2 END)",
    "C17_ACTOCC15P_VOIT": f"sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN {_Q} ELSE 0e0 END)",
    "C17_ACTOCC15P_PAS": f"sum(CASE WHEN l_returnflag = 'N' AND l_discount < 0.05e0 THEN {_Q} ELSE 0e0 END)",
    "C17_ACTOCC15P_VELO": f"sum(CASE WHEN l_returnflag = 'N' AND l_discount >= 0.05e0 THEN {_Q} / 4 ELSE 0e0 END)",
    "C17_ACTOCC15P_TCOM": f"sum(CASE WHEN l_returnflag = 'R' THEN {_Q} ELSE 0e0 END)",
    "C17_ACTOCC15P_2ROUESMOT": f"sum(CASE WHEN l_returnflag = 'R' AND l_tax > 0.06e0 THEN {_Q} / 8 ELSE 0e0 END)",
    "C17_ACT1564": f"sum({_Q} * 0.8e0)",
    "C17_ACT1564_CS1": f"sum(CASE WHEN l_linenumber = 1 THEN {_Q} / 8 ELSE 0e0 END)",
    "C17_ACT1564_CS2": f"sum(CASE WHEN l_linenumber = 2 THEN {_Q} / 4 ELSE 0e0 END)",
    "C17_ACT1564_CS3": f"sum(CASE WHEN l_linenumber = 3 THEN {_Q} ELSE 0e0 END)",
    "P17_ACT1564": f"sum({_Q} * 0.75e0)",
    "P17_CHOM1564": f"sum(CASE WHEN l_linenumber = 4 THEN {_Q} / 2 ELSE 0e0 END)",
    "P17_ETUD1564": f"sum(CASE WHEN l_linenumber = 5 THEN {_Q} / 2 ELSE 0e0 END)",
    "P17_RETR1564": f"sum(CASE WHEN l_linenumber = 6 THEN {_Q} / 8 ELSE 0e0 END)",
    "P17_SAL15P": f"sum({_Q} * 0.7e0)",
    "P17_SAL15P_CDI": f"sum({_Q} * 0.55e0)",
    "P17_SAL15P_CDD": f"sum(CASE WHEN l_linestatus = 'F' THEN {_Q} * 0.1e0 ELSE 0e0 END)",
    "DISP_MED17": "avg(l_extendedprice)",
    "DISP_TP6017": "avg(l_discount) * 100e0",
    "iris_area_m2": "1e6 + max(l_suppkey % 50) * 2e4",
}
UNIT_KEYS = ["lpad(CAST(l_suppkey AS string), 9, '0') AS IRIS",
             "CASE WHEN l_suppkey % 5 = 0 THEN '93001' ELSE '75056' END AS COM"]
UNITS_SQL = (f"SELECT {', '.join(UNIT_KEYS)}, " + ", ".join(f"{e} AS {n}" for n, e in UNIT_MEASURES.items())
             + " FROM lineitem GROUP BY l_suppkey")


def units(spark, sf) -> DataFrame:
    """Census units as they land: codes and counts, all text but the area."""
    agg = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.expr(e).alias(n) for n, e in UNIT_MEASURES.items()])
    return agg.selectExpr(*UNIT_KEYS, *[f"CAST({n} AS string) AS {n}" for n in UNIT_MEASURES if n != "iris_area_m2"], "iris_area_m2")


HOUSEHOLDS_SQL = """
SELECT lpad(CAST(c_nationkey AS string), 4, '0') AS IRIS, '75056' AS COMMUNE,
  CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'X' WHEN '4' THEN '0' ELSE substr(o_orderpriority, 1, 1) END AS VOIT
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def households(spark, sf) -> DataFrame:
    """One row per order, unit = nation of the customer, cars = first digit of the priority (5 = unknown)."""
    first = F.substring("o_orderpriority", 1, 1)
    o = table(spark, sf, "orders").select("o_custkey", first.alias("d"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey").select(
        F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("IRIS"), F.lit("75056").alias("COMMUNE"),
        F.when(F.col("d") == "5", "X").when(F.col("d") == "4", "0").otherwise(F.col("d")).alias("VOIT"))


UNIT_BOXES_SQL = """
SELECT lpad(CAST(s_suppkey AS string), 9, '0') AS code, s_nationkey AS home, {lon} - 0.004e0 AS x0, {lat} - 0.002e0 AS y0,
  {lon} + 0.004e0 AS x1, {lat} + 0.002e0 AS y1 FROM supplier
""".format(lon=_N[0], lat=_N[1])


def unit_boxes(spark, sf) -> DataFrame:
    s = role(spark, sf, "nodes")
    return s.select(F.lpad(F.col("node_id").cast("string"), 9, "0").alias("code"), "home",
                    G.box("lon - 0.004D", "lat - 0.002D", "lon + 0.004D", "lat + 0.002D").alias("rings"))


# ---- predictions and histories -------------------------------------------------------------------

def logits_of(lo: int, scale: float):
    return F.transform(F.slice("embedding", lo, 8), lambda x: x.cast("double") * F.lit(scale))


def predictions(spark, sf) -> DataFrame:
    """Embeddings as predictions: elements 1-8 are logits, 9-16 the target's; label is the area."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("target_id"), F.concat(F.lit("area_"), F.col("label").cast("string")).alias("neighborhood_name"),
        logits_of(1, 8.0).alias("logits"), logits_of(9, 8.0).alias("target_logits")).select(
        "target_id", "neighborhood_name", "logits", V.softmax("logits").alias("predicted_probs"), V.softmax("target_logits").alias("target_probs"))


def sql_softmax(v: str) -> str:
    """Softmax of a list column in the SQL of the checks."""
    e = f"list_transform({v}, lambda x: exp(x - list_max({v})))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


PREDICTIONS_SQL = f"""
SELECT vec_id AS target_id, 'area_' || label AS neighborhood_name, logits, {sql_softmax('logits')} AS predicted_probs,
  {sql_softmax('target_logits')} AS target_probs
FROM (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: x::DOUBLE * 8) AS logits,
  list_transform(embedding[9:16], lambda x: x::DOUBLE * 8) AS target_logits FROM embeddings)
"""

HISTORY_SQL = """
SELECT user_id AS run, event_id AS epoch, value AS val_loss,
  CASE WHEN event_type = 'purchase' THEN value / 10 END AS val_kl_divergence,
  CASE WHEN event_type = 'click' THEN value / 1000 END AS val_top1_accuracy, event_type, ts FROM events
"""


def history(spark, sf) -> DataFrame:
    """Events as run histories: a user is a run, the event number its epoch, the value the loss of that epoch."""
    return table(spark, sf, "events").selectExpr(
        "user_id AS run", "event_id AS epoch", "value AS val_loss", "CASE WHEN event_type = 'purchase' THEN value / 10 END AS val_kl_divergence",
        "CASE WHEN event_type = 'click' THEN value / 1000 END AS val_top1_accuracy", "event_type", "ts")


# ---- SQL side ------------------------------------------------------------------------------------

def mx(lon: str) -> str:
    return f"(radians({lon}) * 6378137e0)"


def my(lat: str) -> str:
    return f"(ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137e0)"


def views() -> dict[str, str]:
    out = {n: f"SELECT {', '.join(e)} FROM {t}" for n, (t, e) in ROLES.items()}
    out["targets"] = f"SELECT *, {mx('lon')} AS x, {my('lat')} AS y FROM ({out['targets']})"
    out["services"] = f"SELECT *, {mx('lon')} AS fx, {my('lat')} AS fy FROM ({out['services']})"
    out["nodes"] = f"SELECT *, {mx('lon')} AS x, {my('lat')} AS y FROM ({out['nodes']})"
    out["tagged"] = f"SELECT {', '.join(tagged_exprs(True))} FROM part"
    out["edges"], out["units"], out["households"] = EDGES_SQL, UNITS_SQL, HOUSEHOLDS_SQL
    out["unit_boxes"], out["preds"], out["history"] = UNIT_BOXES_SQL, PREDICTIONS_SQL, HISTORY_SQL
    rows = ", ".join(f"('{t}', '{c}', {i})" for i, (c, ts) in enumerate(CATEGORY_TAGS.items()) for t in ts)
    out["tag_map"] = f"SELECT * FROM (VALUES {rows}) v(tag, category, category_index)"
    cats = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORY_TAGS))
    out["categories"] = f"SELECT * FROM (VALUES {cats}) v(category_index, category)"
    return out


def sql(uses: str, body: str, recursive: bool = False) -> str:
    """Body with the named views in front as common table expressions; body may start with `, more AS (...)`."""
    v = views()
    ctes = ", ".join(f"{n} AS ({v[n]})" for n in uses.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}" if ctes else body


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints (the shared folder on a cluster) for round trips through files."""
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
