"""Street-network operators: iterative relaxation and components as DataFrame loops, plus degree and length measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.constants import MISSING_SERVICE_PENALTY_M, N_CATEGORIES, STREET_RADIUS_M
from footreach.functions import geometry as G
from footreach.functions import vectors as V

from footreach.operators.routing import LEAF, curve_blocks, pair_distances, ranked_blocks
from footreach.operators.spatial import radius_aggregate, snap_to_nodes
from footreach.session import cut_lineage


BLOCK_NODES = 1024
LABELS_PER_GROUP = 64


def _relax_block(key, front: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Least distances inside one block from its frontier: at most BLOCK_NODES nodes and LABELS_PER_GROUP labels."""
    nodes = np.unique(np.concatenate([front["node"].to_numpy(), links["node"].to_numpy(), links["to"].to_numpy()]))
    labels, label_at = np.unique(front["label"].to_numpy(), return_inverse=True)
    dist = np.full((len(nodes), len(labels)), np.inf)
    np.minimum.at(dist, (np.searchsorted(nodes, front["node"].to_numpy()), label_at), front["distance"].to_numpy())
    a, b = np.searchsorted(nodes, links["node"].to_numpy()), np.searchsorted(nodes, links["to"].to_numpy())
    length = links["len"].to_numpy()[:, None]
    while len(a):
        new = dist.copy()
        np.minimum.at(new, b, dist[a] + length)
        if (new == dist).all():
            break
        dist = new
    i, j = np.nonzero(np.isfinite(dist))
    return pd.DataFrame({"node": nodes[i], "label": labels[j], "distance": dist[i, j]})


def shortest_distances(edges: DataFrame, seeds: DataFrame, *, label: str, reverse: bool = False, n_labels: int = 8,
                       blocks: DataFrame | None = None, bound: float | None = None, max_rounds: int = 100_000) -> DataFrame:
    """Least distance from any seed to every node it reaches, for all labels at once: node, label, distance.

    edges(src, dst, length), seeds(node, label, distance), integer nodes and labels. Nodes belong to blocks of at most
    1024 (by id, or a `blocks(node, block)` table: `routing.curve_blocks` for nodes with places). A round finishes every block that holds a frontier
    row for itself, then sends what got better over the links between blocks; so rounds count block crossings, not
    hops, and only improved rows travel. A hub with very many links is no hot group: its links leave its block and go
    through the join. `reverse` walks edges backwards; `bound` drops longer paths for callers that need none.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hop = edges.filter(F.col("src") != F.col("dst")).groupBy(F.col(a).alias("node"), F.col(b).alias("to")).agg(
        F.min("length").cast("double").alias("len"))
    if blocks is None:
        hop = hop.withColumn("block", _block("node")).withColumn("to_block", _block("to"))
    else:
        to = blocks.select(F.col("node").alias("to"), F.col("block").alias("to_block"))
        hop = hop.join(blocks, ["node"], "left").join(to, ["to"], "left").withColumn(
            "block", F.coalesce("block", _block("node"))).withColumn("to_block", F.coalesce("to_block", _block("to")))
    hop = cut_lineage(hop)
    inside = hop.filter(F.col("block") == F.col("to_block")).select("block", "node", "to", "len")
    across = hop.filter(F.col("block") != F.col("to_block")).select("node", "to", "len", "to_block")
    groups = max(1, -(-n_labels // LABELS_PER_GROUP))
    key = ["node", "label"]
    seeded = seeds.select("node", F.col(label).cast("bigint").alias("label"), F.col("distance").cast("double").alias("distance"))
    if blocks is None:
        seeded = seeded.withColumn("block", _block("node"))
    else:
        seeded = seeded.join(blocks, "node", "left").withColumn("block", F.coalesce("block", _block("node")))
    front = cut_lineage(seeded.groupBy("block", *key).agg(F.min("distance").alias("distance")))
    best = front.limit(0)
    for _ in range(max_rounds):
        if front.isEmpty():
            return best.select("node", F.col("label").alias(label), "distance")
        lit_up = front.select("block", F.pmod("label", F.lit(groups)).alias("grp")).distinct()
        local = front.withColumn("grp", F.pmod("label", F.lit(groups))).groupBy("block", "grp").cogroup(
            inside.join(lit_up, "block").groupBy("block", "grp")).applyInPandas(
            lambda k, f, e: _relax_block(k, f, e).assign(block=k[0]), "node bigint, label bigint, distance double, block bigint")
        wave = local if bound is None else local.filter(F.col("distance") <= F.lit(float(bound)))
        moved = cut_lineage(_better(wave, best, key))
        best = cut_lineage(best.unionByName(moved).groupBy("block", *key).agg(F.min("distance").alias("distance")))
        sent = moved.drop("block").join(across, ["node"]).select(
            F.col("to_block").alias("block"), F.col("to").alias("node"), "label", (F.col("distance") + F.col("len")).alias("distance"))
        if bound is not None:
            sent = sent.filter(F.col("distance") <= F.lit(float(bound)))
        front = cut_lineage(_better(sent.groupBy("block", *key).agg(F.min("distance").alias("distance")), best, key))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _block(col: str) -> Column:
    return F.floor(F.col(col) / F.lit(BLOCK_NODES))


def _better(rows: DataFrame, best: DataFrame, key: list[str]) -> DataFrame:
    old = best.select(*key, F.col("distance").alias("_old"))
    return rows.join(old, key, "left").filter(F.col("_old").isNull() | (F.col("distance") < F.col("_old"))).drop("_old")


def path_length(edges: DataFrame, pairs: DataFrame, *, pair_id: str = "pair_id", src: str = "from_node",
                dst: str = "to_node", nodes: DataFrame | None = None, node_id: str = "node_id") -> DataFrame:
    """Shortest directed length of each (from, to) pair; infinity when there is no path or no such node.

    Pairs are answered by hub labels (`routing`): what is shuffled grows with the pairs, not with starts times nodes.
    With `nodes` (node_id, x, y) the labels' blocks follow the map, else the ids.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node").isNotNull()).distinct()
    if nodes is None:
        blocks = ranked_blocks(ends, F.col("node"), LEAF)
    else:
        blocks = curve_blocks(ends.join(nodes.select(F.col(node_id).alias("node"), "x", "y"), "node", "left"), LEAF, node="node")
    asked = pairs.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")).filter("src is not null and dst is not null").distinct()

    def relax(over: DataFrame, seeds: DataFrame) -> DataFrame:
        return shortest_distances(over, seeds, label="label", n_labels=seeds.select("label").distinct().count())

    d = pair_distances(edges, cut_lineage(asked), cut_lineage(blocks), relax)
    return pairs.join(d.withColumnsRenamed({"src": "_s", "dst": "_t", "distance": "_d"}), (F.col(src) == F.col("_s")) & (F.col(dst) == F.col("_t")), "left").withColumn(
        "path_length", F.coalesce(F.col("_d"), F.lit(float("inf")))).drop("_s", "_t", "_d")


def nearest_by_network(targets: DataFrame, services: DataFrame, nodes: DataFrame, edges: DataFrame, *,
                       target_id: str = "target_id", service_id: str = "service_id", category: str = "category",
                       penalty: float = MISSING_SERVICE_PENALTY_M, n: int = N_CATEGORIES) -> DataFrame:
    """Network distance from each target to the nearest service of each category: target_id, distances[n].

    One relaxation from all services against the edge direction serves all targets and categories, in blocks of nodes that
    lie together on the map, so its rounds count crossings of blocks whatever the ids are. No path, no
    service or no network gives the penalty; a found distance above the penalty stands.
    """
    at = snap_to_nodes(targets, nodes, id_col=target_id).select(target_id, F.col("node_id").alias("node"))
    placed = snap_to_nodes(services, nodes, id_col=service_id).select(service_id, F.col("node_id").alias("node"))
    seeds = (
        services.select(service_id, F.col(category).alias("category")).join(placed, service_id)
        .select("node", "category", F.lit(0.0).alias("distance")).distinct()
    )
    where = nodes.select("node_id", G.mercator_x("node_lon").alias("x"), G.mercator_y("node_lat").alias("y"))
    d = shortest_distances(edges, seeds, label="category", reverse=True, n_labels=n, blocks=cut_lineage(curve_blocks(where, BLOCK_NODES)))
    wide = d.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("category", "distance"))).alias("_d"))
    joined = targets.select(target_id).join(at, target_id, "left").join(wide, ["node"], "left")
    slots = [F.coalesce(F.try_element_at("_d", F.lit(i)), F.lit(float(penalty))) for i in range(n)]
    return joined.select(target_id, F.array(*slots).alias("distances"))


def target_probabilities(distances: DataFrame, tau: float = 200.0) -> DataFrame:
    return distances.withColumn("target_prob_vector", V.distance_softmax("distances", tau))


# ---- components ----------------------------------------------------------------------------------

def connected_components(nodes: DataFrame, edges: DataFrame, *, node_id: str = "node_id",
                         max_rounds: int = 200) -> DataFrame:
    """node_id, component (the least node of its weakly connected component), by alternating star contraction.

    The number of rounds grows with the logarithm of the component size, not with its diameter.
    """
    links = cut_lineage(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    now = _digest(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, ["u"]).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, ["u"]).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut_lineage(small.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct())
        links, before, now = new, now, _digest(new)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not end in {max_rounds} rounds")
    root = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(node_id).join(root, F.col(node_id) == F.col("u"), "left").select(
        node_id, F.coalesce("component", node_id).alias("component"))


def _digest(df: DataFrame):
    """Row count and an order-free hash sum: one row to the driver, to see whether anything changed."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_share(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sizes = connected_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"),
                     F.sum("size").alias("nodes")).withColumn(
        "share", F.coalesce(F.try_divide(F.col("largest").cast("double"), F.col("nodes").cast("double")), F.lit(0.0)))


# ---- degrees, lengths, densities -----------------------------------------------------------------

def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree = edges in + edges out (0 for a node without any)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "node_id", "left").fillna(0, ["degree"])


def intersections(nodes: DataFrame, edges: DataFrame, min_degree: int = 3) -> DataFrame:
    return node_degrees(nodes, edges).filter(F.col("degree") >= min_degree)


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("length").alias("mean_length"),
                     F.max("length").alias("max_length"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges")).select("edges")
    return n.withColumn("edges", e.scalar()).withColumn(
        "edges_per_node", F.try_divide(F.col("edges").cast("double"), F.col("nodes").cast("double")))


def edge_centres(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the midpoint of their ends (planar x, y of the nodes) as fx, fy."""
    ends = nodes.select("node_id", "x", "y")
    a = ends.select(F.col("node_id").alias("src"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    b = ends.select(F.col("node_id").alias("dst"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    return edges.join(a, ["src"]).join(b, ["dst"]).withColumn(
        "fx", (F.col("_ax") + F.col("_bx")) / 2).withColumn("fy", (F.col("_ay") + F.col("_by")) / 2).drop(
        "_ax", "_ay", "_bx", "_by")


def intersection_density(points: DataFrame, degrees: DataFrame, r: float = STREET_RADIUS_M) -> DataFrame:
    """Intersections (degree >= 3) per m^2 in the disc; `degrees` has fx, fy, degree."""
    crossing: Column = F.when(F.col("degree") >= 3, 1).otherwise(0)
    out = radius_aggregate(points, degrees, r, {"intersections": crossing})
    return out.withColumn("intersection_density", F.col("intersections") / F.lit(3.141592653589793 * r * r))


def block_length(points: DataFrame, centres: DataFrame, r: float = STREET_RADIUS_M) -> DataFrame:
    """Mean length of the edges whose centre is in the disc, 0 when none."""
    out = radius_aggregate(points, centres, r, {"_len": F.col("length"), "_n": F.lit(1)})
    return out.withColumn("average_block_length", F.coalesce(F.try_divide("_len", "_n"), F.lit(0.0))).drop("_len", "_n")


def pedestrian_ratio(points: DataFrame, pedestrian: DataFrame, centres: DataFrame, r: float = STREET_RADIUS_M) -> DataFrame:
    """Pedestrian features over street edges in the disc (over 1 when there is no street), and a presence flag."""
    walk = radius_aggregate(points, pedestrian, r, {"_ped": F.lit(1)})
    both = radius_aggregate(walk, centres, r, {"_streets": F.lit(1)})
    ratio = F.col("_ped").cast("double") / F.greatest(F.col("_streets"), F.lit(1)).cast("double")
    return both.withColumn("pedestrian_street_ratio", ratio).withColumn(
        "sidewalk_presence", F.when(F.col("_ped") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).drop("_ped", "_streets")
