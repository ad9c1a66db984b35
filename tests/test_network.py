import heapq
import math
import random

import pytest
from footreach.operators import network as N
from footreach.operators import routing as R
from pyspark.sql import functions as F

EDGES = "src bigint, dst bigint, length double"


def dijkstra(edges, sources):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
    best, heap = {}, [(0.0, s) for s in sources]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in adj.get(u, []):
            if v not in best:
                heapq.heappush(heap, (d + w, v))
    return best


@pytest.fixture(scope="module")
def graph():
    """Spread over several blocks, with a hub, parallel edges, loops and parts that cannot be reached."""
    rnd = random.Random(5)
    ids = [i * 97 for i in range(150)]
    e = [(a, rnd.choice(ids), rnd.uniform(10, 500)) for a in ids for _ in range(2)]
    e += [(ids[0], b, 900.0) for b in ids[:60]] + [(ids[1], ids[2], 5.0), (ids[1], ids[2], 3.0), (ids[3], ids[3], 1.0)]
    e += [(ids[-1] + 97 * k, ids[-1] + 97 * (k + 1), 1.0) for k in range(30, 40)]
    return ids, e


def test_relaxation_equals_dijkstra(spark, graph):
    ids, e = graph
    seeds = spark.createDataFrame([(ids[4], 0, 0.0), (ids[9], 0, 0.0), (ids[20], 1, 0.0)], "node bigint, label bigint, distance double")
    for reverse in (False, True):
        got = {}
        for r in N.shortest_distances(spark.createDataFrame(e, EDGES), seeds, label="label", reverse=reverse).collect():
            got.setdefault(r.label, {})[r.node] = r.distance
        ee = [(b, a, w) for a, b, w in e] if reverse else e
        for label, src in ((0, [ids[4], ids[9]]), (1, [ids[20]])):
            want = dijkstra(ee, src)
            assert set(got[label]) == set(want)
            assert all(got[label][k] == pytest.approx(v) for k, v in want.items())
    edges = spark.createDataFrame(e, EDGES)
    near = N.shortest_distances(edges, seeds, label="label", bound=400.0).collect()
    assert max(r.distance for r in near) <= 400
    tiles = spark.createDataFrame([(i, (i // 97) % 4) for i in ids], "node bigint, block bigint")
    by_tile = N.shortest_distances(edges, seeds, label="label", blocks=tiles).count()
    assert by_tile == sum(len(v) for v in (dijkstra(e, [ids[4], ids[9]]), dijkstra(e, [ids[20]])))


def test_path_length(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 150.0), (1, 3, 200.0)], EDGES)
    pairs = spark.createDataFrame([(0, 1, 3), (1, 3, 1), (2, 1, 1), (3, 1, 77), (4, None, 2)], "pair_id int, from_node bigint, to_node bigint")
    got = {r.pair_id: r.path_length for r in N.path_length(edges, pairs).collect()}
    assert got == {0: 200.0, 1: math.inf, 2: 0.0, 3: math.inf, 4: math.inf}
    empty = N.path_length(edges.limit(0), pairs)
    assert {r.path_length for r in empty.collect()} == {math.inf}


@pytest.mark.parametrize("hubs", [2048, 30])
def test_hub_labels_equal_dijkstra(spark, graph, monkeypatch, hubs):
    """Several levels of cells; with few hubs allowed the hierarchy ends early and the border graph is relaxed."""
    monkeypatch.setattr(N, "LEAF", 12)
    monkeypatch.setattr(R, "HUBS", hubs)
    monkeypatch.setattr(R, "BATCH", 7)
    ids, e = graph
    rnd = random.Random(3)
    some = sorted({v for x in e for v in x[:2]}) + [123456789]
    asked = [(k, rnd.choice(some), rnd.choice(some)) for k in range(400)]
    pairs = spark.createDataFrame(asked, "pair_id int, from_node bigint, to_node bigint")
    places = spark.createDataFrame([(v, float(i % 13), float(i // 13)) for i, v in enumerate(some[:-1])], "node_id bigint, x double, y double")
    near = {v: dijkstra(e, [v]) for v in {a for _, a, _ in asked}}
    for nodes in (None, places):
        got = {r.pair_id: r.path_length for r in N.path_length(spark.createDataFrame(e, EDGES), pairs, nodes=nodes).collect()}
        assert got == pytest.approx({k: near[a].get(b, math.inf) if a in some[:-1] else math.inf for k, a, b in asked})


def test_pairs_of_a_graph_without_borders_are_searched_from_both_ends(spark, monkeypatch):
    """Edges lead anywhere, so no hierarchy closes: what is written stays far below starts times nodes."""
    monkeypatch.setattr(N, "LEAF", 16)
    monkeypatch.setattr(R, "HUBS", 100)
    rnd, n = random.Random(8), 600
    e = [(a, rnd.randrange(n), float(rnd.randint(50, 500))) for a in range(n) for _ in range(2) if a % 10]
    e += [(n, n + 1, 10.0), (n, n + 1, 30.0), (n + 1, 0, 20.0), (5, 5, 1.0)]
    asked = [(a, a, (3 * a + 1) % n) for a in range(n)] + [(n, n, 77), (n + 1, n, 77), (n + 2, 77, n), (n + 3, 4, 4), (n + 4, n + 9, n + 9), (n + 5, n, n + 1)]
    most, real = [0], R.cut_lineage

    def cut(df):
        out = real(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(R, "cut_lineage", cut)
    monkeypatch.setattr(N, "cut_lineage", cut)
    got = {r.pair_id: r.path_length for r in N.path_length(spark.createDataFrame(e, EDGES), spark.createDataFrame(asked, "pair_id int, from_node bigint, to_node bigint")).collect()}
    near = {a: dijkstra(e, [a]) for _, a, _ in asked}
    assert got == {k: near[a].get(b, math.inf) if a != n + 9 else math.inf for k, a, b in asked}
    assert most[0] < n * n / 4


def test_blocks_follow_the_map_not_the_ids(spark, monkeypatch):
    """A grid of streets with shuffled ids: blocks are full, compact, and rounds count their crossings, not hops."""
    side = 40
    rnd = random.Random(4)
    names = list(range(10_000, 10_000 + 1000 * side * side, 1000))
    rnd.shuffle(names)
    place = {(i, j): names[i * side + j] for i in range(side) for j in range(side)}
    e = [(place[i, j], place[i + di, j + dj], 1.0) for i in range(side) for j in range(side) for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + di, j + dj) in place]
    nodes = spark.createDataFrame([(v, float(i), float(j)) for (i, j), v in place.items()], "node_id bigint, x double, y double")
    blocks = R.cut_lineage(R.curve_blocks(nodes, 100))
    of = {r.node: r.block for r in blocks.collect()}
    sizes = {}
    for b in of.values():
        sizes[b] = sizes.get(b, 0) + 1
    assert len(of) == side * side and set(sizes.values()) == {100}
    crossings = sum(of[a] != of[b] for a, b, _ in e)
    assert crossings < 0.3 * len(e)
    rounds = []
    real = N._better
    monkeypatch.setattr(N, "_better", lambda *a: rounds.append(1) or real(*a))
    seeds = spark.createDataFrame([(place[0, 0], 0, 0.0)], "node bigint, label bigint, distance double")
    got = {r.node: r.distance for r in N.shortest_distances(spark.createDataFrame(e, EDGES), seeds, label="label", blocks=blocks).collect()}
    assert got == {v: float(i + j) for (i, j), v in place.items()}
    step, level = {of[place[0, 0]]}, 0  # block crossings of the farthest block: what rounds may count
    seen = set(step)
    while step:
        step = {of[b] for a, b, _ in e if of[a] in step} - seen
        seen |= step
        level += 1
    assert len(rounds) / 2 <= 2 * level + 1 < side


def test_curve_keeps_neighbours_together(spark):
    """Steps along the curve are steps between neighbouring cells, and every cell is met once."""
    df = spark.createDataFrame([(float(i), float(j)) for i in range(16) for j in range(16)], "x double, y double")
    at = sorted((r.d, r.x, r.y) for r in df.select("x", "y", R.curve_place("x", "y", 0.0, 0.0, 16.0).alias("d")).collect())
    assert len({d for d, *_ in at}) == 256 and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(at, at[1:]))


def test_nearest_service_penalty(spark):
    nodes = spark.createDataFrame([(1, 2.3522, 48.8566), (2, 2.3532, 48.8576), (3, 2.3512, 48.8556)], "node_id bigint, node_lon double, node_lat double")
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 3000.0), (1, 3, 9000.0)], EDGES)
    targets = spark.createDataFrame([(0, 2.3522, 48.8566), (1, 2.3512, 48.8556)], "target_id int, lon double, lat double")
    services = spark.createDataFrame([(10, 1, 2.3532, 48.8576), (11, 2, 2.3512, 48.8556)], "service_id int, category int, lon double, lat double")
    d = {r.target_id: r.distances for r in N.nearest_by_network(targets, services, nodes, edges).collect()}
    assert d[0] == [2400.0, 100.0, 3100.0, 2400.0, 2400.0, 2400.0, 2400.0, 2400.0]  # a found distance is not capped
    assert d[1] == [2400.0, 2400.0, 0.0] + [2400.0] * 5  # node 3 reaches nothing else
    p = N.target_probabilities(N.nearest_by_network(targets, services, nodes, edges)).first()
    assert sum(p.target_prob_vector) == pytest.approx(1)
    nothing = N.nearest_by_network(targets, services.limit(0), nodes, edges)
    assert {tuple(r.distances) for r in nothing.collect()} == {(2400.0,) * 8}


def test_components_equal_union_find(spark, graph):
    ids, e = graph
    rnd = random.Random(2)
    e = [x for x in e if rnd.random() < 0.25]
    nodes = sorted(set(ids) | {v for x in e for v in x[:2]})
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b, _ in e:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node_id: r.component for r in N.connected_components(
        spark.createDataFrame([(v,) for v in nodes], "node_id bigint"), spark.createDataFrame(e, EDGES)).collect()}
    assert got == {v: find(v) for v in nodes}


def test_degrees_and_counts(spark):
    nodes = spark.range(1, 5).select(F.col("id").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 150.0), (3, 1, 200.0), (2, 1, 100.0)], EDGES)
    deg = {r.node_id: r.degree for r in N.node_degrees(nodes, edges).collect()}
    assert deg == {1: 3, 2: 3, 3: 2, 4: 0}
    assert N.intersections(nodes, edges).count() == 2
    s = N.edge_stats(edges).first()
    assert (s.edges, s.mean_length, s.max_length) == (4, 137.5, 200.0)
    assert N.graph_counts(nodes, edges).first().edges_per_node == 1.0
    c = N.component_share(nodes, edges).first()
    assert (c.components, c.share) == (2, 0.75)
