import hashlib
import os
import time

import pandas as pd
import pytest
from footreach.operators import augment as AU
from footreach.operators import evaluate as E
from footreach.operators import features as FT
from footreach.operators import learn as L
from footreach.operators import runs as RU
from footreach.operators import split as SP
from footreach.plans import stars as ST
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stars(spark):
    """Stars with 0-12 neighbours, the first without any."""
    rows = []
    for t in range(13):
        near = [([float(k)] * 33, 0.1 * k, -0.1 * k, 80.0 * k, 96.0 * k) for k in range(t)]
        rows.append((t, f"n{t % 4}", [1.0] * 33, near, [1 / 8] * 8, "POINT (2.3 48.8)", t))
    return spark.createDataFrame(rows, """target_id int, neighborhood_name string, target_features array<double>,
        neighbor_data array<struct<features:array<double>,dx:double,dy:double,euclidean_distance:double,network_distance:double>>,
        target_prob_vector array<double>, target_geometry string, num_neighbors int""")


def test_star_graph(stars):
    for r in FT.star_graph(stars).collect():
        n = r.num_neighbors
        assert (len(r.x), len(r.edge_index), len(r.edge_attr)) == (n + 1, n, n)
        assert [(e.src, e.dst) for e in r.edge_index] == [(i + 1, 0) for i in range(n)]
        assert all(e[2] == pytest.approx(0.08 * k) for k, e in enumerate(r.edge_attr))


def test_feature_row_check_sees_every_row(stars):
    assert {r.rule: r.violations for r in FT.check_feature_rows(stars).collect()} == {
        k: 0 for k in ("feature_length", "vector_length", "vector_sum", "neighbor_count", "geometry", "finite")}
    bad = stars.withColumn("num_neighbors", F.when(F.col("target_id") == 12, 5).otherwise(F.col("num_neighbors"))).withColumn(
        "target_features", F.when(F.col("target_id") == 7, F.array(F.lit(float("nan")))).otherwise(F.col("target_features")))
    got = {r.rule: r.violations for r in FT.check_feature_rows(bad).collect()}
    assert (got["neighbor_count"], got["feature_length"], got["finite"]) == (1, 1, 1)


def test_subsample_invariants(stars):
    out = {r.target_id: r for r in AU.subsample(stars, 0.8, 3, 1).collect()}
    for t, r in out.items():
        if t <= 3:
            assert r.num_neighbors == t
            continue
        kept = [n.euclidean_distance for n in r.neighbor_data]
        assert kept == sorted(kept) and len(set(kept)) == len(kept) >= 3
        bands = [(0, 300), (300, 600), (600, 900), (900, 1000)]
        for lo, hi in bands:
            size = sum(lo <= 80 * k < hi for k in range(t))
            assert sum(lo <= d < hi for d in kept) == (max(1, int(size * 0.8)) if size else 0)
    again = AU.subsample(stars, 0.8, 3, 1).select("target_id", "neighbor_data").collect()
    assert {r.target_id: r.neighbor_data for r in again} == {t: r.neighbor_data for t, r in out.items()}


def test_top_up_to_the_minimum(spark, stars):
    far = stars.filter("target_id = 6").withColumn("neighbor_data", F.transform("neighbor_data", lambda s: s.withField("euclidean_distance", F.lit(1000.0))))
    assert AU.subsample(far, 0.8, 3, 1).first().num_neighbors == 3  # no band takes them, three are kept all the same
    assert AU.subsample(far, 0.8, 3, 1, keep_edge=True).first().num_neighbors == 4


def test_subsample_of_a_large_star(spark):
    """What is kept follows the seeded draws, and the work does not grow with the square of the star."""
    n = 60_000
    d = [(i * 37 % 1000) * 1.0 for i in range(n)]
    df = spark.createDataFrame([(5, d), (None, d[:40])], "target_id int, d array<double>").select("target_id", F.transform("d", lambda x: F.struct(x.alias("euclidean_distance"))).alias("neighbor_data"))
    start = time.perf_counter()
    got = {r.target_id: [x.euclidean_distance for x in r.neighbor_data] for r in AU.subsample(df, 0.8, 3, 42).collect()}
    assert time.perf_counter() - start < 12
    for t, size in ((5, n), (None, 40)):
        draws = [(int(hashlib.md5("|".join([*([str(t)] if t is not None else []), str(i), "42"]).encode()).hexdigest()[:8], 16), i) for i in range(size)]
        keep = []
        for lo, hi in ((0, 300), (300, 600), (600, 900), (900, 1000)):
            band = sorted(x for x in draws if lo <= d[x[1]] < hi)
            keep += [i for _, i in band[:max(1, int(len(band) * 0.8))]]
        assert got[t] == [d[i] for i in sorted(keep)]


def test_noise_invariants(stars):
    g = AU.edge_noise(FT.star_graph(stars), 0.2, 0.2, seed=3)
    for r in g.collect():
        for e in r.edge_attr:
            assert all(0 <= v <= 1 + 1e-6 for v in e) and e[3] >= e[2]
    signed = AU.edge_noise(FT.star_graph(stars), 0.0, 0.0, seed=3, signed=True).filter("target_id = 5").first().edge_attr
    assert signed[3][1] < 0
    out = AU.feature_noise(stars, 0.01, 5)
    r = out.filter("target_id = 4").first()
    assert r.target_features != [1.0] * 33 and max(abs(a - 1) for a in r.target_features) < 0.1
    assert len(r.neighbor_data) == 4 and r.neighbor_data[2].euclidean_distance == 160.0


def test_compose_gates_rows(stars):
    none = AU.augment(stars, [(lambda d: AU.subsample(d), 0.0)], 1)
    assert none.select("target_id", "num_neighbors").exceptAll(stars.select("target_id", "num_neighbors")).isEmpty()
    all_ = AU.augment(stars, [(lambda d: AU.subsample(d), 1.0)], 1)
    assert {r.target_id: r.num_neighbors for r in all_.collect()} == {r.target_id: r.num_neighbors for r in AU.subsample(stars).collect()}


def test_splits_are_disjoint(spark, stars):
    s = SP.group_split(stars.select("target_id", "neighborhood_name"), seed=3).collect()
    by = {}
    for r in s:
        by.setdefault(r.split, set()).add(r.neighborhood_name)
    assert set(by) == {"train", "val", "test"} and sum(map(len, by.values())) == 4 and len(s) == 13
    with pytest.raises(ValueError, match="sum to 1"):
        SP.assign_splits(stars, ratios=(0.5, 0.1, 0.1))
    with pytest.raises(ValueError, match="3 groups"):
        SP.assign_splits(stars.filter("neighborhood_name IN ('n0', 'n1')"))
    three = SP.assign_splits(stars.filter("neighborhood_name <> 'n3'")).groupBy("split").count().collect()
    assert sorted((r["split"], r["count"]) for r in three) == [("test", 1), ("train", 1), ("val", 1)]


def test_pooling(stars):
    p = {r.target_id: r.pooled for r in L.pool_neighbours(stars).collect()}
    assert p[0] == [0.0] * 33 and p[5][0] == pytest.approx(2.0)
    q = {r.target_id: r.pooled for r in L.pool_neighbours(stars, "inverse").collect()}
    assert q[5][0] < 2.0


def test_pooling_runs_on_arrays_and_keeps_nulls(spark):
    """Ragged and null lists, null numbers and weights as sums in SQL have them; whole batches of numbers, not an expression a number."""
    near = [[([1.0, 2.0, 3.0], 0.0), ([3.0, 4.0, 5.0], 900.0)], [([1.0, None, 3.0], 0.0), ([3.0, 4.0, 5.0], 900.0)], [([1.0, 2.0], 0.0), ([3.0, 4.0, 5.0], 900.0)],
            [([1.0, 2.0, 3.0, 4.0], 0.0), ([3.0, 4.0, 5.0], 0.0)], [(None, 0.0), ([3.0, 4.0, 5.0], 0.0)], [([1.0, 2.0, 3.0], None), ([3.0, 4.0, 5.0], 0.0)], [], None, [([float("nan"), 2.0, 3.0], 0.0)]]
    df = spark.createDataFrame(list(enumerate(near)), "i int, neighbor_data array<struct<features:array<float>,euclidean_distance:double>>")
    out = L.pool_neighbours(df, "inverse", 3)
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.pooled for r in out.collect()}
    assert got[0] == pytest.approx([13 / 11, 24 / 11, 35 / 11]) and got[1] == pytest.approx([13 / 11, 0.0, 35 / 11]) and got[2] == pytest.approx([13 / 11, 24 / 11, 0.0])
    assert got[3] == [2.0, 3.0, 4.0, 0.0] and got[4] is None and got[5] == got[6] == [0.0] * 3 and got[7] is None
    assert got[8][0] != got[8][0] and got[8][1:] == pytest.approx([2.0, 3.0])
    assert L.pool_neighbours(df, n=3).filter("i = 5").first().pooled == [2.0, 3.0, 4.0]


def test_stars_of_targets_are_not_shuffled(spark, monkeypatch):
    """Everything a row needs beside its star is joined before: the join that brings the stars is the last, and pooling is done a lattice point."""
    monkeypatch.setattr(FT, "point_features", lambda p, **kw: p.select("target_id"))
    monkeypatch.setattr(ST, "sources", lambda *a: {})
    plan = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n") if "Exchange" in x]
    rows = ST.star_rows(spark, SF)
    assert plan(rows) and not [x for x in plan(rows) if "target_id" in x]
    pooled = ST.star_rows(spark, SF, lambda s: L.pool_neighbours(s).drop("neighbor_data")).select("target_id", "target_prob_vector", "target_features", "pooled").collect()
    whole = {r.target_id: r for r in L.pool_neighbours(rows).select("target_id", "target_prob_vector", "target_features", "pooled").collect()}
    assert len(pooled) == len(whole) and all(r == whole[r.target_id] for r in pooled)


def test_soft_label_model_learns(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], [0.7] + [0.3] + [0.0] * 6 if i % 2 else [0.0] * 6 + [0.4, 0.6], "a" if i % 4 < 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "target_id int, features array<double>, target_prob_vector array<double>, label string")
    out = L.score(L.fit_soft_labels(df, reg=0.001), df)
    r = {x.target_id: x for x in out.collect()}
    assert r[1].predicted_class == 0 and r[0].predicted_class == 7
    assert r[1].predicted_probs[0] == pytest.approx(0.7, abs=0.05) and sum(r[0].predicted_probs) == pytest.approx(1)
    u = {x.grp: x for x in L.compare_groups(out.withColumn("v", F.col("target_id") % 4), "label", "v", "a").collect()}
    assert u["a"].u == 0.0 and u["a"].u + u["other"].u == u["a"].n * u["other"].n


def test_reliability_edges(spark):
    preds = spark.createDataFrame([([0.7] + [0.3] + [0.0] * 6, [1.0] + [0.0] * 7), ([0.0] * 8, [1.0] + [0.0] * 7)], "predicted_probs array<double>, target_probs array<double>")
    r = {x.bin: x for x in E.reliability(preds).collect()}
    assert (r[6]["count"], r[6].accuracy, r[0]["count"], r[0].confidence) == (1, 1.0, 0, 0.05)
    assert E.ece(preds).first().ece == pytest.approx(0.15)
    w = {x["class"]: x for x in E.class_weights(preds, "target_probs").collect()}
    assert (w[0]["count"], w[0].weight, w[5].weight) == (2, 1.0, 1.0)
    with pytest.raises(ValueError):
        E.reduce_loss(preds, "predicted_probs", "median")
    text = spark.createDataFrame([("[0.1, 0.9]", "[1, 0]"), ("[[1]]", "[1]"), ("oops", "[1]"), (None, "[1]")], "predicted_probs string, target_probs string")
    assert E.parse_prob_arrays(text).count() == 1


def sequential(losses, patience, delta):
    best, at, bad, stop = None, None, 0, None
    for i, v in losses:
        if best is None or v < best - delta:
            best, at, bad = v, i, 0
        else:
            bad += 1
            if bad >= patience:
                stop = i
                break
    return best, at, stop


def test_patience_equals_the_sequential_walk(spark):
    import random
    rnd = random.Random(11)
    rows = []
    for run in range(12):
        v = 10.0
        for e in range(rnd.randint(1, 60)):
            v += rnd.uniform(-0.5, 0.4)
            rows.append((run, e * 5, round(v, 3) if rnd.random() > 0.1 else None))
    df = spark.createDataFrame(rows, "run int, epoch bigint, val_loss double")
    for patience, delta in ((3, 0.0), (5, 0.3)):
        got = {r.run: (r.best_loss, r.best_epoch, r.stop_epoch) for r in RU.patience(df, patience, delta).collect()}
        for run in range(12):
            seq = [(e, v) for r, e, v in rows if r == run and v is not None]
            if seq:
                assert got[run] == sequential(seq, patience, delta)


def test_carry_forward_and_upsert(spark):
    h = spark.createDataFrame([(0, e, None if e % 4 else float(e)) for e in range(1, 12)], "run int, epoch bigint, m double")
    assert [r.m for r in RU.carry_forward(h, ["m"]).orderBy("epoch").collect()] == [None] * 3 + [4.0] * 4 + [8.0] * 4
    base = spark.createDataFrame([(1, "a"), (3, "c")], "epoch int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "z")], "epoch int, v string")
    assert sorted(tuple(r) for r in RU.upsert_by_key(base, new, ["epoch"]).collect()) == [(1, "a"), (2, "b"), (3, "z")]


def test_upsert_table_writes_only_touched_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(v).alias("version"), (F.col("id") * 10 + v).alias("x"))
    RU.upsert_table(path, rows(0, 500, 1), ["k"], "version")
    stamp = {p: p.stat().st_mtime_ns for p in tmp_path.glob("t/_bucket=*/*.parquet")}
    for _ in range(2):
        RU.upsert_table(path, rows(100, 103, 2).unionByName(rows(600, 601, 2)).unionByName(rows(100, 103, 1)), ["k"], "version")
    assert sum(p in stamp and p.stat().st_mtime_ns == stamp[p] for p in tmp_path.glob("t/_bucket=*/*.parquet")) >= len(stamp) - 4
    got = {r.k: r.x for r in spark.read.parquet(path).collect()}
    assert got == {**{k: k * 10 + 1 for k in range(500)}, **{k: k * 10 + 2 for k in (100, 101, 102, 600)}}
    RU.upsert_table(path, rows(0, 0, 1), ["k"], "version")
    assert spark.read.parquet(path).count() == 501


def test_leaderboard_and_log(spark):
    runs = spark.createDataFrame([("a", 0.4, 0.9, None), ("b", 0.3, 0.8, None), ("c", 0.1, 1.0, "boom"), ("d", 0.3, 0.95, None)], "name string, val_loss double, top1 double, error string")
    assert [(r.name, r.rank) for r in RU.leaderboard(runs, "val_loss").collect()] == [("b", 1), ("d", 1), ("a", 3)]
    assert [r.name for r in RU.leaderboard(runs, "top1", 2).collect()] == ["d", "a"]
    assert RU.best_run(runs.filter("error IS NULL")).first().name == "b"
    lines = spark.createDataFrame(pd.DataFrame({"path": ["p"] * 4, "value": ["Best validation loss: 0.5", "x: Best validation loss: oops", "Test KL divergence: 1e-2", "done"]}))
    r = RU.parse_log(lines).first()
    assert (r.best_val_loss, r.test_kl_divergence) == (0.5, 0.01)


def test_parameter_search_fits_all_models_in_shared_passes(spark, monkeypatch):
    """At the end every model's gradient is zero (written out here), scores agree with one fit after the other, and passes don't grow with the grid."""
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 4)) * [1, 20, 0.1, 1] + [0, 5, 0, 0]
    x[:, 3] = 2.0  # a feature that does not vary
    y = np.exp(rng.normal(size=(160, 8)) + x[:, :1] * rng.normal(size=8))
    y /= y.sum(axis=1, keepdims=True)
    fold = rng.integers(0, 3, 160)
    df = spark.createDataFrame([(int(f), a.tolist(), b.tolist()) for f, a, b in zip(fold, x, y)], "fold int, features array<double>, target_prob_vector array<double>").repartition(3)
    passes = []
    real = L._summed
    monkeypatch.setattr(L, "_summed", lambda *a: passes.append(1) or real(*a))
    counts = []
    for regs in ([0.1], [0.05, 0.1, 1.0, 10.0]):
        passes.clear()
        stack, _ = L.fit_stack(df, [{"reg": r, "max_iter": 200} for r in regs], "fold", [0, 1])
        counts.append(len(passes))
    assert counts[1] <= 2 * counts[0] + 20
    for m, (i, f) in enumerate(stack.models):
        train = fold != f
        part, own = x[train], y[train]
        std = part.std(axis=0)
        z = np.hstack([np.where(std > 1e-9, part / np.where(std > 1e-9, std, 1), 0), np.ones((len(part), 1))])
        w = stack.weights[m]
        p = np.exp(z @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - own).T @ z / len(own) + np.hstack([w[:, :-1] * stack.params[i]["reg"], np.zeros((8, 1))])
        assert np.abs(g).max() < 1e-6
    got = {r.reg: r.val_kl for r in L.grid_search(df, {"reg": [0.05, 1.0], "max_iter": [200]}, "fold", [0, 1, 2]).collect()}
    for reg, kl in got.items():
        each = []
        for f in range(3):
            model = L.fit_soft_labels(df.filter(F.col("fold") != f), reg=reg, max_iter=200)
            held = L.score(model, df.filter(F.col("fold") == f))
            each.append(held.agg(F.avg(L.V.kl("target_prob_vector", "predicted_probs"))).first()[0])
        assert kl == pytest.approx(sum(each) / 3, abs=2e-4)
    assert L.grid_search(df.limit(0), {"reg": [1.0]}, "fold", [0]).first().val_kl is None
