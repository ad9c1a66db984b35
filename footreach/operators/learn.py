"""Learning a service distribution from compliant areas, and scoring every location with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.constants import CATEGORIES, N_CATEGORIES, N_FEATURES
from footreach.functions import vectors as V
from footreach.operators.quantiles import ranks
from footreach.session import cut_lineage


def _pooled(n: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def pool(features: pa.Array, weights: pa.Array) -> pa.Array:
        """Weighted means of the rows' feature lists. A null list makes the row null, a null number or weight the sums it enters, a place that some list lacks too; null sums are 0."""
        out = []
        for own, w in zip(features, weights):
            if not own.is_valid:
                out.append(None)
                continue
            own, w = own.values, w.values
            if not len(own):
                out.append(np.zeros(n))
                continue
            x, mass = own.flatten(), None if w.null_count else pc.sum(w).as_py()
            if own.null_count or x.null_count or len(x) != n * len(own) or (own.value_lengths().to_numpy() != n).any():
                lists = own.to_pylist()
                if None in lists:
                    out.append(None)
                    continue
                x = np.full((len(lists), max(n, *map(len, lists))), np.nan)
                known = np.zeros(x.shape, bool)
                for i, v in enumerate(lists):
                    known[i, :len(v)] = [e is not None for e in v]
                    x[i, :len(v)] = [np.nan if e is None else e for e in v]
                known = known.all(axis=0) & (np.arange(x.shape[1]) < n)
            else:
                x, known = x.to_numpy().reshape(-1, n).astype(float), True
            out.append(np.where(known, w.to_numpy() @ x / mass, 0.0) if mass else np.zeros(x.shape[1]))
        return pa.array(out, pa.list_(pa.float64()))
    return pool


def pool_neighbours(df: DataFrame, weighting: str = "mean", n: int = N_FEATURES) -> DataFrame:
    """`pooled`: mean (or inverse-distance mean) of the neighbours' features, inside the row; zeros without any."""
    near = F.col("neighbor_data")
    weights = F.transform(near, lambda s: F.lit(1.0) if weighting == "mean" else F.lit(1.0) / (s["euclidean_distance"].cast("double") / 1000.0 + 0.1))
    return df.withColumn("pooled", F.arrow_udf(_pooled(n), "array<double>")(near["features"], weights))


def soft_rows(df: DataFrame, target: str = "target_prob_vector", class_weights=None, n: int = N_CATEGORIES) -> DataFrame:
    """Each target as n labelled rows weighted by its probability (times the class weight); zero weights are dropped."""
    p = V.as_double(target)
    w = V.lit_array(class_weights or [1.0] * n)
    items = F.transform(F.zip_with(p, w, lambda a, b: a * b), lambda x, i: F.struct(
        i.cast("double").alias("class_label"), x.alias("class_weight")))
    return df.withColumn("_s", F.explode(items)).select("*", "_s.class_label", "_s.class_weight").drop("_s").filter(F.col("class_weight") > 0)


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(V.as_double(features)))


def fit_soft_labels(df: DataFrame, features: str = "features", target: str = "target_prob_vector", class_weights=None,
                    reg: float = 0.01, max_iter: int = 50):
    """Multinomial regression on soft labels: its weighted log loss is the KL to the target plus a constant."""
    lr = LogisticRegression(family="multinomial", featuresCol="_x", labelCol="class_label", weightCol="class_weight",
                            regParam=float(reg), maxIter=int(max_iter), probabilityCol="_prob", rawPredictionCol="_raw",
                            predictionCol="_pred")
    return lr.fit(soft_rows(_vectors(df, features), target, class_weights).select("_x", "class_label", "class_weight"))


def score(model, df: DataFrame, features: str = "features") -> DataFrame:
    """Predicted distribution and class of every row; logits kept as `logits`."""
    out = model.transform(_vectors(df, features))
    return out.withColumn("predicted_probs", V.fit_length(vector_to_array("_prob"), N_CATEGORIES)).withColumn(
        "logits", vector_to_array("_raw")).withColumn("predicted_class", V.argmax_class("predicted_probs")).drop(
        "_x", "_prob", "_raw", "_pred")


class _Stack:
    """Models of a parameter search, fitted side by side: weights (classes x (features + 1)) each in its fold's own scale."""

    def __init__(self, params: list[dict], folds: list, sums: dict, n_classes: int):
        self.models = [(i, f) for i in range(len(params)) for f in range(len(folds))]
        self.params, self.folds, self.k = params, folds, n_classes
        whole = {c: sum(s[c] for s in sums.values()) for c in ("mass", "gram")}
        self.scale, self.gram, self.mass = {}, {}, {}
        for j, f in enumerate(folds):
            gram = whole["gram"] - (sums[f]["gram"] if f in sums else 0)
            mass = whole["mass"] - (sums[f]["mass"] if f in sums else 0)
            mean, square = gram[-1, :-1] / max(mass, 1e-300), np.diag(gram)[:-1] / max(mass, 1e-300)
            std = np.sqrt(np.maximum(square - mean * mean, 0.0))
            self.scale[j] = np.append(np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0), 1.0)
            self.gram[j], self.mass[j] = gram * self.scale[j][:, None] * self.scale[j][None, :] / max(mass, 1e-300), mass
        d = len(self.scale[0])
        self.weights = np.zeros((len(self.models), n_classes, d))
        self.steps = []
        for i, f in self.models:
            # a bound of the curvature anywhere: (I - 11' / K) / 2 over the classes times the features' second moments, and the penalty
            bound = np.kron(0.5 * (np.eye(n_classes) - 1.0 / n_classes), self.gram[f]) + 1e-9 * np.eye(n_classes * d)
            penalty = np.tile(np.append(np.full(d - 1, float(params[i]["reg"])), 0.0), n_classes)
            self.steps.append(np.linalg.inv(bound + np.diag(penalty)))

    def penalty(self, m: int, w: np.ndarray) -> np.ndarray:
        """Gradient of the penalty; the intercept is free."""
        return np.hstack([w[:, :-1] * float(self.params[self.models[m][0]]["reg"]), np.zeros((self.k, 1))])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _frames(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """(features with a column of ones, targets, folds) of each batch."""
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            yield np.hstack([x, np.ones((b.num_rows, 1))]), b.column("y").flatten().to_numpy().reshape(b.num_rows, n), b.column("fold").to_pylist()


def _summed(rows: DataFrame, work: Callable, keys: list) -> dict:
    """Arrays by key, added over all rows: a partial sum a task, then one aggregate; what comes back is a row a key."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for key, value in work(batches):
            total[key] = total[key] + value if key in total else value
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], names=["key", "v"])

    each = rows.mapInArrow(part, "key int, v array<double>").select("key", F.posexplode("v").alias("i", "v"))
    got = each.groupBy("key", "i").agg(F.sum("v").alias("v")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).collect()
    return {keys[r.key]: np.array([e.v for e in r.v]) for r in got}


def fit_stack(df: DataFrame, params: list[dict], fold: str, folds: list, features: str = "features", target: str = "target_prob_vector",
              n: int = N_CATEGORIES, tol: float = 1e-9) -> tuple[_Stack, DataFrame]:
    """Soft-label multinomial models of all parameter sets and folds at once: every pass over the data serves them all.

    One pass takes the features' moments, from which each fold's scale and a bound of every model's curvature follow; then a pass
    an iteration adds up all gradients, and accelerated steps under that bound go down to the least loss of each model
    (weighted log loss plus reg / 2 times the squared weights of the scaled features, as in `fit_soft_labels`). A parameter
    set may hold `reg` and `max_iter`. Rows of a fold not named train every model. Passes don't grow with the grid.
    """
    known = {f: i for i, f in enumerate(folds)}
    rows = cut_lineage(df.select(V.as_double(features).alias("x"), V.as_double(target).alias("y"), F.col(fold).alias("fold")))
    size = rows.select(F.max(F.size("x"))).first()[0] or 0
    names = [*folds, None]

    def moments(batches):
        for x, y, f in _frames(batches, n):
            own = np.array([known.get(v, len(folds)) for v in f])
            for j in np.unique(own):
                part, mass = x[own == j], y[own == j].sum(axis=1)
                yield int(j), np.append((part * mass[:, None]).T @ part, mass.sum())

    got = _summed(rows, moments, names)
    sums = {f: {"gram": v[:-1].reshape(size + 1, size + 1), "mass": v[-1]} for f, v in got.items()}
    stack = _Stack(params, folds, sums or {None: {"gram": np.zeros((size + 1, size + 1)), "mass": 0.0}}, n)
    ahead, before = stack.weights.copy(), stack.weights.copy()
    momentum = np.ones(len(stack.models))
    open_models = [m for m, (_, f) in enumerate(stack.models) if stack.mass[f] > 0]
    for turn in range(max(int(p.get("max_iter", 100)) for p in params)):
        active = [m for m in open_models if turn < int(params[stack.models[m][0]].get("max_iter", 100))]
        if not active:
            break
        at, of, scale = ahead, list(stack.models), dict(stack.scale)

        def gradients(batches):
            for x, y, f in _frames(batches, n):
                own = np.array([known.get(v, len(folds)) for v in f])
                for m in active:
                    train = own != of[m][1]
                    if train.any():
                        part = x[train] * scale[of[m][1]]
                        yield m, (_softmax(part @ at[m].T) * y[train].sum(axis=1, keepdims=True) - y[train]).T @ part

        slopes = _summed(rows, gradients, list(range(len(stack.models))))
        for m in active:
            g = slopes[m].reshape(n, -1) / stack.mass[stack.models[m][1]] + stack.penalty(m, ahead[m])
            new = ahead[m] - (stack.steps[m] @ g.ravel()).reshape(n, -1)
            if (g * (new - before[m])).sum() > 0:  # the momentum points uphill: start it anew
                momentum[m] = 1.0
            later = (1 + np.sqrt(1 + 4 * momentum[m] ** 2)) / 2
            ahead[m] = new + (momentum[m] - 1) / later * (new - before[m])
            before[m], momentum[m], stack.weights[m] = new, later, new
            if np.abs(g).max() < tol:
                open_models.remove(m)
    return stack, rows


def grid_search(df: DataFrame, grid: dict[str, list], fold: str, folds: list, features: str = "features",
                target: str = "target_prob_vector") -> DataFrame:
    """Mean validation KL of each parameter set over group-disjoint folds, best first. All fits share their passes (`fit_stack`)."""
    names = list(grid)
    params = [{"reg": 0.01, "max_iter": 50, **dict(zip(names, v))} for v in product(*grid.values())]
    stack, rows = fit_stack(df, params, fold, folds, features, target)
    known, weights, of, scale = {f: i for i, f in enumerate(folds)}, stack.weights, list(stack.models), dict(stack.scale)

    def held_out(batches):
        for x, y, f in _frames(batches, N_CATEGORIES):
            own = np.array([known.get(v, len(folds)) for v in f])
            for m, (_, j) in enumerate(of):
                held = own == j
                if held.any():
                    q, p = _softmax((x[held] * scale[j]) @ weights[m].T), y[held]
                    yield m, np.array([(p * (np.log(p + 1e-8) - np.log(q + 1e-8))).sum(), held.sum()])

    scores = _summed(rows, held_out, list(range(len(of))))
    out = []
    for i, p in enumerate(params):
        each = [scores[m][0] / scores[m][1] for m, (k, _) in enumerate(of) if k == i and m in scores]
        out.append((*[float(p[c]) for c in names], float(sum(each) / len(each)) if each else None))
    schema = ", ".join(f"{c} double" for c in names) + ", val_kl double"
    return df.sparkSession.createDataFrame(out, schema).orderBy("val_kl", *names)


def service_gaps(scored: DataFrame, distances: str = "distances", k: int = 3, tau: float = 200.0,
                 predicted: str = "predicted_probs", limit_m: float = 1200.0) -> DataFrame:
    """Per location: divergence of the wanted from the present distribution, the k most wanted categories, far ones among them."""
    top = V.top_k(predicted, k)
    names = V._col(F.array(*[F.lit(c) for c in CATEGORIES]))
    return scored.withColumn("gap", V.distance_alignment(predicted, distances, tau)).withColumn("top_categories", F.transform(
        top, lambda i: F.get(names, i))).withColumn("missing_categories", F.transform(
            F.filter(top, lambda i: F.get(F.col(distances), i) > F.lit(float(limit_m))), lambda i: F.get(names, i)))


def compare_groups(df: DataFrame, label: str, value: str, first: str) -> DataFrame:
    """Mean, sample std and n per label, with the Mann-Whitney U of `first` against the rest (tie-averaged ranks)."""
    r = ranks(df.filter(F.col(value).isNotNull()), value).withColumn("_g", F.when(F.col(label) == first, first).otherwise("other"))
    by = r.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                             F.sum("rank_avg").alias("_rs"))
    n = F.col("n").cast("double")
    return by.select(F.col("_g").alias("grp"), "n", "mean", "std", (F.col("_rs") - n * (n + 1.0) / 2.0).alias("u"))
