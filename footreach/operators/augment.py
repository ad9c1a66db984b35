"""Seeded augmentation of star rows; every step works inside the row, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.functions import scalars as S
from footreach.functions import vectors as V
from footreach.operators.split import sample_neighbours

TOP = 1.0 + 1e-6


def _noisy(v: Column, std: float, seed, *keys) -> Column:
    noise = F.transform(V.as_double(v), lambda x, i: x + F.lit(float(std)) * S.normal(seed, *keys, i))
    return V.clamp_features(noise)


def feature_noise(df: DataFrame, std: float = 0.01, seed: int = 42, *, key: str = "target_id", target: bool = True,
                  neighbors: bool = True) -> DataFrame:
    """Gaussian noise on the 33 features of the target and / or its neighbours, then each feature's own clamp."""
    out = df
    if target:
        out = out.withColumn("target_features", _noisy(F.col("target_features"), std, seed, F.col(key), F.lit("t")))
    if neighbors and "neighbor_data" in df.columns:
        out = out.withColumn("neighbor_data", F.transform("neighbor_data", lambda s, k: s.withField(
            "features", _noisy(s["features"], std, seed, F.col(key), k))))
    return out


def edge_noise(df: DataFrame, d_std: float = 0.02, p_std: float = 0.02, seed: int = 42, *, key: str = "target_id",
               col: str = "edge_attr", signed: bool = False) -> DataFrame:
    """Noise on scaled edge attributes [dx, dy, euclidean, network].

    Distance noise grows with the distance, dx and dy follow the Euclidean factor, network >= Euclidean. Everything is
    clamped to [0, 1 + 1e-6]; with `signed`, dx and dy keep their sign (clamped to [-1, 1] and a little).
    """
    def clamp(x, lo=0.0):
        return F.least(F.greatest(x, F.lit(lo)), F.lit(TOP))

    def noise(e, k):
        z = [S.normal(f"{seed}{tag}", F.col(key), k) for tag in ("e", "x", "y", "n")]
        return F.struct(e.alias("e"), clamp(e[2] + z[0] * F.lit(d_std) * e[2]).alias("euc"), *[c.alias(n) for c, n in zip(z[1:], "xyn")])

    def step(s):  # a step of its own, so that each random number is drawn once however often it is used
        e, euc = s["e"], s["euc"]
        factor = F.when(e[2] > 1e-6, F.try_divide(euc, e[2])).otherwise(F.lit(1.0))
        net = F.greatest(clamp(e[3] + s["n"] * F.lit(d_std) * e[3]), euc)
        low = -TOP if signed else 0.0
        return F.array(clamp((e[0] + s["x"] * F.lit(p_std)) * factor, low), clamp((e[1] + s["y"] * F.lit(p_std)) * factor, low),
                       euc, net)

    return df.withColumn(col, F.transform(F.transform(F.col(col).cast("array<array<double>>"), noise), step))


def subsample(df: DataFrame, ratio: float = 0.8, min_n: int = 3, seed: int = 42, **kw) -> DataFrame:
    return sample_neighbours(df, ratio, min_n, seed, **kw)


def augment(df: DataFrame, steps: list[tuple[Callable[[DataFrame], DataFrame], float]], seed: int = 42,
            key: str = "target_id") -> DataFrame:
    """Apply each (step, probability) in turn; a seeded gate per row and step decides whether the row is changed."""
    out = df
    cols = [c for c in df.columns if c != key]
    for k, (step, p) in enumerate(steps):
        gate = S.uniform(f"{seed}gate{k}", F.col(key)) < F.lit(float(p))
        kept = out.withColumns({f"_old_{c}": F.col(c) for c in cols})
        done = step(kept)
        out = done.select(key, *[F.when(gate, F.col(c)).otherwise(
            F.col(f"_old_{c}").cast(done.schema[c].dataType)).alias(c) for c in cols])
    return out


def default_steps(seed: int = 42) -> list:
    return [(lambda d: feature_noise(d, 0.01, seed), 0.8), (lambda d: subsample(d, 0.8, 3, seed), 0.5)]
