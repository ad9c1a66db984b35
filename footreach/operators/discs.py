"""Sums over all features in the discs around points: tiles of the plane in tasks, strips of a tile in arrays.

Points lie in one tile each, features go to the tiles that their discs may touch. A tile of many rows is cut on both sides
into parts that meet each other, so no task holds more than `POINTS` points and `FEATURES` features, however they crowd. In
a task the features lie in strips of equal height, sorted along each strip: those a disc surely holds are one run of a
strip, added by two running totals, and only those near the circle are tested.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.session import cut_lineage

POINTS, FEATURES, TILE_POINTS = 50_000, 200_000, 4_000
PIECE = 1_000_000  # pairs tested at once
_PART = ["_tx", "_ty", "_p", "_f"]


def _add_tested(out, v, fx, fy, px, py, first, after, r):
    """Adds to out the features [first, after) of each point that lie within r, some pairs at a time."""
    lens = after - first
    at = np.flatnonzero(lens)
    ends = np.cumsum(lens[at])
    begin = 0
    while begin < len(at):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        rows = at[begin:stop]
        n = lens[rows]
        after_ = np.cumsum(n)
        idx = np.repeat(first[rows] - (after_ - n), n) + np.arange(after_[-1])
        dx, dy = fx[idx] - np.repeat(px[rows], n), fy[idx] - np.repeat(py[rows], n)
        hit = np.flatnonzero(np.sqrt(dx * dx + dy * dy) <= r)
        total = np.zeros((len(hit) + 1, v.shape[1]), v.dtype)
        np.cumsum(v[idx[hit]], axis=0, out=total[1:])
        upto = np.searchsorted(hit, np.concatenate(([0], after_)))
        out[rows] += total[upto[1:]] - total[upto[:-1]]
        begin = stop


def disc_sums(x, y, fx, fy, v, r: float):
    """Per point the sums of the rows of v (finite numbers) whose place lies within r."""
    out = np.zeros((len(x), v.shape[1]), v.dtype)
    if not len(x) or not len(fx):
        return out
    by_y = np.argsort(y, kind="stable")
    x, y = x[by_y], y[by_y]
    area = max((fx.max() - fx.min()) * (fy.max() - fy.min()), r * r)
    strips = min(max(math.sqrt(len(fx) * math.pi * r * r / area / 8), 2.0), 128.0)
    row = np.floor((fy - fy.min()) / (r / strips)).astype(np.int64)
    order = np.lexsort((fx, row))
    fx, fy, v, row = fx[order], fy[order], v[order], row[order]
    total = np.concatenate((np.zeros((1, v.shape[1]), v.dtype), np.cumsum(v, axis=0)))
    slack = 1e-9 * (max(np.abs(a).max() for a in (x, y, fx, fy)) + r)  # far above the rounding of the exact test
    cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
    sums = np.zeros_like(out)
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = fy[a:b].min(), fy[a:b].max()
        i, j = np.searchsorted(y, low - r - slack), np.searchsorted(y, high + r + slack, "right")
        if i == j:
            continue
        px, py, strip = x[i:j], y[i:j], fx[a:b]
        near, far = np.maximum(np.maximum(low - py, py - high), 0.0), np.maximum(np.abs(py - low), np.abs(py - high))
        wide = np.sqrt(np.maximum(r * r - near * near, 0.0)) + slack
        wide = np.maximum(wide, np.where(near <= r + slack, math.sqrt(2 * r * slack) + slack, 0.0))
        sure = np.sqrt(np.maximum((r - slack) ** 2 - far * far, 0.0)) - slack
        first, last = a + np.searchsorted(strip, px - wide), a + np.searchsorted(strip, px + wide, "right")
        some = (sure > 0) & (far < r - slack)
        begin = np.where(some, a + np.searchsorted(strip, px - sure), last)
        end = np.where(some, a + np.searchsorted(strip, px + sure, "right"), last)
        sums[i:j] += total[end] - total[begin]
        _add_tested(sums[i:j], v, fx, fy, px, py, first, begin, r)
        _add_tested(sums[i:j], v, fx, fy, px, py, end, last, r)
    out[by_y] = sums
    return out


def _sums_of(names: list[str], r: float):
    def run(spots: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if not len(spots) or not len(places):
            return pd.DataFrame({c: pd.Series(dtype=float) for c in ("_x", "_y", *names)})
        x, y, fx, fy = (np.ascontiguousarray(d[c].to_numpy(np.float64)) for d, c in ((spots, "_x"), (spots, "_y"), (places, "_fx"), (places, "_fy")))
        v = places[names].to_numpy()
        odd = ~np.isfinite(v.astype(np.float64)).all(axis=1)
        sums = disc_sums(x, y, fx[~odd], fy[~odd], v[~odd], r)
        for k in np.flatnonzero(odd):  # infinite and undefined values would spoil running totals
            sums[np.sqrt((fx[k] - x) ** 2 + (fy[k] - y) ** 2) <= r] += v[k]
        out = pd.DataFrame(sums, columns=names)
        return out.assign(_x=x, _y=y)[["_x", "_y", *names]]
    return run


def _tile(col: str, side: float, grow: float = 0.0) -> str:
    return f"CAST(floor(({col} + {grow!r}D) / {side!r}D) AS bigint)"


def sums_by_tile(spots: DataFrame, places: DataFrame, radius: float, kinds: dict[str, str]) -> DataFrame:
    """_x, _y and the sums of kinds' columns (name: bigint or double) over the places within the radius of each spot.

    spots: distinct finite _x, _y; places: finite _fx, _fy and the columns, none null. Spots near no place may be missing.
    """
    spots, places = cut_lineage(spots), cut_lineage(places)
    x0, y0, x1, y1, n = spots.agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y"), F.count(F.lit(1))).first()  # one row
    area = (x1 - x0) * (y1 - y0) if n else 0.0
    side = max(2.0 * radius, math.sqrt(area * TILE_POINTS / max(n, 1)))
    left = spots.selectExpr("*", f"{_tile('_x', side)} AS _tx", f"{_tile('_y', side)} AS _ty")
    right = places.selectExpr("*", f"explode(sequence({_tile('_fx', side, -radius)}, {_tile('_fx', side, radius)})) AS _tx").selectExpr(
        "*", f"explode(sequence({_tile('_fy', side, -radius)}, {_tile('_fy', side, radius)})) AS _ty")
    p, f = (d.groupBy("_tx", "_ty").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(c)) for d, size, c in ((left, POINTS, "_ps"), (right, FEATURES, "_fs")))
    parts = cut_lineage(p.join(f, ["_tx", "_ty"]))  # one row a tile
    deal = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.join(parts, ["_tx", "_ty"]).withColumn("_p", F.pmod(F.xxhash64("_x", "_y"), "_ps").cast("int")).withColumn("_f", F.explode(F.expr("sequence(0, _fs - 1)")))
    right = right.join(parts, ["_tx", "_ty"]).withColumn("_f", F.pmod(F.xxhash64("_fx", "_fy"), "_fs").cast("int")).withColumn("_p", F.explode(F.expr("sequence(0, _ps - 1)")))
    left, right = (d.drop("_ps", "_fs").repartition(deal, *_PART).groupBy(*_PART) for d in (left, right))
    schema = ", ".join(["_x double", "_y double", *[f"`{c}` {k}" for c, k in kinds.items()]])
    met = left.cogroup(right).applyInPandas(_sums_of(list(kinds), float(radius)), schema)
    return met.groupBy("_x", "_y").agg(*[F.sum(c).alias(c) for c in kinds])
