"""Banded alignment of vector sequences, plain or steered by sparse guides, with kinematics along the path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodograph.operators.vectors import Ragged
from hodograph.plans.config import AlignConfig

PENALTY_UNDER = np.float32(0.3)
NARROW_FROM = np.float32(0.7)


@dataclass
class Alignment:
    total: float
    path: list[tuple[int, int]]
    kinematics: np.ndarray  # steps x (velocity, acceleration, curvature)
    error: str | None = None

    def score(self) -> float:
        return self.total / len(self.path)

    def divergence(self, n: int, m: int, alpha: float) -> float:
        return abs(n - m) / len(self.path) + alpha * self.score()


def cosine_costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``1 - cosine`` within [0, 2]; 1 where a vector is zero; NaN where one has a NaN."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = 1 - np.clip((x @ y.T) / (nx[:, None] * ny[None, :]), -1, 1)
    c[(nx == 0)[:, None] | (ny == 0)[None, :]] = 1.0
    return np.maximum(c, 0)


def band_widths(profile: np.ndarray, n: int, cfg: AlignConfig) -> tuple[np.ndarray, np.ndarray]:
    """Half width of the band and cost factor of each row, from the positional agreement (0 beyond its end).

    High agreement narrows the band and low agreement widens it and raises costs. Between 0.3 and 0.7 the width runs from
    the narrow to the wide end, as in the semantics to be matched, though the other way round would be expected.
    """
    lo, hi = sorted((cfg.w_min, cfg.w_max))
    j = np.zeros(n, dtype=np.float32)
    j[: min(n, len(profile))] = profile[:n]
    ramp = (np.float32(lo) + np.float32(hi - lo) * ((j - PENALTY_UNDER) / np.float32(0.4))).astype(np.int64)
    width = np.where(j >= NARROW_FROM, lo, np.where(j < PENALTY_UNDER, hi, ramp))
    factor = np.where(j < PENALTY_UNDER, 1.0 + (PENALTY_UNDER - j).astype(np.float64), 1.0)
    return np.minimum(width, max(cfg.window, 1)), factor


def kinematics(x: np.ndarray, y: np.ndarray, path: list[tuple[int, int]]) -> np.ndarray:
    """Along the path: length of the error vector, its change, and ``1 - cosine`` with the error before (0 at first)."""
    i, j = np.array(path).T
    e = x[i] - y[j]
    v = np.linalg.norm(e, axis=1)
    out = np.zeros((len(path), 3))
    out[:, 0] = v
    out[1:, 1] = np.diff(v)
    norms = v[1:] * v[:-1]
    dots = np.einsum("nd,nd->n", e[1:], e[:-1])
    with np.errstate(invalid="ignore", divide="ignore"):
        out[1:, 2] = np.where(norms == 0, 0.0, np.maximum(1 - dots / norms, 0))
    return out


def align(x: np.ndarray | None, y: np.ndarray | None, cfg: AlignConfig, profile: np.ndarray | None = None) -> Alignment:
    """Least-cost monotone path within the band; among equal predecessors the diagonal, then left, then up.

    Without a ``profile`` the band is ``cfg.window`` everywhere and an unreachable end has infinite cost; with one it is
    steered per row. Errors: ``empty``, ``dimension`` (of the two sides), ``nan`` (within the band).
    """
    none = np.zeros((0, 3))
    if x is None or y is None:
        return Alignment(np.nan, [], none, "empty")
    if x.shape[1] != y.shape[1]:
        return Alignment(np.nan, [], none, "dimension")
    n, m = len(x), len(y)
    width, factor = band_widths(profile, n, cfg) if profile is not None else (np.full(n, cfg.window), np.ones(n))
    costs = cosine_costs(x, y) * factor[:, None]
    inside = np.abs(np.arange(n)[:, None] - np.arange(m)[None, :]) <= width[:, None]
    if np.isnan(costs[inside]).any():
        return Alignment(np.nan, [], none, "nan")
    total = accumulate(np.where(inside, costs, np.inf))
    path = trace(total)
    return Alignment(float(total[n, m]), path, kinematics(x, y, path))


def accumulate(costs: np.ndarray) -> np.ndarray:
    """Least cost to every cell, with a border of infinite costs before the first row and column.

    A cell needs its upper, left and diagonal neighbours, so all cells of one anti-diagonal are computed at once.
    """
    n, m = costs.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        total[i, j] = costs[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j], total[i, j - 1]), total[i - 1, j - 1])
    return total


def trace(total: np.ndarray) -> list[tuple[int, int]]:
    """Best path to the last cell, as cells from the first on."""
    diag, left, up = total[:-1, :-1], total[1:, :-1], total[:-1, 1:]
    back = np.where((diag <= left) & (diag <= up), 0, np.where(left <= up, 1, 2))
    back[:, 0], back[0, :] = 2, 1
    di, dj = (1, 0, 1), (1, 1, 0)
    cell, path = (total.shape[0] - 2, total.shape[1] - 2), []
    while cell != (0, 0):
        path.append(cell)
        b = back[cell]
        cell = (cell[0] - di[b], cell[1] - dj[b])
    return [(0, 0), *path[::-1]]


RESULT = "error string, score double, divergence double, path_len int, path array<struct<i:int,j:int>>, kin array<struct<v:double,a:double,k:double>>"


def align_pairs(df: DataFrame, keys: list[str], a: str, b: str, cfg: AlignConfig, profile: str | None = None) -> DataFrame:
    """``keys`` with the alignment of matrix columns ``a`` and ``b``: error or score, divergence, path and kinematics.

    With a ``profile`` column (positional agreement per row; null: the guides do not fit, error ``guides``) the band is
    steered, and an end that it does not reach gives a null score; without it, an infinite one. A row is one task's work,
    so pairs should be filtered before, with the gate or the signatures; nothing is shuffled here.
    """
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_type = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        kin_type = pa.list_(pa.struct([("v", pa.float64()), ("a", pa.float64()), ("k", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                x, y = Ragged(part.column("_a")), Ragged(part.column("_b"))
                guide = part.column("_p").to_pylist() if profile else None
                cols: list[list] = [[], [], [], [], [], []]
                for r in range(part.num_rows):
                    if profile and guide[r] is None:
                        row = ("guides", None, None, None, None, None)
                    else:
                        g = align(x[r], y[r], cfg, np.array(guide[r], dtype=np.float32) if profile else None)
                        if g.error or (profile and not np.isfinite(g.total)):
                            row = (g.error, None, None, None, None, None)
                        else:
                            n, m = len(x[r]), len(y[r])
                            row = (None, g.score(), g.divergence(n, m, cfg.alpha), len(g.path), [{"i": i, "j": j} for i, j in g.path],
                                   [{"v": v, "a": w, "k": k} for v, w, k in g.kinematics.tolist()])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), path_type, kin_type]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    [*keys, "error", "score", "divergence", "path_len", "path", "kin"],
                )

    nested = "array<array<double>>"
    src = df.select(*keys, F.col(a).cast(nested).alias("_a"), F.col(b).cast(nested).alias("_b"), *([F.col(profile).alias("_p")] if profile else []))
    return src.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + RESULT)


def align_gated(df: DataFrame, keys: list[str], a: str, b: str, verdict: str, cfg: AlignConfig) -> DataFrame:
    """``keys, verdict, error, score``: pairs of unequal dimension have the error ``dimension``, whatever the gate says of them;
    of the others those that the gate blocks have neither error nor score, and only the rest is aligned."""
    first = lambda c: F.size(F.col(c).cast("array<array<double>>")[0])
    fits = F.coalesce(first(a) == first(b), F.lit(True))  # an empty side is the aligner's to report
    done = align_pairs(df.filter(fits & (F.col(verdict) != "block")), keys, a, b, cfg).select(*keys, F.col("error").alias("_e"), "score")
    both = df.select(*keys, verdict, (~fits).alias("_unfit")).join(done, keys, "left")
    return both.select(*keys, verdict, F.when(F.col("_unfit"), "dimension").otherwise(F.col("_e")).alias("error"), "score")
