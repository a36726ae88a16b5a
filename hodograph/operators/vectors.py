"""Late interaction and other comparisons of token matrices, as one Arrow pass per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


class Ragged:
    """Matrices of a nested list column, as slices of one flat buffer."""

    def __init__(self, col: pa.Array):
        self.valid = np.asarray(col.is_valid())
        self.outer = np.asarray(col.offsets, dtype=np.int64)
        inner = col.flatten()
        n = np.diff(self.outer)
        n[~self.valid] = 0
        self.row = np.concatenate([[0], np.cumsum(n)])
        size = np.diff(np.asarray(inner.offsets, dtype=np.int64))
        size[~np.asarray(inner.is_valid())] = 0
        self.size = size
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.asarray(inner.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)

    def __getitem__(self, i: int) -> np.ndarray | None:
        """Row ``i`` as a matrix; None if null, empty or not rectangular."""
        a, b = self.row[i], self.row[i + 1]
        if not self.valid[i] or a == b or not (d := self.size[a]) or (self.size[a:b] != d).any():
            return None
        return self.flat[self.at[a] : self.at[b]].reshape(b - a, d)


def _unit(x: np.ndarray) -> np.ndarray | None:
    n = np.linalg.norm(x, axis=1)
    return None if np.isnan(n).any() or (n == 0).any() else x / n[:, None]


def maxsim(q: np.ndarray | None, d: np.ndarray | None) -> float:
    """Mean over query tokens of the best cosine among document tokens; NaN for an empty, ragged, zero or NaN side."""
    if q is None or d is None or q.shape[1] != d.shape[1]:
        return NAN
    uq, ud = _unit(q), _unit(d)
    return NAN if uq is None or ud is None else float(np.clip(np.mean((uq @ ud.T).max(axis=1)), -1, 1))


def maxsim32(q, d) -> float:
    """The same in single precision, as an external engine would return it."""
    if q is None or d is None or q.shape[1] != d.shape[1]:
        return NAN
    uq, ud = _unit(q), _unit(d)
    return NAN if uq is None or ud is None else float(np.mean((uq.astype(np.float32) @ ud.astype(np.float32).T).max(axis=1)))


def summed(a, b) -> float:
    """Sum of best raw inner products, both ways, halved; not divided by the number of tokens. 0 on an empty side."""
    if a is None or b is None:
        return 0.0
    g = a @ b.T
    return float((g.max(axis=1).sum() + g.max(axis=0).sum()) / 2)


def relational(a, b) -> float:
    """Mean of both directions' average best raw inner product; 0 on an empty side."""
    if a is None or b is None:
        return 0.0
    g = a @ b.T
    return float((g.max(axis=1).mean() + g.max(axis=0).mean()) / 2)


def length_ratio(a, b) -> float:
    """``|n - m| / (n + m)``; larger is less alike."""
    if a is None or b is None:
        return NAN
    return abs(len(a) - len(b)) / (len(a) + len(b))


def self_dense(a, _=None) -> float:
    """Mean over tokens of the best raw inner product with another token; 0 for fewer than two."""
    if a is None or len(a) < 2:
        return 0.0
    g = a @ a.T
    np.fill_diagonal(g, -np.inf)
    return float(g.max(axis=1).mean())


def self_dense_loop(a, _=None) -> float:
    """The degenerate variant that lets a token meet itself."""
    return 0.0 if a is None else float((a @ a.T).max(axis=1).mean())


def self_cosine(a, _=None) -> float:
    """Mean best cosine with another token; tokens whose best is negative leave the sum and the count."""
    u = None if a is None or len(a) < 2 else _unit(a)
    if u is None:
        return 0.0
    g = u @ u.T
    np.fill_diagonal(g, -np.inf)
    best = g.max(axis=1)
    best = best[best >= 0]
    return float(best.mean()) if len(best) else 0.0


PAIR = {"maxsim": maxsim, "maxsim32": maxsim32, "summed": summed, "relational": relational, "length_ratio": length_ratio}
SELF = {"self_dense": self_dense, "self_dense_loop": self_dense_loop, "self_cosine": self_cosine}


def score_matrices(df: DataFrame, keys: list[str], a: str, b: str | None, measures: dict) -> DataFrame:
    """``keys`` plus one double per measure of the matrices in columns ``a`` and ``b``. Any callable can be a measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                x = Ragged(part.column("_a"))
                y = Ragged(part.column("_b")) if b else x
                rows = [[f(x[i], y[i]) for f in measures.values()] for i in range(part.num_rows)]
                vals = np.array(rows, dtype=np.float64).reshape(-1, len(measures))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(vals[:, j]) for j in range(len(measures)))], [*keys, *measures])

    src = df.select(*keys, F.col(a).cast("array<array<double>>").alias("_a"), *([F.col(b).cast("array<array<double>>").alias("_b")] if b else []))
    types = dict(df.dtypes)
    return src.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + [f"{m} double" for m in measures]))
