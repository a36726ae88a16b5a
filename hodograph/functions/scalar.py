"""Scalar fusion, gate, kinematic and branch formulas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hodograph.functions.numeric import ge, gt, known, nan, num, sat01

# Fixed values.
WEIGHTS = (0.215, 0.552, 0.233)
LAMBDA = 10.64


def valid_weights(w) -> bool:
    """Finite, not negative, and summing to 1 within 1e-9."""
    return all(math.isfinite(x) and x >= 0 for x in w) and abs(sum(w) - 1) < 1e-9


def normalize(dense: Column, sparse: Column, colbert: Column, lam: float = LAMBDA) -> tuple[Column, Column, Column]:
    """Axes in [0, 1] or NaN: cosines by ``(x + 1) / 2``, a sum by ``1 - exp(-lam x)``; a bad ``lam`` loses that axis only."""
    good = math.isfinite(lam) and lam > 0
    third = sat01(1 - F.exp(-lam * sparse)) if good else nan()
    return sat01((dense + 1) / 2), third, sat01((colbert + 1) / 2)


def combine(axes, weights=WEIGHTS) -> Column:
    """Weighted sum; NaN for invalid weights. Weights are numbers, checked here, or columns, checked per row."""
    if not isinstance(weights[0], Column):
        return sum((a * w for a, w in zip(axes, weights, strict=True)), F.lit(0.0)) if valid_weights(weights) else nan()
    total = weights[0] + weights[1] + weights[2]
    ok = (F.abs(total - 1) < 1e-9) & known(total)
    for w in weights:
        ok = ok & ge(w, 0.0)
    return F.when(ok, axes[0] * weights[0] + axes[1] * weights[1] + axes[2] * weights[2]).otherwise(nan())


def pareto(a, b) -> Column:
    """``A``, ``B`` or ``-``: which dominates (no worse on all axes, better on one). An unknown axis makes it ``-``."""

    def over(x, y):
        all_ge, any_gt = F.lit(True), F.lit(False)
        for p, q in zip(x, y, strict=True):
            all_ge, any_gt = all_ge & ge(p, q), any_gt | gt(p, q)
        return all_ge & any_gt

    return F.when(over(a, b), "A").when(over(b, a), "B").otherwise("-")


def distance_to_ideal(axes, weights=WEIGHTS) -> Column:
    return sum((w * (1 - a) * (1 - a) for a, w in zip(axes, weights, strict=True)), F.lit(0.0))


# --- gate -----------------------------------------------------------------------------------------------------------
def probe(dense: Column, sparse: Column, w_dense: float = 0.5, w_sparse: float = 0.5) -> Column:
    """Cheap score of two channels; NaN for invalid weights."""
    d, s, _ = normalize(dense, sparse, F.lit(0.0))
    return F.when(known(d) & known(s), d * w_dense + s * w_sparse).otherwise(nan()) if valid_weights((w_dense, w_sparse)) else nan()


def verdict(score: Column, decided: Column, deadline: Column, threshold: float = 0.5) -> Column:
    """``timeout`` at or past the deadline, else ``pass`` for an unknown score or one at the threshold, else ``block``."""
    late = F.coalesce(decided >= deadline, F.lit(False))
    return F.when(late, "timeout").when(~known(score) | (score >= threshold), "pass").otherwise("block")


# --- kinematics -----------------------------------------------------------------------------------------------------
def inertial_action(s, t, beta: float = 1.0, gamma: float = 1.0, c: float = 100.0, m: float = 1.0) -> Column:
    """Cost of going from state ``s`` to ``t`` (velocity, acceleration, curvature).

    Infinite where the change of velocity reaches ``c``; else the kinetic term in its stable form, plus the weighted
    squared change of acceleration and absolute change of curvature. Parameters are numbers or columns.
    """
    beta, gamma, c, m = (num(x) for x in (beta, gamma, c, m))
    r = (t[0] - s[0]) / F.when(c > 0, c)
    kinetic = m * c * c * r * r / (1 + F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    full = kinetic + beta * (t[1] - s[1]) * (t[1] - s[1]) + gamma * F.abs(t[2] - s[2])
    return F.when((c <= 0) | (F.abs(t[0] - s[0]) >= c), F.lit(float("inf"))).otherwise(full)


def lower_bound(cost: Column, depth: Column, horizon: int, min_step: float) -> Column:
    return cost + (horizon - depth) * min_step


def amplitude(action: Column, kappa: float = 1.0) -> Column:
    return F.exp(-action / kappa)


# --- branches -------------------------------------------------------------------------------------------------------
def colbert_cost(similarity: Column) -> Column:
    """``1 - similarity`` within [0, 1]; an unknown similarity costs 1."""
    return F.when(known(similarity), sat01(1 - similarity)).otherwise(F.lit(1.0))


def branch_action(inertial: Column, geometric: Column, colbert: Column, weights=WEIGHTS) -> Column:
    return inertial * weights[0] + geometric * weights[1] + colbert * weights[2]


def candidate_bound(n: Column, least: Column, kappa: float = 1.0) -> tuple[Column, Column]:
    """``(lower, upper)`` of a candidate's amplitude sum; zeros without branches or with an unknown cost."""
    low = F.when((n > 0) & known(least), F.exp(-least / kappa)).otherwise(F.lit(0.0))
    return low, low * num(n)


def dominates(a, b) -> Column:
    """``a`` costs no more than ``b`` on all axes and less on one."""
    no_more, less = F.lit(True), F.lit(False)
    for x, y in zip(a, b, strict=True):
        no_more, less = no_more & ge(y, x), less | gt(y, x)
    return no_more & less
