"""Parameters of the operators, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from hodograph.functions.scalar import WEIGHTS, valid_weights


@dataclass(frozen=True)
class GateConfig:
    w_dense: float = 0.5
    w_sparse: float = 0.5
    threshold: float = 0.5
    budget_ns: int = 10_000_000


@dataclass(frozen=True)
class GraphConfig:
    """``k`` partners of each fact, a static floor, a cutoff among them, and the weights of the channels."""

    k: int = 5
    floor: float = 0.0
    cutoff: float = 0.0
    weights: tuple[float, float, float] = (0.6, 0.25, 0.15)

    def __post_init__(self):
        if not valid_weights(self.weights):
            raise ValueError(f"weights {self.weights} are not a partition of 1")


@dataclass(frozen=True)
class SolverConfig:
    horizon: int = 8
    kappa: float = 1.0
    beta: float = 1.0
    gamma: float = 1.0
    c: float = 100.0
    m: float = 1.0
    min_step: float = 0.002


@dataclass(frozen=True)
class AlignConfig:
    """Band of the alignment, weight of the score in the divergence, and how sparse guides steer the band."""

    window: int = 10
    alpha: float = 0.0
    min_bits: int | None = None
    min_jaccard: float | None = None
    w_min: int = 1
    w_max: int = 10


@dataclass(frozen=True)
class ResolverConfig:
    threshold: float = 10.0
    kappa: float = 1.0
    weights: tuple[float, float, float] = WEIGHTS
