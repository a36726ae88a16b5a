"""Reproducible fixtures from a 64-bit linear congruential generator, made on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hodograph.functions.scalar import WEIGHTS

# Fixed values.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


class Lcg:
    def __init__(self, seed: int):
        self.x = seed % (1 << 64)

    def step(self) -> int:
        self.x = (self.x * MULTIPLIER + INCREMENT) % (1 << 64)
        return self.x

    def unit(self) -> float:
        """53 bits in [0, 1)."""
        return (self.step() >> 11) / (1 << 53)

    def millionth(self) -> float:
        return (self.step() >> 33) % 1_000_000 / 1_000_000


def branches(spark: SparkSession, n: int, per_candidate: int, dominance: float, seed: int = 1, kappa: float = 1.0) -> DataFrame:
    """``n`` branches, ``per_candidate`` to each; with chance ``dominance`` a branch's costs are all alike."""
    import math

    g, rows = Lcg(seed), []
    for i in range(n):
        alike, a, b, c = g.unit() < dominance, g.unit(), g.unit(), g.unit()
        costs = (a, a, a) if alike else (a, b, c)
        action = sum(w * x for w, x in zip(WEIGHTS, costs, strict=True))
        rows.append((0, i, i // per_candidate, *costs, action, math.exp(-action / kappa)))
    return spark.createDataFrame(
        rows, "group_id long, branch long, candidate_id long, s_inertial double, s_geometric double, s_colbert double, action double, amplitude double"
    )


def facts(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Facts in three profiles, each strong in one channel."""
    g, rows = Lcg(seed), []
    for i in range(n):
        x = [0.3 * g.millionth() for _ in range(3)]
        x[i % 3] = 0.7 + 0.3 * g.millionth()
        rows.append((i, *x))
    return spark.createDataFrame(rows, "id long, colbert double, sparse double, relational double")
