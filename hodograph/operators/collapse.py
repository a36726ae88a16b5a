"""Branches, their collapse to a winner, and Pareto fronts of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hodograph.functions.numeric import known
from hodograph.functions.scalar import amplitude, branch_action, candidate_bound
from hodograph.operators.skyline import pareto_front

COSTS = ["s_inertial", "s_geometric", "s_colbert"]
# Up to so many rows, or from this spread on, the front is taken.
DIRECT_ROWS, DIRECT_SPREAD = 256, 0.01


def branches_of(lineitem: DataFrame, kappa: float = 2.0) -> DataFrame:
    """Line items as branches: the supplier is the candidate, the order the decision they compete in."""
    b = lineitem.select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("branch"), F.col("l_suppkey").alias("candidate_id"),
        (F.col("l_discount") * 10).alias("s_inertial"), (F.col("l_tax") * 10).alias("s_geometric"), (1 - F.col("l_quantity") / 50).alias("s_colbert"),
    )
    b = b.withColumn("action", branch_action(*(F.col(c) for c in COSTS)))
    return b.withColumn("amplitude", amplitude(F.col("action"), kappa))


def coherent(branches: DataFrame, threshold: float) -> DataFrame:
    """Branches with a candidate, a known action not above the threshold and a known amplitude."""
    return branches.filter(F.col("candidate_id").isNotNull() & known(F.col("action")) & (F.col("action") <= threshold) & known(F.col("amplitude")))


def bounds(branches: DataFrame, threshold: float, kappa: float) -> DataFrame:
    g = coherent(branches, threshold).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_branches"), F.min("action").alias("least"))
    low, up = candidate_bound(F.col("n_branches"), F.col("least"), kappa)
    return g.select("candidate_id", "n_branches", low.alias("lower"), up.alias("upper"))


def collapse(branches: DataFrame, group: str, threshold: float, kappa: float) -> DataFrame:
    """``(group, candidate_id, branch, action, psi, n_branches)``: the winner of each group.

    Amplitudes of a candidate's coherent branches add up; the greatest sum wins, the least id among equals, and is shown
    by its branch of least action. Candidates whose bound is under the incumbent's are left out first, which changes
    nothing if amplitudes follow from actions. A group without a coherent branch has no winner. One aggregation by
    (group, candidate) carries everything; only candidates meet per group.
    """
    c = coherent(branches, threshold).groupBy(group, "candidate_id").agg(
        F.count(F.lit(1)).alias("n_branches"), F.sum("amplitude").alias("psi"), F.min(F.struct("action", "branch")).alias("b")
    )
    low, up = candidate_bound(F.col("n_branches"), F.col("b.action"), kappa)
    c = c.withColumn("lower", low).withColumn("upper", up)
    w = Window.partitionBy(group)
    inc = F.max(F.struct("upper", -F.col("candidate_id"), "lower")).over(w)
    c = c.withColumn("inc", inc["lower"]).filter(F.col("upper") >= F.col("inc"))
    rank = F.row_number().over(w.orderBy(F.round("psi", 9).desc(), "candidate_id"))
    return c.withColumn("r", rank).filter("r = 1").select(group, "candidate_id", "b.branch", "b.action", "psi", "n_branches")


def candidate_costs(branches: DataFrame) -> DataFrame:
    """Mean costs of each candidate; branches without one are left out."""
    return branches.filter("candidate_id IS NOT NULL").groupBy("candidate_id").agg(*(F.avg(c).alias(c) for c in COSTS))


def spread(df: DataFrame, costs: list[str] = COSTS) -> DataFrame:
    """One row: rows and the sum of population variances over the sum of means; 0 if that is not positive."""
    means, variances = sum((F.avg(c) for c in costs), F.lit(0.0)), sum((F.var_pop(c) for c in costs), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.when(means > 0, variances / means), F.lit(0.0)).alias("spread"))


def adaptive_front(df: DataFrame, costs: list[str] = COSTS, rows: int = DIRECT_ROWS, least: float = DIRECT_SPREAD) -> DataFrame:
    """The front if the rows are few or spread, else all rows. One row decides on the driver."""
    s = spread(df, costs).first()
    return pareto_front(df, costs) if s["n"] <= rows or s["spread"] >= least else df


def multi_hop(branches: DataFrame, path: str, kappa: float) -> DataFrame:
    """Hops of a path composed: actions add, so amplitudes multiply."""
    return branches.groupBy(path, "candidate_id").agg(F.sum("action").alias("action")).withColumn("amplitude", amplitude(F.col("action"), kappa))
