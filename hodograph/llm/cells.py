"""The cell dictionary as a matrix, and long-form steps of trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodograph.operators.cells import centroid_matrix, unit
from hodograph.runtime import read


def dictionary(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Centroids as a float64 matrix (cells x dimensions), its size checked; see :func:`centroid_matrix`."""
    return centroid_matrix(read(spark, sf_dir, "cell_dictionary"))


def steps(trajectories: DataFrame, conf: bool) -> DataFrame:
    """``(fact_id, steps)`` once per fact; steps ``(pos, cell[, conf])`` ascend in ``pos`` and may repeat one.

    A fact given again counts once (the greater value, if they differ). Facts with a null id or a null array are left
    out; steps with a null ``pos`` or cell, and what one array has beyond the shorter other, are left out.
    """
    names = ["pos", "celle"] + ["conf"] * conf
    filled = trajectories.filter(" AND ".join(f"{c} IS NOT NULL" for c in ["fact_id", *names]))
    zipped = F.filter(F.arrays_zip(*names), lambda s: s["pos"].isNotNull() & s["celle"].isNotNull())
    return filled.select("fact_id", F.array_sort(F.array_distinct(zipped)).alias("steps")).groupBy("fact_id").agg(F.max("steps").alias("steps"))


def project_by_join(steps_df: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(fact_id, vec)``: the confidence-weighted mean as a join on the cell, for a dictionary too large to hand out.

    ``centroids(cell, vec)``. The same result as the matrix form; it shuffles steps by cell and sums by dimension.
    """
    s = steps_df.select("fact_id", F.explode("steps").alias("s")).select("fact_id", "s.pos", F.col("s.celle").alias("cell"), "s.conf")
    s = s.groupBy("fact_id", "pos").agg(F.min(F.struct("cell", "conf")).alias("s")).select("fact_id", "s.cell", "s.conf")
    s = s.filter("conf > 0 AND NOT isnan(conf)").withColumn("conf", F.col("conf").cast("double"))
    dims = s.join(centroids, "cell").select("fact_id", "conf", F.posexplode("vec").alias("d", "x"))
    mean = dims.groupBy("fact_id", "d").agg((F.sum(F.col("conf") * F.col("x")) / F.sum("conf")).alias("x"))
    return mean.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("fact_id", F.col("v.x").alias("vec"))
