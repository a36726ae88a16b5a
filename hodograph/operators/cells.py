"""Cells: dictionary, assignment of vectors, projection of cell walks, and similarity of cell bags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodograph.functions.numeric import finite
from hodograph.operators.vectors import Ragged
from hodograph.runtime import BROADCAST_LIMIT, TooLarge, small_rows

CENTROID, WEIGHTED = "centroid", "weighted"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centroid_matrix(table: DataFrame) -> np.ndarray:
    """Centroids of a one-row dictionary table as a float64 matrix (cells x dimensions).

    Every task gets the matrix, so its size is checked before it is fetched: beyond :data:`BROADCAST_LIMIT` bytes a
    ``TooLarge`` is raised. A ragged dictionary raises ``ValueError``; an empty table gives a matrix without rows.
    """
    numbers = table.agg(F.sum(F.aggregate("centroidi", F.lit(0), lambda s, v: s + F.size(v)))).first()[0]
    if numbers and numbers * 8 > BROADCAST_LIMIT:
        raise TooLarge(f"cell dictionary of {numbers} numbers")
    rows = small_rows(table.select("centroidi").filter("centroidi IS NOT NULL"), 1, "cell dictionary")
    if not rows:
        return np.zeros((0, 1))
    if len({len(v) for v in rows[0][0]}) > 1:
        raise ValueError("centroids of unequal length")
    return np.array(rows[0][0], dtype=np.float64)


def centroid_rows(table: DataFrame) -> DataFrame:
    """``(cell, vec)`` in long form, for a dictionary of any size."""
    return table.select(F.posexplode("centroidi").alias("cell", "vec"))


def dictionary_coherent(k, dim, centroids):
    """Column: a positive number of cells and of dimensions, and centroids that have just these."""
    return F.coalesce((k > 0) & (dim > 0) & (F.size(centroids) == k) & F.forall(centroids, lambda v: F.coalesce(F.size(v) == dim, F.lit(False))), F.lit(False))


def walk_coherent(cells, pos, conf):
    """Column: a step at least, and arrays of one length."""
    return F.coalesce((F.size(cells) > 0) & (F.size(cells) == F.size(pos)) & (F.size(cells) == F.size(conf)), F.lit(False))


def projection_errors(walks: DataFrame, key: str, table: DataFrame, dim: str | None = None) -> DataFrame:
    """``walks`` with ``error``, null where a walk can be projected: ``dictionary`` or ``walk`` for one that is not coherent,
    ``dimension`` where the walk's own (the column ``dim``, if there is one) is not the dictionary's, ``cell`` for a null cell
    or one that the dictionary lacks. A dictionary table without a row counts as not coherent.
    """
    d = table.agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("dk"), F.first("dim").alias("dd"), F.bool_and(dictionary_coherent(F.col("k"), F.col("dim"), F.col("centroidi"))).alias("fine"))
    both = walks.crossJoin(F.broadcast(d))  # one row
    other = (F.col(dim) != F.col("dd")) if dim else F.lit(False)
    lacks = F.exists("celle", lambda c: c.isNull() | (c < 0) | (c >= F.col("dk")))
    error = F.when(~F.coalesce("fine", F.lit(False)), "dictionary").when(~walk_coherent(F.col("celle"), F.col("pos"), F.col("conf")), "walk")
    return both.withColumn("error", error.when(other, "dimension").when(lacks, "cell")).drop("n", "dk", "dd", "fine")


# --- assignment -----------------------------------------------------------------------------------------------------
def assign_cells(matrices: DataFrame, key: str, matrix: str, centroids: np.ndarray) -> DataFrame:
    """``(key, pos, cell, conf)``: the centroid of greatest cosine of every vector, the least cell among equals.

    Null, ragged or empty matrices and vectors of another length give no rows; a zero vector has confidence 0.
    """
    u, kind = unit(centroids), dict(matrices.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                mats = Ragged(part.column(matrix))
                found = [(i, m) for i in range(part.num_rows) if (m := mats[i]) is not None and m.shape[1] == u.shape[1]]
                if not found:
                    continue
                sims = np.round(unit(np.vstack([m for _, m in found])) @ u.T, 12)
                n = [len(m) for _, m in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(np.repeat([i for i, _ in found], n))), pa.array(np.concatenate([np.arange(k) for k in n]).astype(np.int32)),
                     pa.array(sims.argmax(1).astype(np.int32)), pa.array(sims.max(1))],
                    [key, "pos", "cell", "conf"],
                )

    return matrices.select(key, matrix).mapInArrow(run, f"{key} {kind}, pos int, cell int, conf double")


def cell_trajectories(assigned: DataFrame, key: str) -> DataFrame:
    """``(key, celle, pos, conf)``: one row per key, steps in order of position."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "cell", "conf")))
    t = assigned.groupBy(key).agg(steps.alias("s"))
    return t.select(key, F.col("s.cell").alias("celle"), F.col("s.pos").alias("pos"), F.col("s.conf").alias("conf"))


def train_zones(matrices: DataFrame, matrix: str, k: int, seed: int = 0, max_iter: int = 10) -> np.ndarray:
    """Unit centroids of a distributed k-means by cosine over all finite, non-zero vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = matrices.select(F.explode(matrix).alias("v")).filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: finite(x)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine", featuresCol="f").fit(v.select(array_to_vector("v").alias("f")))
    return unit(np.array(model.clusterCenters()))


# --- projection -----------------------------------------------------------------------------------------------------
def project(walks: DataFrame, key: str, centroids: np.ndarray, mode: str = CENTROID) -> DataFrame:
    """``(key, points)``: cell walks as sequences of points, null where the walk is withdrawn.

    ``centroid``: each step's centroid. ``weighted``: the mean of the centroids of a step and its neighbours in the array,
    weighted by confidence (two at the ends). Withdrawn are null or empty walks, arrays of unequal length, a null cell or
    one outside the dictionary, and, if weighted, a window whose weights do not sum to more than 0.
    """
    kind, k = dict(walks.dtypes)[key], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells, pos, conf in zip(*(batch.column(c).to_pylist() for c in ("celle", "pos", "conf")), strict=True):
                out.append(points(cells, pos, conf))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.list_(pa.float64())))], [key, "points"])

    def points(cells, pos, conf):
        if not cells or pos is None or conf is None or not len(cells) == len(pos) == len(conf) or any(c is None or not 0 <= c < k for c in cells):
            return None
        p = centroids[cells]
        if mode == WEIGHTED:
            w = np.array([np.nan if x is None else x for x in conf], dtype=np.float64)
            total, mass = w.copy(), p * w[:, None]
            summed = mass.copy()
            total[1:] += w[:-1]
            summed[1:] += mass[:-1]
            total[:-1] += w[1:]
            summed[:-1] += mass[1:]
            if not (total > 0).all():
                return None
            p = summed / total[:, None]
        return p.tolist()

    return walks.select(key, "celle", "pos", "conf").mapInArrow(run, f"{key} {kind}, points array<array<double>>")


# --- similarity -----------------------------------------------------------------------------------------------------
def cell_bags(trajectories: DataFrame, key: str) -> DataFrame:
    """``(key, cell, mass)``: confidence summed per cell, over the shorter of both arrays; unknown confidences are left out."""
    s = trajectories.filter("celle IS NOT NULL AND conf IS NOT NULL").select(key, F.explode(F.arrays_zip("celle", "conf")).alias("s"))
    s = s.select(key, F.col("s.celle").alias("cell"), F.col("s.conf").cast("double").alias("mass")).filter(F.col("cell").isNotNull() & finite(F.col("mass")))
    return s.groupBy(key, "cell").agg(F.sum("mass").alias("mass"))


def bag_similarity(bags: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``(a, b, similarity)`` for ``pairs(a, b)``: sum of lesser over sum of greater masses; 0 if a bag is empty.

    Both sides of a pair are brought together by (pair, cell) in one aggregation instead of an outer join.
    """
    left = pairs.join(bags.withColumnRenamed(key, "a"), "a").select("a", "b", "cell", F.col("mass").alias("x"), F.lit(0.0).alias("y"))
    right = pairs.join(bags.withColumnRenamed(key, "b"), "b").select("a", "b", "cell", F.lit(0.0).alias("x"), F.col("mass").alias("y"))
    both = left.union(right).groupBy("a", "b", "cell").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = both.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("lo"), F.sum(F.greatest("x", "y")).alias("hi"))
    ratio = F.when(F.col("hi") != 0, F.col("lo") / F.col("hi")).otherwise(F.lit(0.0))
    return pairs.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce(ratio, F.lit(0.0)).alias("similarity"))
