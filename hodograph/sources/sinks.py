"""Versioned dictionaries, trajectories and reports as files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dictionary_table(spark: SparkSession, centroids: np.ndarray, version: str, metric: str = "cosine") -> DataFrame:
    row = (version, len(centroids), int(centroids.shape[1]), metric, centroids.astype(float).tolist())
    return spark.createDataFrame([row], "versione string, k int, dim int, metric string, centroidi array<array<float>>")


def write_dictionary(table: DataFrame, path: str) -> None:
    """One JSON object with the key ``K``."""
    table.withColumnRenamed("k", "K").coalesce(1).write.mode("overwrite").json(path)


def write_trajectories(trajectories: DataFrame, path: str) -> None:
    """JSON lines, each a map of one fact, for :func:`~hodograph.sources.readers.read_trajectories` with ``lines``."""
    body = F.map_from_arrays(F.array("fact_id"), F.array(F.struct("celle", "pos", "conf")))
    trajectories.select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)


def write_pair_index(pairs: DataFrame, path: str) -> None:
    """JSON lines, each a map from one ``pair_id`` to its category and two texts."""
    body = F.map_from_arrays(F.array("pair_id"), F.array(F.struct("category", "text_a", "text_b")))
    pairs.select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
