"""Files that hold dictionaries, trajectories, pair sets and captured payloads. Schemas are declared, never inferred."""

from __future__ import annotations

import io
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "versione string, K int, dim int, metric string, centroidi array<array<float>>"
TRAJECTORY = "celle:array<int>,pos:array<int>,conf:array<float>"
PAIR = "category:string,text_a:string,text_b:string"
TENSORS = "pair_id string, side string, dense array<array<double>>, ids array<bigint>, weights array<float>, status array<bigint>"
MEMBER = re.compile(r"^(?P<pair>.+)_(?P<side>[ab])_(?P<part>dense|ids|weights|status)$")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON dictionary as a one-row table ``versione, k, dim, metric, centroidi``."""
    return spark.read.schema(DICTIONARY).json(path, multiLine=True).withColumnRenamed("K", "k")


def _map_file(spark: SparkSession, path: str, value: str, lines: bool = False) -> DataFrame:
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "v")).select("key", "v.*")


def read_trajectories(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON maps from fact to ``celle, pos, conf``: one in a file, or one on each line, which any number of tasks can read."""
    return _map_file(spark, path, TRAJECTORY, lines).withColumnRenamed("key", "fact_id")


def read_pair_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON maps from pair to its category and two texts, one in a file or one on each line."""
    return _map_file(spark, path, PAIR, lines).withColumnRenamed("key", "pair_id")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Captured server answers, one per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))


def _sides(content: bytes) -> dict[tuple[str, str], dict[str, np.ndarray]]:
    found: dict[tuple[str, str], dict[str, np.ndarray]] = defaultdict(dict)
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        for name in z.files:
            if m := MEMBER.match(name):
                found[m["pair"], m["side"]][m["part"]] = z[name]
    return found


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """NPZ files of pairs: members ``<pair>_<a|b>_<dense|ids|weights|status>``, of any integer or float width.

    A side without one of its members has null there; other members are left out. One file is one task's work.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for (pair, side), x in sorted(_sides(content).items()):
                    cast = lambda part, kind, x=x: x[part].astype(kind).tolist() if part in x else None
                    rows.append((pair, side, cast("dense", np.float64), cast("ids", np.int64), cast("weights", np.float32), cast("status", np.int64)))
                yield pd.DataFrame(rows, columns=["pair_id", "side", "dense", "ids", "weights", "status"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, TENSORS)


def token_frames(ids: Column, weights: Column) -> Column:
    """One frame per token as stored, without hygiene."""
    return F.transform(F.arrays_zip(ids.alias("t"), weights.alias("w")), lambda s: F.array(F.struct(s["t"].alias("token"), s["w"].alias("weight"))))
