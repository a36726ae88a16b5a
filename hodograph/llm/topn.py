"""Problem 1: the N best items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hodograph.runtime import read


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, n_col: str | None = None) -> DataFrame:
    """``(group, item, score, rank)`` of the ``n`` best-scored items of each group.

    * Order: ``score`` descending, then ``item`` ascending; ranks run from 1.
    * Rows with a null group or item, or with a null, NaN or infinite score, do not count.
    * An item given more than once in a group counts once, with its highest score.
    * ``n_col`` names a column with each row's own limit; the effective limit is the smaller of it (that of
      the best-scored copy) and ``n``. A null limit keeps nothing. ``n < 1`` gives an empty result.
    * Other columns are ignored, whatever their names.

    Copies are reduced with map-side aggregation on (group, item), so no group is gathered for that. The
    literal ``rank <= n`` lets the planner place a group limit before and after the shuffle by group: a task
    sends at most ``n`` rows of a group on, however many it holds.
    """
    src = df.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"),
        (F.col(n_col) if n_col else F.lit(n)).cast("int").alias("n"),
    )
    src = src.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & finite(F.col("s")))
    once = src.groupBy("g", "i").agg(F.max(F.struct("s", "n")).alias("b")).select("g", "i", "b.s", "b.n")
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    top = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.lit(max(n, 0)))
    return top.filter(F.col("rank") <= F.col("n")).select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank"
    )


def _with_k(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    cfg = read(spark, sf_dir, "graph_config").select("graph_id", "k").dropna()
    k_max = cfg.agg(F.max("k")).first()[0] or 0
    # graph_config is a dictionary table; the planner broadcasts it by its file size, else it shuffles.
    edges = read(spark, sf_dir, "edges").select("graph_id", "src", "dst", "score")
    return edges.filter("src <> dst").join(cfg, "graph_id"), int(k_max)


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, k = _with_k(spark, sf_dir)
    return top_n_per_group(edges, "src", "dst", "score", k, "k")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_ranked(spark, sf_dir).select("src", "dst")


QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked}

_RANKED = """
WITH once AS (
  SELECT e.src, e.dst, max(e.score) AS score, max(c.k) AS k
  FROM edges e JOIN graph_config c USING (graph_id)
  WHERE e.src IS NOT NULL AND e.dst IS NOT NULL AND e.src <> e.dst AND isfinite(e.score)
  GROUP BY e.src, e.dst)
SELECT src, dst, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rank
FROM once QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= any_value(k) OVER (PARTITION BY src)
"""
SQL = {
    "p1_found": f"SELECT src, dst FROM ({_RANKED})",
    "p1_ranked": _RANKED,
}
