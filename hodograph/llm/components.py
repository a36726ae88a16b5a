"""Problem 5: one group identifier for all records that are linked directly or over others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hodograph.operators.graph import local_stars
from hodograph.runtime import Scratch, read, unbroadcast


def _least(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, Observation]:
    """``(v, m)``: the least member of each vertex's cluster; and how many vertices keep the state from being stars.

    In a star a vertex that is not the least has one link. The minima are written, so that the joins on them have plain
    exchanges on both sides, which adaptive execution can split where one vertex holds many rows.
    """
    seen = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
    # Partial aggregation keeps a hot vertex from being gathered.
    m = seen.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    loose = Observation()
    m = m.observe(loose, F.count_if((F.col("m") < F.col("v")) & (F.col("n") > 1)).alias("loose")).select("v", "m")
    return scratch.cut(m, "least"), loose


def _round(e: DataFrame, least: DataFrame) -> DataFrame:
    """Each vertex sends its cluster to the cluster's least member, and that member to the others."""
    # An edge (lo, hi) is seen from both ends: hi knows lo and itself, lo knows hi and itself.
    at_hi = e.join(unbroadcast(least.select(F.col("v").alias("hi"), F.col("m").alias("mh"))), "hi")
    both = at_hi.join(unbroadcast(least.select(F.col("v").alias("lo"), F.col("m").alias("ml"))), "lo")
    pairs = F.array(*(F.struct(F.col(m).alias("lo"), F.col(v).alias("hi")) for m in ("mh", "ml") for v in ("hi", "lo")))
    return local_stars(both.select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.lo", "p.hi"), "lo", "hi").distinct()


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """``(node_id, group_id)`` of every vertex with at least one link; ``group_id`` is the least vertex of its group.

    Hash-to-min over pairs: a vertex's cluster set is kept as rows, never as one array, so the set that the
    least member of a huge group collects stays distributed. As every cluster holds its vertex and is sent with
    its least member, a state is stored once as ``(lo, hi)``. Rounds end when the state is all stars, which no round
    changes; they grow with the logarithm of a group's diameter. Each round is a written table; the one before it is
    deleted. Before links are exchanged, what a task holds of a cluster is made a star around its least member, a combiner that
    spares rounds and rows.

    Pairs with a null side or with equal sides link nothing. Repeated and reversed pairs are one link. An empty
    input gives an empty result. Other columns are ignored. Raises ``RuntimeError`` if ``max_rounds`` do not do.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    e = scratch.cut(local_stars(pairs, a, b).distinct(), "state")
    for _ in range(max_rounds):
        least, loose = _least(e, scratch)
        if not loose.get["loose"]:
            tops = e.select(F.col("lo").alias("node_id"), F.col("lo").alias("group_id")).distinct()
            return e.select(F.col("hi").alias("node_id"), F.col("lo").alias("group_id")).union(tops)
        before, e = e, scratch.cut(_round(e, least), "state")
        scratch.drop(before, least)
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(read(spark, sf_dir, "edges"), "src", "dst")


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each group."""
    return p5_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))


QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes}

_GROUPS = """
WITH RECURSIVE link AS (
  SELECT src AS v, dst AS u FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
grp(node_id, group_id) USING KEY (node_id) AS (
  SELECT v, least(v, min(u)) FROM link GROUP BY v
  UNION
  SELECT link.v, min(g.group_id) FROM grp g JOIN link ON link.u = g.node_id JOIN recurring.grp o ON o.node_id = link.v
  WHERE g.group_id < o.group_id GROUP BY link.v)
"""
SQL = {
    "p5_found": _GROUPS + "SELECT node_id, group_id FROM grp",
    "p5_sizes": _GROUPS + "SELECT group_id, count(*) AS n_nodes FROM grp GROUP BY group_id",
}
