"""Whole chains: sequences to facts, facts to a graph, a graph to paths under a chosen kind of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodograph.functions.scalar import branch_action, colbert_cost
from hodograph.operators import kinematics as K
from hodograph.operators.vectors import PAIR, SELF, score_matrices

CURVATURE, RELATIONAL = "curvature", "relational"


def trajectory_error(matrix: Column, dim: Column) -> Column:
    """Why a matrix is no trajectory of this dimension, or null: ``no_dimension``, ``null`` or ``ragged``. No rows are fine."""
    flat = F.forall(matrix, lambda v: F.coalesce(F.size(v) == dim, F.lit(False)))
    return F.when(F.coalesce(dim <= 0, F.lit(True)), "no_dimension").when(matrix.isNull(), "null").when(~flat, "ragged")


def sequence_facts(pairs: DataFrame) -> DataFrame:
    """``(id, colbert, sparse, relational)`` of ``pairs(pair_id, a, b, bits_a, bits_b)``: side a is fact 2p, side b 2p + 1.

    Channels: a sequence's likeness to itself, its signature's share of bits, and the pair's relation, clamped at 0.
    """
    s = score_matrices(pairs, ["pair_id", "bits_a", "bits_b"], "a", "b", {
        "da": lambda a, b: SELF["self_dense"](a), "db": lambda a, b: SELF["self_dense"](b), "rel": PAIR["relational"]})
    sides = F.explode(F.array(*(
        F.struct((F.col("pair_id") * 2 + i).alias("id"), F.col(d).alias("colbert"), (F.col(b) / 128.0).alias("sparse")) for i, d, b in ((0, "da", "bits_a"), (1, "db", "bits_b"))
    )))
    f = s.select(sides.alias("f"), F.greatest("rel", F.lit(0.0)).alias("relational")).select("f.*", "relational")
    return f.select("id", F.greatest("colbert", F.lit(0.0)).alias("colbert"), "sparse", "relational")


def branches_from_tokens(pairs: DataFrame, key: str, kappa: float = 2.0) -> DataFrame:
    """``(key, s_colbert, action, amplitude)`` of ``pairs(key, a, b, s_inertial, s_geometric)``: the late interaction of both
    token matrices becomes the third cost; an unknown similarity costs 1."""
    s = score_matrices(pairs, [key, "s_inertial", "s_geometric"], "a", "b", {"similarity": PAIR["maxsim"]})
    s = s.withColumn("s_colbert", colbert_cost(F.col("similarity")))
    s = s.withColumn("action", branch_action(F.col("s_inertial"), F.col("s_geometric"), F.col("s_colbert")))
    return s.select(key, "s_colbert", "action", F.exp(-F.col("action") / kappa).alias("amplitude"))


def probe_states(kind: str, nodes: DataFrame, edges: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """``(node, v, a, k)`` for a search over the same adjacency: ``relational`` from the edges, ``curvature`` from the last
    frame of each node's sequence in ``frames(node, pos, v, a, k)``. Nodes without either have zeros."""
    if kind == RELATIONAL:
        return K.node_states(nodes, edges)
    if kind != CURVATURE or frames is None:
        raise ValueError(f"no states of kind {kind}")
    return nodes.select("node").join(K.last_states(frames, "node"), "node", "left").fillna(0.0, K.STATE)
