"""Kinematic states of frames and of graph nodes, frame graphs and their actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodograph.functions.numeric import dot, norm
from hodograph.functions.scalar import inertial_action
from hodograph.operators.graph import adjacency

STATE = ["v", "a", "k"]


def cosine(x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """0 where a vector is zero."""
    return F.when((nx > 0) & (ny > 0), F.greatest(F.least(dot(x, y) / (nx * ny), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))


def frame_states(matrices: DataFrame, key: str, matrix: str) -> DataFrame:
    """``(key, pos, v, a, k)``: a frame's length, its change, and its angle to the frame before; ``a = k = 0`` at first."""
    f = matrices.select(key, F.posexplode(matrix).alias("pos", "vec")).withColumn("v", norm(F.col("vec")))
    w = Window.partitionBy(key).orderBy("pos")
    f = f.withColumn("pv", F.lag("v").over(w)).withColumn("pvec", F.lag("vec").over(w))
    angle = F.acos(cosine(F.col("vec"), F.col("pvec"), F.col("v"), F.col("pv")))
    zero = F.lit(0.0)
    return f.select(key, "pos", "v", F.coalesce(F.col("v") - F.col("pv"), zero).alias("a"), F.when(F.col("pv").isNull(), zero).otherwise(angle).alias("k"))


def last_states(states: DataFrame, key: str) -> DataFrame:
    """State of each sequence's last frame."""
    return states.groupBy(key).agg(F.max_by(F.struct(*STATE), "pos").alias("s")).select(key, *(f"s.{c}" for c in STATE))


def node_states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, v, a, k)``: means over a node's edges of score, first channel, and the mean of the other two; zeros without."""
    e = edges.select("src", "dst", "score", "colbert", ((F.col("sparse") + F.col("relational")) / 2).alias("rest"))
    both = e.withColumn("node", F.explode(F.array("src", "dst")))
    s = both.groupBy("node").agg(F.avg("score").alias("v"), F.avg("colbert").alias("a"), F.avg("rest").alias("k"))
    return nodes.select("node").join(s, "node", "left").fillna(0.0, STATE)


def frame_graph(matrices: DataFrame, key: str, matrix: str, near: float = 0.7, reach: int = 2, stride: int = 64, twice: bool = False) -> DataFrame:
    """``(src, dst, score)``: frames of one sequence linked to the next ``reach`` and to all of cosine ``near`` or more.

    A frame's id is ``key * stride + pos``. Each pair occurs once, with ``src < dst``; if ``twice``, a near one that is also
    alike occurs once for either reason.
    """
    f = matrices.select(key, F.posexplode(matrix).alias("i", "x")).withColumn("nx", norm(F.col("x")))
    g = f.select(key, F.col("i").alias("j"), F.col("x").alias("y"), F.col("nx").alias("ny"))
    p = f.join(g, key).filter("i < j").withColumn("score", cosine(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
    close, alike = F.col("j") - F.col("i") <= reach, F.col("score") >= near
    p = p.filter(close | alike)
    if twice:
        p = p.withColumn("why", F.explode(F.when(close & alike, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return p.select((F.col(key) * stride + F.col("i")).alias("src"), (F.col(key) * stride + F.col("j")).alias("dst"), "score")


def edge_actions(edges: DataFrame, states: DataFrame, **params: float) -> DataFrame:
    """``(node, other, action)`` for both directions of every edge."""
    s = states.select("node", *STATE)
    t = states.select(F.col("node").alias("other"), *(F.col(c).alias("o" + c) for c in STATE))
    both = adjacency(edges).join(s, "node").join(t, "other")
    return both.select("node", "other", inertial_action([F.col(c) for c in STATE], [F.col("o" + c) for c in STATE], **params).alias("action"))


def least_action(actions: DataFrame, fallback: float = 0.002) -> DataFrame:
    """One row: the least positive finite action, or the fallback."""
    ok = (F.col("action") > 0) & (F.col("action") < float("inf"))
    return actions.agg(F.coalesce(F.min(F.when(ok, F.col("action"))), F.lit(fallback)).alias("min_step"))
