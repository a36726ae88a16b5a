"""Queries of whole chains over the captured results."""

from __future__ import annotations

from pyspark.sql import functions as F

from hodograph.functions.numeric import shown
from hodograph.operators import beam as B
from hodograph.operators import flow as W
from hodograph.operators import graph as G
from hodograph.operators import kinematics as K
from hodograph.plans.config import GraphConfig, SolverConfig
from hodograph.plans.q_graph import _graph
from hodograph.plans.q_motion import _pairs
from hodograph.plans.q_walks import _BEST, _DOT, MATS, sound_matrices
from hodograph.runtime import read

CONFIG = GraphConfig(k=5)


def i1_trajectories(spark, sf):
    """Each stored result as a trajectory of its stated dimension: its error, or its length."""
    r = read(spark, sf, "colbert_results").filter("result_id IS NOT NULL")
    r = r.select("result_id", W.trajectory_error(F.col("multivector"), F.col("dim")).alias("error"), F.size("multivector").alias("n"))
    return r.select("result_id", "error", F.when(F.col("error").isNull(), F.col("n")).alias("n_frames")).distinct()


def q5_from_tokens(spark, sf):
    """Each result and the next as a branch: costs are the difference in length, a constant, and the late interaction."""
    p = _pairs(spark, sf).withColumn("s_inertial", F.abs(F.size("a") - F.size("b")) / 10.0).withColumn("s_geometric", F.lit(0.5))
    b = W.branches_from_tokens(p, "result_id")
    return b.select("result_id", *(shown(F.col(c), 7).alias(c) for c in ("s_colbert", "action", "amplitude")))


def _facts(spark, sf):
    """Every result with its successor as a pair; a sound result takes part in as many pairs as it has neighbours."""
    size = lambda c: (F.size(c) * 4).alias("bits_" + c)
    p = _pairs(spark, sf).select(F.col("result_id").alias("pair_id"), "a", "b", size("a"), size("b"))
    return W.sequence_facts(p)


def flow_facts(spark, sf):
    return _facts(spark, sf).select("id", *(shown(F.col(c), 7).alias(c) for c in G.CHANNELS))


def flow_graph(spark, sf):
    """Sequences to facts to the proximity graph."""
    from hodograph.runtime import Scratch

    f = Scratch(spark, "flow").cut(_facts(spark, sf))
    return G.build_graph(f, CONFIG).select("src", "dst", shown(F.col("score"), 6).alias("score"))


def f13_probes(spark, sf):
    """Paths found under each kind of state over one graph of results."""
    from hodograph.runtime import Scratch

    scratch = Scratch(spark, "flow")
    f = scratch.cut(_facts(spark, sf))
    e, nodes = scratch.cut(G.build_graph(f, CONFIG)), f.select(F.col("id").alias("node"))
    frames = K.frame_states(sound_matrices(spark, sf), "result_id", "multivector").withColumnRenamed("result_id", "node")
    out = None
    for kind in (W.CURVATURE, W.RELATIONAL):
        s = W.probe_states(kind, nodes, e, frames)
        paths, _ = B.beam_search(G.adjacency(e), s, s.withColumnRenamed("node", "root"), SolverConfig(), only_paths=True)
        x = paths.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_paths"), F.count_distinct("root").alias("n_roots"), F.bool_and(F.col("cost") >= 0).alias("sound"))
        out = x if out is None else out.union(x)
    return out


def e21_prune(spark, sf):
    """Paths from one root over 400 modular facts, by cost."""
    i = spark.range(200)
    d, s, c = (F.col("id") % 7) / 6.0, (F.col("id") % 5) / 4.0, (F.col("id") % 3) / 2.0
    even = i.select((F.col("id") * 2).alias("id"), d.alias("colbert"), s.alias("sparse"), c.alias("relational"))
    odd = i.select((F.col("id") * 2 + 1).alias("id"), s.alias("colbert"), c.alias("sparse"), d.alias("relational"))
    f = even.union(odd)
    e = G.build_graph(f, GraphConfig(k=5, floor=0.5))
    states = K.node_states(f.select(F.col("id").alias("node")), e)
    paths, _ = B.beam_search(G.adjacency(e), states, states.filter("node = 0").withColumnRenamed("node", "root"), SolverConfig(horizon=4, kappa=0.05))
    return paths.agg(F.count(F.lit(1)).alias("n_paths"), F.round(F.min("cost"), 6).alias("least"), F.round(F.max("cost"), 6).alias("most"))


QUERIES = {f.__name__: f for f in (i1_trajectories, q5_from_tokens, flow_facts, flow_graph, f13_probes, e21_prune)}

_FACTS = f"""{MATS},
p AS (SELECT result_id AS pair_id, a, b FROM pr),
t AS (SELECT pair_id, 0 AS side, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM p UNION ALL SELECT pair_id, 1, unnest(b), generate_subscripts(b, 1) FROM p),
sd AS (SELECT pair_id, side, avg(m) AS d FROM (SELECT x.pair_id, x.side, x.i, max(list_dot_product(x.v, y.v)) AS m FROM t x JOIN t y
        ON x.pair_id = y.pair_id AND x.side = y.side AND x.i <> y.i GROUP BY ALL) GROUP BY ALL),
rl AS (SELECT pair_id, len(a) AS n0, len(b) AS n1, (list_avg({_BEST.format('a', 'b', _DOT)}) + list_avg({_BEST.format('b', 'a', _DOT)})) / 2 AS r FROM p),
facts AS (SELECT rl.pair_id * 2 + s.side AS id, greatest(coalesce(d, 0), 0) AS colbert, (CASE s.side WHEN 0 THEN n0 ELSE n1 END) * 4 / 128.0::DOUBLE AS sparse, greatest(r, 0) AS relational
          FROM rl CROSS JOIN (SELECT unnest([0, 1]) AS side) s LEFT JOIN sd ON sd.pair_id = rl.pair_id AND sd.side = s.side)"""
_NEAR = """
pair AS (SELECT a.id AS src, b.id AS dst, a.colbert * b.colbert AS colbert, a.sparse * b.sparse AS sparse, a.relational * b.relational AS relational
         FROM facts a JOIN facts b ON a.id <> b.id),
ax AS (SELECT *, least((colbert + 1) / 2, 1) AS d, 1 - exp(-10.64 * sparse) AS s, least((relational + 1) / 2, 1) AS c FROM pair),
sc AS (SELECT *, d * 0.6 + s * 0.25 + c * 0.15 AS score, 0.6*(1-d)*(1-d) + 0.25*(1-s)*(1-s) + 0.15*(1-c)*(1-c) AS dist FROM ax),
near AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dist, d + s + c DESC, dst) <= 5)"""

SQL = {
    "i1_trajectories": """WITH r AS (SELECT result_id, multivector AS m, CASE WHEN coalesce(dim <= 0, true) THEN 'no_dimension' WHEN multivector IS NULL THEN 'null'
        WHEN len(list_filter(multivector, lambda v: coalesce(len(v) = dim, false))) < len(multivector) THEN 'ragged' END AS error FROM colbert_results WHERE result_id IS NOT NULL)
        SELECT DISTINCT result_id, error, CASE WHEN error IS NULL THEN len(m) END::INT AS n_frames FROM r""",
    "q5_from_tokens": f"""WITH {MATS}, x AS (SELECT result_id, abs(len(a) - len(b)) / 10.0::DOUBLE AS i,
          greatest(least(1 - greatest(least(list_avg({_BEST.format('a', 'b', 'list_cosine_similarity')}), 1), -1), 1), 0) AS c FROM pr),
        y AS (SELECT *, i * 0.215 + 0.5 * 0.552 + c * 0.233 AS action FROM x)
        SELECT result_id, round(c, 7) + 0.0 AS s_colbert, round(action, 7) AS action, round(exp(-action / 2), 7) AS amplitude FROM y""",
    "flow_facts": f"WITH {_FACTS} SELECT id, round(colbert, 7) AS colbert, round(sparse, 7) AS sparse, round(relational, 7) AS relational FROM facts",
    "flow_graph": f"WITH {_FACTS}, {_NEAR}, {_graph(0.0, 0.0)} SELECT src, dst, round(score, 6) AS score FROM graph",
}
