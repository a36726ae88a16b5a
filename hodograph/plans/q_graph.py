"""Queries of the proximity graph, and of branches and fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hodograph.operators import collapse as C
from hodograph.operators import graph as G
from hodograph.operators.skyline import pareto_front
from hodograph.plans.config import GraphConfig
from hodograph.runtime import read

CONFIG = GraphConfig(k=5, floor=0.2, cutoff=0.25)


def facts(spark, sf):
    """Suppliers as facts with three channels in [0, 1]."""
    s = read(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 10000).alias("colbert"), ((F.col("s_nationkey") + 1) / 25.0).alias("sparse"),
        ((F.col("s_suppkey") * 7919 % 1000) / 1000.0).alias("relational"),
    )


def _round(df, *cols):
    return df.select(*(c for c in df.columns if c not in cols), *(F.round(c, 6).alias(c) for c in cols))


def g1_first_by_id(spark, sf):
    """Facts given repeatedly (a supplier once per nation-mate), the first kept."""
    f = facts(spark, sf)
    again = f.withColumn("ord", F.col("id")).union(f.select((F.col("id") % 50).alias("id"), *G.CHANNELS, (F.col("id") + 1000000).alias("ord")))
    return _round(G.first_by_id(again, "ord"), *G.CHANNELS)


def g3_nearest(spark, sf):
    return _round(G.nearest(facts(spark, sf), CONFIG).select("src", "dst", "rank", "score"), "score")


def g5_percentile(spark, sf):
    n = G.nearest(facts(spark, sf), CONFIG)
    return n.groupBy("src").agg(*(F.round(F.percentile("score", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.0, 0.25, 0.5, 1.0)))


def g8_graph(spark, sf):
    return _round(G.build_graph(facts(spark, sf), CONFIG), "score", *G.CHANNELS)


def g9_sweep(spark, sf):
    """Size and degree spread of the graph at each cutoff."""
    f, out = facts(spark, sf), None
    nodes = f.select(F.col("id").alias("node"))
    for cut in (0.0, 0.25, 0.5, 0.75, 0.9):
        e = G.build_graph(f, GraphConfig(k=5, floor=0.0, cutoff=cut))
        d = G.degrees(nodes, e).agg(F.lit(cut).alias("cutoff"), F.sum("degree").alias("ends"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.var_pop("degree"), 6).alias("var_degree"))
        out = d if out is None else out.union(d)
    return out


def _edges(spark, sf):
    return G.clean_edges(read(spark, sf, "edges").select("src", "dst", "score", *G.CHANNELS))


def _nodes(spark, sf):
    e = read(spark, sf, "edges")
    return e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).filter("node IS NOT NULL").distinct()


def g7_undirected(spark, sf):
    return _edges(spark, sf).select("src", "dst", F.round("score", 6).alias("score"))


def g10_counts(spark, sf):
    n = _nodes(spark, sf).agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.crossJoin(_edges(spark, sf).agg(F.count(F.lit(1)).alias("n_edges")))  # two tables of one row


def g11_edge_between(spark, sf):
    """The edge, if any, between each node and the node twice its number, and between it and its successor."""
    n = _nodes(spark, sf)
    pairs = n.select(F.col("node").alias("a"), (F.col("node") * 2).alias("b")).union(n.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")))
    return _round(G.edges_between(_edges(spark, sf), pairs), "score")


def g12_neighbours(spark, sf):
    return G.adjacency(_edges(spark, sf))


def g13_degrees(spark, sf):
    return G.degrees(_nodes(spark, sf), _edges(spark, sf))


def g14_orphans(spark, sf):
    return G.orphans(_nodes(spark, sf), _edges(spark, sf))


def g15_clustering(spark, sf):
    return _round(G.clustering(_nodes(spark, sf), _edges(spark, sf)), "clustering")


def g16_edges_of(spark, sf):
    """Edges of the node with the most edges (the least such node)."""
    e = _edges(spark, sf)
    top = G.adjacency(e).groupBy("node").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("node"))
    ends = e.withColumn("node", F.explode(F.array("src", "dst")))
    return ends.join(top, "node").select("src", "dst", F.round("score", 6).alias("score"))


def g17_components(spark, sf):
    return G.component_labels(_edges(spark, sf))


def g18_summary(spark, sf):
    return G.summary(_nodes(spark, sf), _edges(spark, sf))


# --- branches -------------------------------------------------------------------------------------------------------
def _branches(spark, sf):
    return C.branches_of(read(spark, sf, "lineitem"))


def q6_branches(spark, sf):
    return _round(_branches(spark, sf).select("group_id", "branch", "candidate_id", "action", "amplitude"), "action", "amplitude")


def q8_collapse(spark, sf):
    return _round(C.collapse(_branches(spark, sf), "group_id", 1.5, 2.0), "action", "psi")


def q11_front(spark, sf):
    """Branches that no other branch dominates."""
    return _round(pareto_front(_branches(spark, sf), C.COSTS).select("group_id", "branch", *C.COSTS), *C.COSTS)


def q12_spread(spark, sf):
    return _round(C.spread(_branches(spark, sf)), "spread")


def q13_adaptive(spark, sf):
    return _round(C.adaptive_front(C.candidate_costs(_branches(spark, sf)), rows=10), *C.COSTS)


def q14_candidate_front(spark, sf):
    """Collapse each order, then the front of the winners' mean costs."""
    b = _branches(spark, sf)
    won = C.collapse(b, "group_id", 1.5, 2.0).select("candidate_id").distinct()
    return _round(pareto_front(C.candidate_costs(b.join(won, "candidate_id", "left_semi")), C.COSTS), *C.COSTS)


def q15_candidate_costs(spark, sf):
    return _round(C.candidate_costs(_branches(spark, sf)), *C.COSTS)


def q17_multi_hop(spark, sf):
    return _round(C.multi_hop(_branches(spark, sf), "group_id", 2.0), "action", "amplitude")


def q18_early_front(spark, sf):
    """How often a front before the collapse changes an order's winner (it may, which is why none is taken there)."""
    from hodograph.functions.scalar import dominates

    b = _branches(spark, sf)
    o = b.select("group_id", F.col("branch").alias("ob"), F.col("candidate_id").alias("oc"), *(F.col(c).alias("o_" + c) for c in C.COSTS))
    rule = (b["group_id"] == o["group_id"]) & dominates([F.col("o_" + c) for c in C.COSTS], [F.col(c) for c in C.COSTS])
    early = b.join(o, rule, "left_anti")
    plain = C.collapse(b, "group_id", 1.5, 2.0).select("group_id", F.col("candidate_id").alias("plain"))
    pruned = C.collapse(early, "group_id", 1.5, 2.0).select("group_id", F.col("candidate_id").alias("pruned"))
    both = plain.join(pruned, "group_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(~F.col("plain").eqNullSafe(F.col("pruned"))).alias("n_changed"))


QUERIES = {
    f.__name__: f
    for f in (
        g1_first_by_id, g3_nearest, g5_percentile, g7_undirected, g8_graph, g9_sweep, g10_counts, g11_edge_between, g12_neighbours, g13_degrees,
        g14_orphans, g15_clustering, g16_edges_of, g17_components, g18_summary, q6_branches, q8_collapse, q11_front, q12_spread, q13_adaptive,
        q14_candidate_front, q15_candidate_costs, q17_multi_hop, q18_early_front,
    )
}

FACTS = """
facts AS (SELECT s_suppkey AS id, abs(s_acctbal) / 10000 AS colbert, (s_nationkey + 1) / 25.0::DOUBLE AS sparse,
                 (s_suppkey * 7919 % 1000) / 1000.0::DOUBLE AS relational FROM supplier)"""


def _near(k: int = 5) -> str:
    return f"""{FACTS},
pair AS (SELECT a.id AS src, b.id AS dst, a.colbert * b.colbert AS colbert, a.sparse * b.sparse AS sparse, a.relational * b.relational AS relational
         FROM facts a JOIN facts b ON a.id <> b.id),
ax AS (SELECT *, least((colbert + 1) / 2, 1) AS d, 1 - exp(-10.64 * sparse) AS s, least((relational + 1) / 2, 1) AS c FROM pair),
sc AS (SELECT *, d * 0.6 + s * 0.25 + c * 0.15 AS score, 0.6*(1-d)*(1-d) + 0.25*(1-s)*(1-s) + 0.15*(1-c)*(1-c) AS dist FROM ax),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dist, d + s + c DESC, dst) AS INTEGER) AS rank FROM sc QUALIFY rank <= {k})"""


def _graph(floor: float, cut: float) -> str:
    return f"""
bar AS (SELECT src, greatest(quantile_cont(score, {cut}), {floor}) AS bar FROM near GROUP BY src),
graph AS (SELECT least(near.src, dst) AS src, greatest(near.src, dst) AS dst, max(score) AS score, max(colbert) AS colbert, max(sparse) AS sparse,
                 max(relational) AS relational FROM near JOIN bar USING (src) WHERE score >= bar GROUP BY 1, 2)"""


EDGES = """
e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(score) AS score FROM edges WHERE src <> dst AND isfinite(score) GROUP BY 1, 2),
nodes AS (SELECT src AS node FROM edges WHERE src IS NOT NULL UNION SELECT dst FROM edges WHERE dst IS NOT NULL),
adj AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
deg AS (SELECT node, count(other) AS degree FROM nodes LEFT JOIN adj USING (node) GROUP BY node)"""
_TRI = """,
tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst),
tn AS (SELECT node, count(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM tri) GROUP BY node),
clu AS (SELECT deg.node, CASE WHEN degree >= 2 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) END AS clustering FROM deg LEFT JOIN tn USING (node))"""
_LAB = """,
lab(node, label) USING KEY (node) AS (
  SELECT node, least(node, min(other)) FROM adj GROUP BY node
  UNION
  SELECT adj.node, min(l.label) FROM lab l JOIN adj ON adj.other = l.node JOIN recurring.lab o ON o.node = adj.node
  WHERE l.label < o.label GROUP BY adj.node)"""
BRANCHES = """
br AS (SELECT *, s_inertial * 0.215 + s_geometric * 0.552 + s_colbert * 0.233 AS action FROM (
         SELECT l_orderkey AS group_id, l_linenumber AS branch, l_suppkey AS candidate_id, l_discount * 10 AS s_inertial, l_tax * 10 AS s_geometric,
                1 - l_quantity / 50 AS s_colbert FROM lineitem)),
cand AS (SELECT group_id, candidate_id, count(*) AS n, sum(exp(-action / 2)) AS psi, min({'a': action, 'b': branch}) AS b
         FROM br WHERE action <= 1.5 AND candidate_id IS NOT NULL GROUP BY 1, 2),
won AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(psi, 9) DESC, candidate_id) = 1)"""
_R = "round(s_inertial, 6) AS s_inertial, round(s_geometric, 6) AS s_geometric, round(s_colbert, 6) AS s_colbert"


def _front(table: str) -> str:
    return f"""NOT EXISTS (SELECT 1 FROM {table} o WHERE o.s_inertial <= b.s_inertial AND o.s_geometric <= b.s_geometric AND o.s_colbert <= b.s_colbert
               AND (o.s_inertial < b.s_inertial OR o.s_geometric < b.s_geometric OR o.s_colbert < b.s_colbert))"""


SQL = {
    "g1_first_by_id": f"""WITH {FACTS}, again AS (SELECT *, id AS ord FROM facts UNION ALL SELECT id % 50, colbert, sparse, relational, id + 1000000 FROM facts)
        SELECT id, round(colbert, 6) AS colbert, round(sparse, 6) AS sparse, round(relational, 6) AS relational
        FROM again QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""",
    "g3_nearest": f"WITH {_near()} SELECT src, dst, rank, round(score, 6) AS score FROM near",
    "g5_percentile": f"""WITH {_near()} SELECT src, round(quantile_cont(score, 0.0), 6) AS p0, round(quantile_cont(score, 0.25), 6) AS p25,
        round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 1.0), 6) AS p100 FROM near GROUP BY src""",
    "g7_undirected": f"WITH {EDGES} SELECT src, dst, round(score, 6) AS score FROM e",
    "g8_graph": f"""WITH {_near()}, {_graph(0.2, 0.25)} SELECT src, dst, round(score, 6) AS score, round(colbert, 6) AS colbert, round(sparse, 6) AS sparse,
        round(relational, 6) AS relational FROM graph""",
    "g9_sweep": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_near()}, {_graph(0.0, c)}, a AS (SELECT src AS node FROM graph UNION ALL SELECT dst FROM graph),
        d AS (SELECT id, count(node) AS degree FROM facts LEFT JOIN a ON a.node = id GROUP BY id)
        SELECT {c}::DOUBLE AS cutoff, CAST(sum(degree) AS BIGINT) AS ends, round(avg(degree), 6) AS mean_degree, round(var_pop(degree), 6) AS var_degree FROM d)"""
        for c in (0.0, 0.25, 0.5, 0.75, 0.9)
    ),
    "g10_counts": f"WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM e) AS n_edges",
    "g11_edge_between": f"""WITH {EDGES}, p AS (SELECT node AS a, node * 2 AS b FROM nodes UNION ALL SELECT node, node + 1 FROM nodes)
        SELECT a, b, round(score, 6) AS score FROM p LEFT JOIN e ON e.src = least(a, b) AND e.dst = greatest(a, b)""",
    "g12_neighbours": f"WITH {EDGES} SELECT node, other FROM adj",
    "g13_degrees": f"WITH {EDGES} SELECT node, degree FROM deg",
    "g14_orphans": f"WITH {EDGES} SELECT node FROM deg WHERE degree = 0",
    "g15_clustering": f"WITH {EDGES}{_TRI} SELECT node, round(clustering, 6) AS clustering FROM clu",
    "g16_edges_of": f"""WITH {EDGES}, top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1)
        SELECT src, dst, round(score, 6) AS score FROM e JOIN top ON src = node OR dst = node""",
    "g17_components": f"WITH RECURSIVE {EDGES}{_LAB} SELECT node, label FROM lab",
    "g18_summary": f"""WITH RECURSIVE {EDGES}{_TRI}{_LAB}
        SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round(avg(degree), 6) AS mean_degree,
               round(var_pop(degree), 6) AS var_degree, count(*) FILTER (WHERE degree = 0) AS n_orphans,
               (SELECT round(avg(clustering), 6) FROM clu) AS mean_clustering,
               (SELECT count(DISTINCT label) FROM lab) + count(*) FILTER (WHERE degree = 0) AS n_components FROM deg""",
    "q6_branches": f"WITH {BRANCHES} SELECT group_id, branch, candidate_id, round(action, 6) AS action, round(exp(-action / 2), 6) AS amplitude FROM br",
    "q8_collapse": f"WITH {BRANCHES} SELECT group_id, candidate_id, b.b AS branch, round(b.a, 6) AS action, round(psi, 6) AS psi, n AS n_branches FROM won",
    "q11_front": f"WITH {BRANCHES}, d AS (SELECT DISTINCT s_inertial, s_geometric, s_colbert FROM br) SELECT group_id, branch, {_R} FROM br b WHERE {_front('d')}",
    "q12_spread": f"""WITH {BRANCHES} SELECT count(*) AS n, round((var_pop(s_inertial) + var_pop(s_geometric) + var_pop(s_colbert))
        / (avg(s_inertial) + avg(s_geometric) + avg(s_colbert)), 6) AS spread FROM br""",
    "q13_adaptive": f"""WITH {BRANCHES}, c AS (SELECT candidate_id, avg(s_inertial) AS s_inertial, avg(s_geometric) AS s_geometric, avg(s_colbert) AS s_colbert
        FROM br WHERE candidate_id IS NOT NULL GROUP BY 1), sp AS (SELECT count(*) <= 10 OR (var_pop(s_inertial) + var_pop(s_geometric) + var_pop(s_colbert))
        / (avg(s_inertial) + avg(s_geometric) + avg(s_colbert)) >= 0.01 AS front FROM c)
        SELECT candidate_id, {_R} FROM c b WHERE NOT (SELECT front FROM sp) OR {_front('c')}""",
    "q14_candidate_front": f"""WITH {BRANCHES}, c AS (SELECT candidate_id, avg(s_inertial) AS s_inertial, avg(s_geometric) AS s_geometric,
        avg(s_colbert) AS s_colbert FROM br WHERE candidate_id IN (SELECT candidate_id FROM won) GROUP BY 1) SELECT candidate_id, {_R} FROM c b WHERE {_front('c')}""",
    "q15_candidate_costs": f"""WITH {BRANCHES}, c AS (SELECT candidate_id, avg(s_inertial) AS s_inertial, avg(s_geometric) AS s_geometric,
        avg(s_colbert) AS s_colbert FROM br WHERE candidate_id IS NOT NULL GROUP BY 1) SELECT candidate_id, {_R} FROM c""",
    "q17_multi_hop": f"""WITH {BRANCHES} SELECT group_id, candidate_id, round(sum(action), 6) AS action, round(exp(-sum(action) / 2), 6) AS amplitude
        FROM br GROUP BY 1, 2""",
    "q18_early_front": f"""WITH {BRANCHES}, early AS (SELECT * FROM br b WHERE NOT EXISTS (SELECT 1 FROM br o WHERE o.group_id = b.group_id AND
        o.s_inertial <= b.s_inertial AND o.s_geometric <= b.s_geometric AND o.s_colbert <= b.s_colbert
        AND (o.s_inertial < b.s_inertial OR o.s_geometric < b.s_geometric OR o.s_colbert < b.s_colbert))),
        c2 AS (SELECT group_id, candidate_id, sum(exp(-action / 2)) AS psi FROM early WHERE action <= 1.5 AND candidate_id IS NOT NULL GROUP BY 1, 2),
        w2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(psi, 9) DESC, candidate_id) = 1)
        SELECT count(*) AS n_groups, count(*) FILTER (WHERE won.candidate_id IS DISTINCT FROM w2.candidate_id) AS n_changed
        FROM won LEFT JOIN w2 USING (group_id)""",
}
