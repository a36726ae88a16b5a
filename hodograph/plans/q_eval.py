"""Queries of the evaluation analytics. Stored edges are scored pairs, their graph is the category, channels are levels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hodograph.functions import scalar as S
from hodograph.functions.numeric import finite, known, shown
from hodograph.operators import beam as B
from hodograph.operators import evaluate as E
from hodograph.plans import q_graph, q_motion
from hodograph.plans.config import GraphConfig, SolverConfig
from hodograph.plans.q_scalar import AXES, KNOWN
from hodograph.runtime import read


def _scores(spark, sf):
    """``(category, level, score)``: each stored pair once per channel."""
    e = read(spark, sf, "edges").select("graph_id", *q_graph.G.CHANNELS)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("score")) for c in q_graph.G.CHANNELS)))
    s = e.select(F.col("graph_id").alias("category"), each.alias("x")).select("category", "x.level", "x.score")
    return s.filter(finite(F.col("score")) & F.col("category").isNotNull())


def e1_auc(spark, sf):
    """One AUC: do edges of related ends (relational at least 0.5) score higher in the sparse channel?"""
    e = read(spark, sf, "edges").filter(finite(F.col("relational")) & finite(F.col("sparse")))
    s = e.select(F.lit("sparse").alias("level"), (F.col("relational") >= 0.5).alias("category"), F.col("sparse").alias("score"))
    return E.auc_one_vs_rest(s, "level", "category", "score").filter("category").select(F.round("auc", 9).alias("auc"))


def e2_means(spark, sf):
    return _scores(spark, sf).groupBy("category", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


def e3_one_vs_rest(spark, sf):
    return E.auc_one_vs_rest(_scores(spark, sf), "level", "category", "score").select("level", "category", F.round("auc", 9).alias("auc"))


def e4_pairwise(spark, sf):
    return E.auc_pairwise(_scores(spark, sf), "level", "category", "score").select("level", "a", "b", F.round("auc", 9).alias("auc"))


def _gate(spark, sf):
    e = read(spark, sf, "edges").select("graph_id", "relational", S.probe(F.col("colbert"), F.col("sparse"), 0.3, 0.7).alias("gate"))
    return e.filter(finite(F.col("relational"))).withColumn("related", F.col("relational") >= 0.5)


def e6_sweep(spark, sf):
    s = E.threshold_sweep(_gate(spark, sf), "related", "gate")
    return s.select("theta", F.round("fnr", 9).alias("fnr"), F.round("tnr", 9).alias("tnr"))


def e7_bands(spark, sf):
    band = F.when(F.col("relational") >= 0.6, "band1").when(F.col("relational") >= 0.3, "band2").otherwise("band3")
    g = _gate(spark, sf).filter(known(F.col("gate"))).groupBy(band.alias("band"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gate"), 9).alias("mean_gate"), F.round(F.avg("relational"), 9).alias("mean_relational"))


def e9_path_sets(spark, sf):
    """Overlap of the beam's paths under two weightings of the action, per root."""
    adj, states, roots = q_motion._search(spark, sf)
    cfgs = tuple(SolverConfig(kappa=1000.0, beta=b) for b in (1.0, 50.0))
    n = B.path_overlap(adj, states, roots, cfgs)
    if n is not None:
        return n.select("root", F.round(F.col("n_both") / (F.col("n_first") + F.col("n_second") - F.col("n_both")), 9).alias("jaccard"))
    runs = [B.beam_search(adj, states, roots, cfg)[0].select("root", q_motion._text().alias("path")) for cfg in cfgs]
    return E.path_set_jaccard(*runs, "root", "path").select("root", F.round("jaccard", 9).alias("jaccard"))


def e10_spearman(spark, sf):
    n = q_graph.G.nearest(q_graph.facts(spark, sf), q_graph.CONFIG).select("src", "rank", F.round("score", 9).alias("score"), F.round("sparse", 9).alias("sparse"))
    return E.spearman_by_index(n, "src", "rank", "score", "sparse").select("src", "n", F.round("rho", 6).alias("rho"))


def e11_grid(spark, sf):
    """Mean action and amplitude over the proximity graph for each of the 54 settings, in one pass over its edges."""
    nodes, e = q_motion._proximity(spark, sf)
    state = q_motion.K.STATE
    s = q_motion.K.node_states(nodes, e)
    both = q_graph.G.adjacency(e).join(s, "node").join(s.select(F.col("node").alias("other"), *(F.col(c).alias("o" + c) for c in state)), "other")
    for name, values in (("beta", (0.5, 1.0, 2.0)), ("gamma", (0.5, 1.0, 2.0)), ("c", (10.0, 100.0)), ("kappa", (2.0, 5.0, 10.0))):
        both = both.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    act = S.inertial_action([F.col(c) for c in state], [F.col("o" + c) for c in state], F.col("beta"), F.col("gamma"), F.col("c"))
    each = both.select("beta", "gamma", "c", "kappa", act.alias("action")).filter(F.col("action") < float("inf"))
    amp = F.exp(-F.col("action") / F.col("kappa"))
    return each.groupBy("beta", "gamma", "c", "kappa").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("action"), 7).alias("mean_action"), F.round(F.avg(amp), 7).alias("mean_amplitude"))


def e12_quantiles(spark, sf):
    picks = {"low": "0", "q25": "CAST((total - 1) * 0.25D AS BIGINT)", "q50": "CAST((total - 1) * 0.5D AS BIGINT)", "q90": "CAST((total - 1) * 0.9D AS BIGINT)", "high": "total - 1"}
    return E.truncating_quantiles(_scores(spark, sf), ["category", "level"], "score", picks)


def e13_deltas(spark, sf):
    """Gaps between the channels of each pair, summarised per graph: mean, greatest, and the values at floor(n p)."""
    e = read(spark, sf, "edges").filter(finite(F.col("colbert")) & finite(F.col("score"))).select("graph_id", F.round(F.abs(F.col("score") - F.col("colbert")), 6).alias("d"))
    q = E.truncating_quantiles(e, ["graph_id"], "d", {"p90": "floor(total * 0.9D)", "p99": "floor(total * 0.99D)"})
    m = e.groupBy("graph_id").agg(F.round(F.avg("d"), 9).alias("mean_gap"), F.max("d").alias("max_gap"))
    return m.join(q, "graph_id")


def e14_bands(spark, sf):
    """Documents per band of their source's prefix."""
    band = F.when(F.startswith("source", F.lit("fan")), 1).when(F.startswith("source", F.lit("disc")), 2).otherwise(3)
    return read(spark, sf, "documents").select("source").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def e15_worst(spark, sf):
    """The fifteen nodes with the largest mean gap between score and channel."""
    e = read(spark, sf, "edges").filter(finite(F.col("colbert")) & finite(F.col("score")) & F.col("src").isNotNull())
    g = e.groupBy("src").agg(F.round(F.avg(F.abs(F.col("score") - F.col("colbert"))), 9).alias("gap"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("gap").desc(), F.col("src")).limit(15)


def e16_representatives(spark, sf):
    """Each graph's first source node, as a root to start from."""
    return read(spark, sf, "edges").filter("src IS NOT NULL").groupBy("graph_id").agg(F.min("src").alias("root"))


def e17_stuck_roots(spark, sf):
    """Roots of the stored graph that have edges but no path with a step: all their neighbours are in their own state."""
    e = q_graph._edges(spark, sf).fillna(0.0)
    nodes = q_graph._nodes(spark, sf)
    adj, states = q_graph.G.adjacency(e), q_motion.K.node_states(nodes, e)
    linked = adj.select(F.col("node").alias("root")).distinct()
    # Whether there is a first step is settled by the first level.
    paths, _ = B.beam_search(adj, states, states.withColumnRenamed("node", "root"), SolverConfig(horizon=1, kappa=1000.0))
    return linked.join(paths.filter(F.size("path") > 0).select("root").distinct(), "root", "left_anti")


def e18_permutations(spark, sf):
    """Texts of evaluation items against each other: equal words in another order, commas and full stops aside."""
    words = F.array_sort(F.filter(F.split(F.regexp_replace("text", "[,.]", ""), r"\s+"), lambda w: w != ""))
    i = read(spark, sf, "eval_items").select("item_id", "text", words.alias("w"))
    g = i.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("t"))
    return g.agg(F.sum("n").alias("n_items"), F.count_if(F.col("t") > 1).alias("n_permuted"))


def e20_stress(spark, sf):
    """Edges of the proximity graph of generated facts, for growing numbers of them."""
    out = None
    for n in (50, 200, 800):
        i = spark.range(n)
        r = lambda m: ((F.col("id") * 2654435761 + m * 40503) % 1000003) / 1000003.0
        f = i.select("id", r(1).alias("colbert"), r(2).alias("sparse"), r(3).alias("relational"))
        x = q_graph.G.build_graph(f, GraphConfig(k=8)).agg(F.lit(n).alias("n_facts"), F.count(F.lit(1)).alias("n_edges"))
        out = x if out is None else out.union(x)
    return out


def e22_dissection(spark, sf):
    """The cheapest path of each root, step by step, with the cost so far."""
    adj, states, roots = q_motion._search(spark, sf)
    best = B.exhaustive(adj, states, roots, q_motion.SHORT)
    s = F.concat(F.array("root"), "path")
    step = best.select("root", F.posexplode("path").alias("i", "node"), s.alias("all")).withColumn("from", F.element_at("all", F.col("i") + 1))
    a = q_motion.K.edge_actions(q_motion._proximity(spark, sf)[1], states).select(F.col("node").alias("from"), F.col("other").alias("node"), "action")
    w = Window.partitionBy("root").orderBy("i")
    return step.join(a, ["from", "node"]).select("root", "i", "node", F.round(F.sum("action").over(w), 7).alias("cost_so_far"))


QUERIES = {
    f.__name__: f
    for f in (
        e1_auc, e2_means, e3_one_vs_rest, e4_pairwise, e6_sweep, e7_bands, e9_path_sets, e10_spearman, e11_grid, e12_quantiles, e13_deltas, e14_bands,
        e15_worst, e16_representatives, e17_stuck_roots, e18_permutations, e20_stress, e22_dissection,
    )
}

SC = """raw AS (SELECT graph_id AS category, unnest(['colbert', 'sparse', 'relational']) AS level, unnest([colbert, sparse, relational]) AS score FROM edges),
sc AS (SELECT * FROM raw WHERE isfinite(score) AND category IS NOT NULL)"""
_GATE = f"""{AXES}, ga AS (SELECT relational, CASE WHEN {KNOWN.format('d')} AND {KNOWN.format('s')} THEN d * 0.3 + s * 0.7 END AS gate FROM axes WHERE isfinite(relational))"""
PROX, EDGES_FULL, _levels, _ends, _ACT, _near = q_motion.PROX, q_motion.EDGES_FULL, q_motion._levels, q_motion._ends, q_motion._ACT, q_graph._near


def _grid_sql() -> str:
    act = lambda b, g, c: (
        f"CASE WHEN abs(t.v - s.v) < {c} THEN {c}*{c}*((t.v-s.v)/{c})*((t.v-s.v)/{c})/(1+sqrt(1-((t.v-s.v)/{c})*((t.v-s.v)/{c})))+{b}*(t.a-s.a)*(t.a-s.a)+{g}*abs(t.k-s.k) END"
    )
    return f"WITH {PROX}, g AS (SELECT b, g, c, kappa FROM (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS b) CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS g) CROSS JOIN (SELECT unnest([10.0, 100.0])::DOUBLE AS c) CROSS JOIN (SELECT unnest([2.0, 5.0, 10.0])::DOUBLE AS kappa)), x AS (SELECT b AS beta, g AS gamma, c, kappa, {act('b', 'g', 'c')} AS action FROM g CROSS JOIN adj JOIN sta s ON s.node = adj.node JOIN sta t ON t.node = adj.other) SELECT beta, gamma, c, kappa, count(action) AS n, round(avg(action), 7) AS mean_action, round(avg(exp(-action / kappa)), 7) AS mean_amplitude FROM x GROUP BY ALL"


SQL = {
    "e1_auc": """WITH x AS (SELECT sparse AS s, relational >= 0.5 AS p FROM edges WHERE isfinite(relational) AND isfinite(sparse)),
        c AS (SELECT s, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE NOT p) AS q FROM x GROUP BY s), w AS (SELECT *, sum(q) OVER (ORDER BY s) AS below FROM c)
        SELECT round(sum(p * below) / (sum(p) * sum(q))::DOUBLE, 9) AS auc FROM w""",
    "e2_means": f"WITH {SC} SELECT category, level, count(*) AS n, round(avg(score), 9) AS mean_score FROM sc GROUP BY ALL",
    "e3_one_vs_rest": f"""WITH {SC}, c AS (SELECT level, category, score, count(*) AS n FROM sc GROUP BY ALL),
        w AS (SELECT *, sum(n) OVER (PARTITION BY level ORDER BY score) - sum(n) OVER (PARTITION BY level, category ORDER BY score) AS below FROM c),
        t AS (SELECT level, count(*) AS total FROM sc GROUP BY level)
        SELECT level, category, round(sum(n * below) / (sum(n) * (any_value(total) - sum(n)))::DOUBLE, 9) AS auc FROM w JOIN t USING (level) GROUP BY level, category""",
    "e4_pairwise": f"""WITH {SC}, c AS (SELECT level, category, score, count(*) AS n FROM sc GROUP BY ALL),
        p AS (SELECT x.level, x.category AS x, y.category AS y, sum(x.n * y.n) FILTER (WHERE x.score >= y.score) AS wins, sum(x.n * y.n) AS total
              FROM c x JOIN c y ON x.level = y.level AND x.category <> y.category GROUP BY ALL)
        SELECT level, least(x, y) AS a, greatest(x, y) AS b, round(max(coalesce(wins, 0) / total::DOUBLE), 9) AS auc FROM p GROUP BY 1, 2, 3""",
    "e6_sweep": f"""WITH {_GATE}, t AS (SELECT unnest(range(101)) / 100.0::DOUBLE AS theta)
        SELECT theta, round(count(*) FILTER (WHERE relational >= 0.5 AND gate < theta) / count(*) FILTER (WHERE relational >= 0.5)::DOUBLE, 9) AS fnr,
               round(count(*) FILTER (WHERE relational < 0.5 AND gate < theta) / count(*) FILTER (WHERE relational < 0.5)::DOUBLE, 9) AS tnr
        FROM ga CROSS JOIN t WHERE gate IS NOT NULL GROUP BY theta""",
    "e7_bands": f"""WITH {_GATE} SELECT CASE WHEN relational >= 0.6 THEN 'band1' WHEN relational >= 0.3 THEN 'band2' ELSE 'band3' END AS band, count(*) AS n,
        round(avg(gate), 9) AS mean_gate, round(avg(relational), 9) AS mean_relational FROM ga WHERE gate IS NOT NULL GROUP BY 1""",
    "e10_spearman": f"""WITH {_near()}, r AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY round(score, 9), rank) AS ra,
        row_number() OVER (PARTITION BY src ORDER BY round(sparse, 9), rank) AS rb FROM near) SELECT src, count(*) AS n, round(corr(ra, rb), 6) + 0.0 AS rho FROM r GROUP BY src""",
    "e11_grid": _grid_sql(),
    "e12_quantiles": f"""WITH {SC}, l AS (SELECT category, level, list(score ORDER BY score) AS x FROM sc GROUP BY ALL) SELECT category, level, x[1] AS low,
        x[1 + trunc((len(x) - 1) * 0.25::DOUBLE)::INT] AS q25, x[1 + trunc((len(x) - 1) * 0.5::DOUBLE)::INT] AS q50, x[1 + trunc((len(x) - 1) * 0.9::DOUBLE)::INT] AS q90, x[-1] AS high FROM l""",
    "e13_deltas": """WITH d AS (SELECT graph_id, round(abs(score - colbert), 6) AS d FROM edges WHERE isfinite(colbert) AND isfinite(score)),
        l AS (SELECT graph_id, list(d ORDER BY d) AS x, round(avg(d), 9) AS m FROM d GROUP BY graph_id)
        SELECT graph_id, m AS mean_gap, x[-1] AS max_gap, x[1 + floor(len(x) * 0.9::DOUBLE)::INT] AS p90, x[1 + floor(len(x) * 0.99::DOUBLE)::INT] AS p99 FROM l""",
    "e14_bands": "SELECT CASE WHEN starts_with(source, 'fan') THEN 1 WHEN starts_with(source, 'disc') THEN 2 ELSE 3 END AS band, count(*) AS n FROM documents GROUP BY 1",
    "e15_worst": """SELECT src, round(avg(abs(score - colbert)), 9) AS gap, count(*) AS n FROM edges WHERE isfinite(colbert) AND isfinite(score) AND src IS NOT NULL
        GROUP BY src ORDER BY gap DESC, src LIMIT 15""",
    "e16_representatives": "SELECT graph_id, min(src) AS root FROM edges WHERE src IS NOT NULL GROUP BY graph_id",
    "e9_path_sets": f"""WITH {PROX}, x AS (WITH {_levels(True, 8)}, {_ends(8)} SELECT root, array_to_string(path, '>') AS p FROM done),
        y AS (WITH {_levels(True, 8, 50)}, {_ends(8)} SELECT root, array_to_string(path, '>') AS p FROM done),
        b AS (SELECT root, p, max(i) AS i, max(j) AS j FROM (SELECT root, p, 1 AS i, 0 AS j FROM x UNION ALL SELECT root, p, 0, 1 FROM y) GROUP BY root, p)
        SELECT root, round(sum(i * j) / count(*), 9) AS jaccard FROM b GROUP BY root""",
    "e17_stuck_roots": f"""WITH {EDGES_FULL}, en AS (SELECT unnest([src, dst]) AS node, score, coalesce(nullif(colbert, '-inf'::DOUBLE), 0) AS c,
            (coalesce(nullif(sparse, '-inf'::DOUBLE), 0) + coalesce(nullif(relational, '-inf'::DOUBLE), 0)) / 2 AS r FROM ef),
        s0 AS (SELECT node, avg(score) AS v, avg(c) AS a, avg(r) AS k FROM en GROUP BY node), ad AS (SELECT src AS x, dst AS y FROM ef UNION ALL SELECT dst, src FROM ef)
        SELECT x AS root FROM ad JOIN s0 s ON s.node = x JOIN s0 t ON t.node = y GROUP BY x HAVING bool_and(s.v = t.v AND s.a = t.a AND s.k = t.k)""",
    "e18_permutations": r"""WITH i AS (SELECT text, list_sort(list_filter(regexp_split_to_array(regexp_replace(text, '[,.]', '', 'g'), '\s+'), lambda w: w <> '')) AS w FROM eval_items),
        g AS (SELECT w, count(*) AS n, count(DISTINCT text) AS t FROM i GROUP BY w) SELECT CAST(sum(n) AS BIGINT) AS n_items, count(*) FILTER (WHERE t > 1) AS n_permuted FROM g""",
    "e22_dissection": f"""WITH {PROX}, {_levels(False)}, {_ends()}, b AS (SELECT root, min({{'c': round(cost, 12), 'p': path}}).p AS p FROM done WHERE isfinite(cost) GROUP BY root),
        st AS (SELECT root, unnest(range(len(p)))::INT AS i, unnest(p) AS node, unnest(list_concat([root], p[:-2])) AS f FROM b)
        SELECT root, i, st.node, round(sum({_ACT.format(t="t.", s="s.")}) OVER (PARTITION BY root ORDER BY i), 7) AS cost_so_far
        FROM st JOIN sta s ON s.node = f JOIN sta t ON t.node = st.node""",
}
