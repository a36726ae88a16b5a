"""Queries of cells, alignment, kinematics and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from hodograph.functions.numeric import known, shown
from hodograph.functions.scalar import verdict
from hodograph.operators import align as A
from hodograph.operators import beam as B
from hodograph.operators import cells as Z
from hodograph.operators import graph as G
from hodograph.operators import kinematics as K
from hodograph.operators import walks as W
from hodograph.plans import q_graph
from hodograph.plans.config import AlignConfig, SolverConfig
from hodograph.plans.q_graph import FACTS, _graph, _near
from hodograph.plans.q_walks import _BEST, MATS, sound_matrices
from hodograph.runtime import Scratch, read, widen


# --- cells ----------------------------------------------------------------------------------------------------------
def _centroids(spark, sf):
    return Z.centroid_matrix(read(spark, sf, "cell_dictionary"))


def _facts(spark, sf):
    t = read(spark, sf, "trajectories").select("fact_id", "celle", "pos", "conf").filter("fact_id IS NOT NULL")
    return t.groupBy("fact_id").agg(F.max(F.struct("celle", "pos", "conf")).alias("t")).select("fact_id", "t.*", F.expr("CAST(substr(fact_id, 6) AS BIGINT)").alias("n"))


def z1_dictionary(spark, sf):
    d = Z.centroid_rows(read(spark, sf, "cell_dictionary"))
    return d.select(F.col("cell").cast("long").alias("cell"), F.size("vec").alias("dim"), F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 7).alias("norm"))


def z2_ruzicka(spark, sf):
    """Similarity of the cell bags of each fact and the next."""
    f = _facts(spark, sf)
    ids = f.select("n")
    pairs = ids.select(F.col("n").alias("a")).join(ids.select((F.col("n") - 1).alias("a")), "a").withColumn("b", F.col("a") + 1)
    return Z.bag_similarity(Z.cell_bags(f, "n"), pairs, "n").select("a", "b", shown(F.col("similarity"), 6).alias("similarity"))


def _points(spark, sf, mode):
    p = Z.project(widen(_facts(spark, sf), "fact_id"), "fact_id", _centroids(spark, sf), mode)
    long = p.select("fact_id", F.posexplode_outer("points").alias("step", "x"))
    return long.select("fact_id", "step", shown(F.col("x")[0], 7).alias("first"), shown(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), 7).alias("length"))


def b3_centroid_points(spark, sf):
    return _points(spark, sf, Z.CENTROID)


def b4_weighted_points(spark, sf):
    return _points(spark, sf, Z.WEIGHTED)


def b5_checks(spark, sf):
    """Why a walk gives no points: the dictionary, the walk, another dimension, or a cell that there is not."""
    d = read(spark, sf, "cell_dictionary")
    return Z.projection_errors(_facts(spark, sf), "fact_id", d).select("fact_id", "error")


def _assigned(spark, sf):
    return Z.assign_cells(widen(sound_matrices(spark, sf), "result_id"), "result_id", "multivector", _centroids(spark, sf))


def y4_assign(spark, sf):
    return _assigned(spark, sf).select("result_id", "pos", "cell", shown(F.col("conf"), 7).alias("conf"))


def y6_trajectories(spark, sf):
    t = Z.cell_trajectories(_assigned(spark, sf), "result_id")
    return t.select("result_id", F.array_join(F.col("celle").cast("array<string>"), " ").alias("cells"), F.size("pos").alias("n_steps"))


def y7_report(spark, sf):
    a = _assigned(spark, sf)
    per = a.groupBy("result_id").agg(F.count_distinct("cell").alias("c")).agg(F.round(F.avg("c"), 6).alias("mean_cells"), F.percentile("c", F.lit(0.5)).alias("median_cells"))
    all_ = a.agg(F.count_distinct("cell").alias("used_cells"), F.round(F.avg("conf"), 7).alias("mean_conf"), F.round(F.percentile("conf", F.lit(0.1)), 7).alias("p10_conf"))
    return per.crossJoin(all_)  # two tables of one row


def y3_zones(spark, sf):
    """A trained dictionary: vectors per cell and whether confidences are cosines."""
    m = sound_matrices(spark, sf)
    c = Z.train_zones(m, "multivector", 256)
    a = Z.assign_cells(widen(m, "result_id"), "result_id", "multivector", c)
    return a.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("conf").between(-1, 1)).alias("sound"))


# --- alignment ------------------------------------------------------------------------------------------------------
def _pairs(spark, sf):
    m = widen(sound_matrices(spark, sf), "result_id")
    a = m.select("result_id", F.col("multivector").alias("a"), F.col("tokens").alias("ta"))
    return a.join(m.select((F.col("result_id") - 1).alias("result_id"), F.col("multivector").alias("b"), F.col("tokens").alias("tb")), "result_id")


def d2_align(spark, sf):
    """Alignment of each result and the next in a band of 10; an end out of the band has no finite score."""
    r = A.align_pairs(_pairs(spark, sf), ["result_id"], "a", "b", AlignConfig(window=10, alpha=0.5))
    ok = F.col("score") < float("inf")
    return r.select("result_id", F.when(ok, F.round("score", 7)).alias("score"), F.when(ok, F.round("divergence", 7)).alias("divergence"), F.when(ok, F.col("path_len")).alias("path_len"))


def d4_kinematics(spark, sf):
    """Along the paths: mean error length, total curvature and largest acceleration."""
    r = A.align_pairs(_pairs(spark, sf), ["result_id"], "a", "b", AlignConfig(window=25))
    k = r.select("result_id", F.explode("kin").alias("k"))
    return k.groupBy("result_id").agg(F.round(F.avg("k.v"), 6).alias("mean_velocity"), F.round(F.sum("k.k"), 6).alias("curvature"), F.round(F.max("k.a"), 6).alias("most_acceleration"))


def _guided(spark, sf):
    """Pairs with guides: one frame per token, the token's number being the head of its digest."""
    frames = lambda c: F.transform(c, lambda t: F.array(F.struct(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long").alias("token"), F.lit(1).cast("float").alias("weight"))))
    p = _pairs(spark, sf).filter("ta IS NOT NULL AND tb IS NOT NULL").withColumn("ga", frames("ta")).withColumn("gb", frames("tb"))
    fits = (F.size("ga") == F.size("a")) & (F.size("gb") == F.size("b"))
    p = p.withColumn("profile", F.when(fits, W.positional_profile(F.col("ga"), F.col("gb"))))
    sa = W.signatures(p.select("result_id", F.col("ga").alias("frames")), "result_id")
    sb = W.signatures(p.select("result_id", F.col("gb").alias("frames")), "result_id").select("result_id", F.col("sig0").alias("b0"), F.col("sig1").alias("b1"))
    s = [F.col(x) for x in ("sig0", "sig1", "b0", "b1")]
    p = p.join(sa, "result_id").join(sb, "result_id")
    return p.withColumn("overlap", W.overlap(*s)).withColumn("jaccard", W.signature_jaccard(*s).cast("float"))


def d8_guided(spark, sf):
    """Guided alignment of pairs whose signatures share at least two bits; the guard comes before the costly step."""
    g = _guided(spark, sf).filter("overlap >= 2")
    r = A.align_pairs(g, ["result_id", "overlap"], "a", "b", AlignConfig(window=10, w_min=1, w_max=10), "profile")
    return r.select("result_id", "overlap", "error", shown(F.col("score"), 7).alias("score"), "path_len")


def d7_default_guard(spark, sf):
    g = _guided(spark, sf).filter(F.col("jaccard") >= F.lit(0.65).cast("float"))
    r = A.align_pairs(g, ["result_id"], "a", "b", AlignConfig(window=10, min_jaccard=0.65), "profile")
    return r.select("result_id", "error", shown(F.col("score"), 7).alias("score"))


def e5_levels(spark, sf):
    """Pairs kept and mean score at each level: the late interaction of the pair alone (L1), then alignments behind the guard
    with shared bits 0, 2, 4, 5 and Jaccard 0, .5, .65, .8.

    The guard only drops pairs, so each pair is aligned once for all levels."""
    from hodograph.operators.vectors import score_matrices, summed

    g = _guided(spark, sf)
    r = A.align_pairs(g, ["result_id", "overlap", "jaccard"], "a", "b", AlignConfig(window=10, w_min=1, w_max=10), "profile")
    levels = [(f"L{i}", F.col("overlap") >= t) for i, t in zip(range(2, 6), (0, 2, 4, 5), strict=True)]
    levels += [(f"L{i}", F.col("jaccard") >= F.lit(t).cast("float")) for i, t in zip(range(6, 10), (0.0, 0.5, 0.65, 0.8), strict=True)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), c.alias("kept")) for n, c in levels)))
    x = r.select("score", each.alias("l")).select("score", "l.level", "l.kept").filter("kept")
    first = score_matrices(g, ["result_id"], "a", "b", {"score": summed})
    x = x.select("level", "score").union(first.select(F.lit("L1").alias("level"), "score"))
    return x.groupBy("level").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.avg("score"), 6).alias("mean_score"))


def i4_gated(spark, sf):
    """Alignment behind the gate: dense is the pair's single best cosine, sparse its shared tokens; blocked pairs get none."""
    from hodograph.functions.scalar import probe
    from hodograph.operators.vectors import score_matrices

    p = _pairs(spark, sf).withColumn("shared", F.coalesce(F.size(F.array_intersect("ta", "tb")), F.lit(0)) / 100.0)
    best = score_matrices(p, ["result_id"], "a", "b", {"dense": lambda a, b: float((Z.unit(a) @ Z.unit(b).T).max())})
    p = p.join(best, "result_id").withColumn("verdict", verdict(probe(F.col("dense"), F.col("shared")), F.lit(0), F.lit(1), 0.4))
    g = A.align_gated(p, ["result_id"], "a", "b", "verdict", AlignConfig(window=10))
    return g.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_aligned"), F.count("error").alias("n_errors"))


# --- kinematics -----------------------------------------------------------------------------------------------------
def _states(spark, sf):
    return K.frame_states(sound_matrices(spark, sf), "result_id", "multivector")


def k3_states(spark, sf):
    return _states(spark, sf).select("result_id", "pos", *(shown(F.col(c), 6).alias(c) for c in K.STATE))


def f12_last_states(spark, sf):
    return K.last_states(_states(spark, sf), "result_id").select("result_id", *(shown(F.col(c), 6).alias(c) for c in K.STATE))


def f14_frame_graph(spark, sf):
    g = K.frame_graph(sound_matrices(spark, sf), "result_id", "multivector")
    return g.select("src", "dst", shown(F.col("score"), 6).alias("score"))


def f14_directed(spark, sf):
    """The directed twin: a step to each of the next two frames, and one more to every later frame that is like it."""
    g = K.frame_graph(sound_matrices(spark, sf), "result_id", "multivector", twice=True)
    return g.select("src", "dst", shown(F.col("score"), 6).alias("score"))


def f15_min_step(spark, sf):
    """Least positive action over the frame graph, both ways."""
    s = _states(spark, sf).select((F.col("result_id") * 64 + F.col("pos")).alias("node"), *K.STATE)
    a = K.edge_actions(K.frame_graph(sound_matrices(spark, sf), "result_id", "multivector"), s)
    return K.least_action(a.filter("action > 1e-9")).select(F.round("min_step", 8).alias("min_step"))


def _proximity(spark, sf):
    f = q_graph.facts(spark, sf)
    return f.select(F.col("id").alias("node")), G.build_graph(f, q_graph.CONFIG)


def f11_node_states(spark, sf):
    n, e = _proximity(spark, sf)
    return K.node_states(n, e).select("node", *(shown(F.col(c), 7).alias(c) for c in K.STATE))


def e19_actions(spark, sf):
    """Distribution of the actions over the stored edges."""
    nodes, e = q_graph._nodes(spark, sf), q_graph._edges(spark, sf)
    a = K.edge_actions(e, K.node_states(nodes, e.fillna(0.0)), c=100.0).filter("action = action")
    q = [F.round(F.percentile("action", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)]
    return a.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("action"), 6).alias("least"), *q, F.round(F.max("action"), 6).alias("most"), F.count_if(F.col("action") < 0.0020001).alias("n_small"))


# --- search ---------------------------------------------------------------------------------------------------------
#: The default horizon; all simple paths, which :func:`B.exhaustive` goes through, are looked at up to three steps.
SOLVER = SolverConfig(kappa=1000.0)
SHORT = SolverConfig(horizon=3, kappa=1000.0)


def _search(spark, sf):
    nodes, e = _proximity(spark, sf)
    scratch = Scratch(spark, "search")
    e = scratch.cut(e, "graph")
    states = scratch.cut(K.node_states(nodes, e), "states")
    return G.adjacency(e), states, states.withColumnRenamed("node", "root")


def _text(path="path"):
    return F.array_join(F.col(path).cast("array<string>"), ">")


def f7_beam(spark, sf):
    paths, _ = B.beam_search(*_search(spark, sf), SOLVER, only_paths=True)
    return paths.select("root", _text().alias("path"), F.round("cost", 7).alias("cost"))


def f6_levels(spark, sf):
    _, levels = B.beam_search(*_search(spark, sf), SOLVER, amplitudes=False)
    return levels.select("root", "depth", "n_generated", "n_kept")


def f17_exhaustive(spark, sf):
    return B.exhaustive(*_search(spark, sf), SHORT).select("root", F.round("cost", 7).alias("cost"))


def f18_deviation(spark, sf):
    """By how much the beam's cheapest path exceeds the cheapest of all."""
    adj, states, roots = _search(spark, sf)
    paths, _ = B.beam_search(adj, states, roots, SHORT)
    beam = paths.groupBy("root").agg(F.min("cost").alias("beam"))
    both = beam.join(B.exhaustive(adj, states, roots, SHORT), "root")
    gap = F.greatest(F.col("beam") - F.col("cost"), F.lit(0.0))
    return both.agg(F.count(F.lit(1)).alias("n_roots"), F.round(F.avg(gap), 7).alias("mean_gap"), F.round(F.max(gap), 7).alias("max_gap"), F.bool_and(F.col("beam") >= F.col("cost") - 1e-9).alias("sound"))


def f16_throughput(spark, sf):
    """Nodes made and kept at horizons 1, 2, 3, 4, 5 and 8. A level does not depend on how many follow, so one search has them all."""
    _, levels = B.beam_search(*_search(spark, sf), SOLVER, amplitudes=False)
    each = levels.withColumn("horizon", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5, 8))))).filter("depth <= horizon")
    return each.groupBy("horizon").agg(F.sum("n_generated").alias("n_generated"), F.sum("n_kept").alias("n_kept"))


QUERIES = {
    f.__name__: f
    for f in (
        z1_dictionary, z2_ruzicka, b3_centroid_points, b4_weighted_points, b5_checks, y3_zones, y4_assign, y6_trajectories, y7_report, d2_align, d4_kinematics,
        d7_default_guard, d8_guided, e5_levels, i4_gated, k3_states, f6_levels, f7_beam, f11_node_states, f12_last_states, f14_frame_graph, f14_directed, f15_min_step,
        f16_throughput, f17_exhaustive, f18_deviation, e19_actions,
    )
}

CEN = "cen AS (SELECT generate_subscripts(centroidi, 1) - 1 AS cell, unnest(centroidi)::DOUBLE[] AS v FROM cell_dictionary)"
FACT = """fact AS (SELECT DISTINCT fact_id, celle, pos, conf, CAST(substr(fact_id, 6) AS BIGINT) AS n FROM trajectories WHERE fact_id IS NOT NULL)"""
_STEPS = f"""{CEN}, {FACT},
ok AS (SELECT *, celle IS NOT NULL AND pos IS NOT NULL AND conf IS NOT NULL AND len(celle) > 0 AND len(celle) = len(pos) AND len(celle) = len(conf)
         AND len(list_filter(celle, lambda c: c IS NULL)) = 0 AND list_min(celle) >= 0 AND list_max(celle) < (SELECT count(*) FROM cen) AS fine FROM fact),
st AS (SELECT fact_id, unnest(celle) AS cell, unnest(conf)::DOUBLE AS w, unnest(range(len(celle))) AS step FROM ok WHERE fine)"""
ASSIGN = f"""{MATS}, {CEN}, tv AS (SELECT result_id, unnest(mv) AS v, (generate_subscripts(mv, 1) - 1)::INT AS pos FROM res),
asg AS (SELECT result_id, pos, cen.cell::INT AS cell, round(list_cosine_similarity(tv.v, cen.v), 12) AS conf FROM tv CROSS JOIN cen
        QUALIFY row_number() OVER (PARTITION BY result_id, pos ORDER BY round(list_cosine_similarity(tv.v, cen.v), 12) DESC, cen.cell) = 1)"""
KIN = f"""{MATS}, fr AS (SELECT result_id, (generate_subscripts(mv, 1) - 1)::INT AS pos, unnest(mv) AS x FROM res),
s0 AS (SELECT *, sqrt(list_dot_product(x, x)) AS v, lag(x) OVER w AS px FROM fr WINDOW w AS (PARTITION BY result_id ORDER BY pos)),
ks AS (SELECT result_id, pos, v, coalesce(v - sqrt(list_dot_product(px, px)), 0) AS a,
         CASE WHEN px IS NULL THEN 0 ELSE acos(greatest(least(list_cosine_similarity(x, px), 1), -1)) END AS k FROM s0),
fg AS (SELECT a.result_id * 64 + a.pos AS src, a.result_id * 64 + b.pos AS dst, list_cosine_similarity(a.x, b.x) AS score FROM fr a JOIN fr b
         ON a.result_id = b.result_id AND a.pos < b.pos WHERE b.pos - a.pos <= 2 OR list_cosine_similarity(a.x, b.x) >= 0.7)"""
_ACT = """CASE WHEN abs({t}v - {s}v) >= 100 THEN 'inf'::DOUBLE ELSE
 10000 * (({t}v - {s}v) / 100) * (({t}v - {s}v) / 100) / (1 + sqrt(1 - (({t}v - {s}v) / 100) * (({t}v - {s}v) / 100)))
 + ({t}a - {s}a) * ({t}a - {s}a) + abs({t}k - {s}k) END"""
PROX = f"""{_near()}, {_graph(0.2, 0.25)},
adj AS (SELECT src AS node, dst AS other FROM graph UNION ALL SELECT dst, src FROM graph),
ends AS (SELECT unnest([src, dst]) AS node, score, colbert, (sparse + relational) / 2 AS rest FROM graph),
sta AS (SELECT id AS node, coalesce(avg(ends.score), 0) AS v, coalesce(avg(ends.colbert), 0) AS a, coalesce(avg(rest), 0) AS k FROM facts LEFT JOIN ends ON node = id GROUP BY id)"""


EDGES_FULL = """ef AS (SELECT src, dst, e.s AS score, e.c AS colbert, e.p AS sparse, e.r AS relational FROM (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max({'s': score, 'c': coalesce(colbert, '-inf'::DOUBLE), 'p': coalesce(sparse, '-inf'::DOUBLE), 'r': coalesce(relational, '-inf'::DOUBLE)}) AS e
  FROM edges WHERE src <> dst AND isfinite(score) GROUP BY 1, 2))"""


def _levels(pruned: bool, horizon: int = 3, beta: float = 1) -> str:
    ctes = ["l0 AS (SELECT node AS root, node, v, a, k, 0.0::DOUBLE AS cost, []::BIGINT[] AS path FROM sta)"]
    for d in range(1, horizon + 1):
        same = "AND NOT (t.v = s.v AND t.a = s.a AND t.k = s.k)" if pruned else ""
        ctes.append(
            f"""g{d} AS (SELECT s.root, t.node, t.v, t.a, t.k, s.cost + {_ACT.format(t="t.", s="s.").replace("+ (t.a", f"+ {beta} * (t.a")} AS cost, list_append(s.path, t.node) AS path
            FROM l{d - 1} s JOIN adj ON adj.node = s.node JOIN sta t ON t.node = adj.other WHERE adj.other <> s.root AND NOT list_contains(s.path, adj.other) {same})"""
        )
        keep = "QUALIFY cost - min(cost) OVER (PARTITION BY root) <= -1000.0 * ln(1 - 1e-5)" if pruned else ""
        ctes.append(f"l{d} AS (SELECT * FROM g{d} {keep})")
    return ", ".join(ctes)


def _ends(horizon: int = 3) -> str:
    parts = [f"SELECT root, path, cost FROM l{d} WHERE node NOT IN (SELECT node FROM adj)" for d in range(horizon)]
    return "done AS (" + " UNION ALL ".join([*parts, f"SELECT root, path, cost FROM l{horizon}"]) + ")"


_COUNTS = "cnt AS (" + " UNION ALL ".join(
    f"SELECT root, {d} AS depth, count(*) AS n_generated, (SELECT count(*) FROM l{d} WHERE l{d}.root = g{d}.root) AS n_kept FROM g{d} GROUP BY root" for d in range(1, 9)
) + ")"

# One row of the cost matrix per step of the recursion; a row is folded from left to right, and each of its cells keeps the
# length of its path, which its choice of predecessor fixes.
_DTW = f"""WITH RECURSIVE {MATS},
cost AS (SELECT result_id, len(a)::INT AS n, len(b)::INT AS m,
    list_transform(a, lambda p: list_transform(b, lambda q: greatest(1 - greatest(least(list_cosine_similarity(p, q), 1), -1), 0))) AS c FROM pr),
dp(result_id, i, row) AS (
  SELECT result_id, 0, list_transform(range(1, m + 1), lambda j: {{'t': 'inf'::DOUBLE, 'l': 0, 'c': 0.0::DOUBLE, 'u': 0.0::DOUBLE, 'ul': 0, 'd': 0.0::DOUBLE, 'dl': 0, 'j': 0, 'i': 0, 'in': true}}) FROM cost
  UNION ALL
  SELECT result_id, i + 1, list_reduce(list_transform(range(1, m + 1), lambda j: [{{
      't': CASE WHEN abs(i + 1 - j) > 10 THEN 'inf'::DOUBLE WHEN j = 1 THEN c[i + 1][1] + CASE WHEN i = 0 THEN 0 ELSE row[1].t END ELSE 0 END,
      'l': CASE WHEN j = 1 THEN i + 1 ELSE 0 END, 'c': c[i + 1][j], 'u': row[j].t, 'ul': row[j].l,
      'd': CASE WHEN j = 1 THEN 'inf'::DOUBLE ELSE row[j - 1].t END, 'dl': CASE WHEN j = 1 THEN 0 ELSE row[j - 1].l END,
      'j': j::INT, 'i': i + 1, 'in': abs(i + 1 - j) <= 10}}]),
    lambda acc, x: list_append(acc, {{
      't': CASE WHEN x[1]['in'] THEN x[1].c + least(x[1].u, x[1].d, acc[-1].t) ELSE 'inf'::DOUBLE END,
      'l': 1 + CASE WHEN x[1].i = 1 THEN acc[-1].l WHEN x[1].d <= acc[-1].t AND x[1].d <= x[1].u THEN x[1].dl WHEN acc[-1].t <= x[1].u THEN acc[-1].l ELSE x[1].ul END,
      'c': x[1].c, 'u': x[1].u, 'ul': x[1].ul, 'd': x[1].d, 'dl': x[1].dl, 'j': x[1].j, 'i': x[1].i, 'in': x[1]['in']}}))
  FROM dp JOIN cost USING (result_id) WHERE i < n)
SELECT result_id, CASE WHEN isfinite(row[-1].t) THEN round(row[-1].t / row[-1].l, 7) END AS score,
       CASE WHEN isfinite(row[-1].t) THEN round(abs(n - m) / row[-1].l::DOUBLE + 0.5 * row[-1].t / row[-1].l, 7) END AS divergence,
       CASE WHEN isfinite(row[-1].t) THEN row[-1].l END AS path_len
FROM dp JOIN cost USING (result_id) WHERE i = n"""

_GUIDES = """
g AS (SELECT result_id, any_value(tokens) AS tk FROM colbert_results WHERE tokens IS NOT NULL GROUP BY result_id),
gp AS (SELECT pr.result_id, x.tk AS ta, y.tk AS tb FROM pr JOIN g x ON x.result_id = pr.result_id JOIN g y ON y.result_id = pr.result_id + 1),
tn AS (SELECT DISTINCT result_id, side, ('0x' || substr(md5(w), 1, 8))::BIGINT AS id FROM (
         SELECT result_id, 0 AS side, unnest(ta) AS w FROM gp UNION ALL SELECT result_id, 1, unnest(tb) FROM gp)),
h AS (SELECT *, id::UHUGEINT * 11400714819323198485::UHUGEINT AS h1 FROM tn),
hh AS (SELECT *, (h1 % 1180591620717411303424::UHUGEINT) * 3266489955::UHUGEINT
              + (((h1 % 274877906944::UHUGEINT) * 2246822519::UHUGEINT) % 274877906944::UHUGEINT) * 4294967296::UHUGEINT AS h2 FROM h),
sg AS (SELECT result_id, side,
  bit_or((1::UBIGINT << ((h1 // 18446744073709551616::UHUGEINT) % 64)::INT) | (1::UBIGINT << ((h2 // 18446744073709551616::UHUGEINT) % 64)::INT)) AS s0,
  bit_or((1::UBIGINT << ((h1 // 4294967296::UHUGEINT) % 64)::INT) | (1::UBIGINT << ((h2 // 4294967296::UHUGEINT) % 64)::INT)) AS s1 FROM hh GROUP BY ALL),
ov AS (SELECT gp.*, (bit_count(x.s0 & y.s0) + bit_count(x.s1 & y.s1))::INT AS overlap,
         ((bit_count(x.s0 & y.s0) + bit_count(x.s1 & y.s1)) / (bit_count(x.s0 | y.s0) + bit_count(x.s1 | y.s1))::DOUBLE)::FLOAT AS jaccard
       FROM gp JOIN sg x ON x.result_id = gp.result_id AND x.side = 0 JOIN sg y ON y.result_id = gp.result_id AND y.side = 1)"""


def _guided_sql(where: str) -> str:
    """The recursion with a band per row: one step where the tokens at a place agree, else ten and dearer."""
    head, tail = _DTW.split("cost AS (", 1)
    body, last = tail.rsplit("SELECT result_id, CASE WHEN isfinite", 1)
    body = body.replace("FROM pr),", "FROM pr JOIN ov USING (result_id) WHERE len(ta) = len(a) AND len(tb) = len(b)),", 1)
    body = body.replace("len(b)::INT AS m,", "len(b)::INT AS m, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i <= len(b) AND ta[i] = tb[i] THEN 1 ELSE 10 END) AS wd,", 1)
    body = body.replace("list_transform(a, lambda p: list_transform(b, lambda q: greatest", "list_transform(a, lambda p, i: list_transform(b, lambda q: (CASE WHEN i <= len(b) AND ta[i] = tb[i] THEN 1.0 ELSE 1.0 + 0.3::FLOAT::DOUBLE END) * greatest", 1)
    body = body.replace("abs(i + 1 - j) > 10", "abs(i + 1 - j) > wd[i + 1]").replace("abs(i + 1 - j) <= 10", "abs(i + 1 - j) <= wd[i + 1]")
    done = """fin AS (SELECT ov.result_id, overlap, jaccard, CASE WHEN cost.n IS NULL THEN 'guides' END AS error, CASE WHEN isfinite(row[-1].t) THEN row[-1].t / row[-1].l END AS score,
        CASE WHEN isfinite(row[-1].t) THEN row[-1].l END AS path_len FROM ov LEFT JOIN cost ON cost.result_id = ov.result_id LEFT JOIN dp ON dp.result_id = ov.result_id AND i = n)"""
    return f"{head}{_GUIDES.strip()}, cost AS ({body.rstrip()}, {done} {where}"


SQL = {
    "z1_dictionary": f"WITH {CEN} SELECT cell, len(v)::INT AS dim, round(sqrt(list_dot_product(v, v)), 7) AS norm FROM cen",
    "z2_ruzicka": f"""WITH {FACT}, bag AS (SELECT n, cell, sum(w) AS w FROM (SELECT n, unnest(celle) AS cell, unnest(conf)::DOUBLE AS w FROM fact
          WHERE celle IS NOT NULL AND conf IS NOT NULL) WHERE cell IS NOT NULL AND isfinite(w) GROUP BY ALL),
        p AS (SELECT x.n AS a, y.n AS b FROM fact x JOIN fact y ON y.n = x.n + 1),
        x AS (SELECT a, b, cell, w AS l, 0 AS r FROM p JOIN bag ON n = a UNION ALL SELECT a, b, cell, 0, w FROM p JOIN bag ON n = b),
        y AS (SELECT a, b, cell, sum(l) AS l, sum(r) AS r FROM x GROUP BY ALL), s AS (SELECT a, b, sum(least(l, r)) AS lo, sum(greatest(l, r)) AS hi FROM y GROUP BY ALL)
        SELECT p.a, p.b, round(coalesce(lo / nullif(hi, 0), 0), 6) + 0.0 AS similarity FROM p LEFT JOIN s USING (a, b)""",
    "b3_centroid_points": f"""WITH {_STEPS} SELECT ok.fact_id, step::INT AS step, round(v[1], 7) + 0.0 AS first, round(sqrt(list_dot_product(v, v)), 7) AS length
        FROM ok LEFT JOIN (SELECT * FROM st JOIN cen USING (cell)) x ON x.fact_id = ok.fact_id""",
    "b4_weighted_points": f"""WITH {_STEPS}, dim AS (SELECT fact_id, step, w, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM st JOIN cen USING (cell)),
        win AS (SELECT fact_id, step, d, sum(w * x) OVER k AS s, sum(w) OVER k AS t FROM dim WINDOW k AS (PARTITION BY fact_id, d ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
        bad AS (SELECT DISTINCT fact_id FROM win WHERE t IS NULL OR isnan(t) OR NOT t > 0 UNION SELECT fact_id FROM st WHERE w IS NULL),
        pt AS (SELECT fact_id, step, sum(s / t * s / t) AS l, sum(s / t) FILTER (WHERE d = 1) AS f FROM win WHERE fact_id NOT IN (SELECT fact_id FROM bad) GROUP BY ALL)
        SELECT ok.fact_id, step::INT AS step, round(f, 7) + 0.0 AS first, round(sqrt(l), 7) AS length FROM ok LEFT JOIN pt USING (fact_id)""",
    "b5_checks": f"""WITH {FACT} SELECT fact_id, CASE WHEN celle IS NULL OR pos IS NULL OR conf IS NULL OR len(celle) = 0 OR len(celle) <> len(pos) OR len(celle) <> len(conf) THEN 'walk'
          WHEN list_bool_or(list_transform(celle, lambda c: c IS NULL OR c < 0 OR c >= 256)) THEN 'cell' END AS error FROM fact""",
    "y4_assign": f"WITH {ASSIGN} SELECT result_id, pos, cell, round(conf, 7) + 0.0 AS conf FROM asg",
    "y6_trajectories": f"WITH {ASSIGN} SELECT result_id, string_agg(cell::VARCHAR, ' ' ORDER BY pos) AS cells, count(*)::INT AS n_steps FROM asg GROUP BY result_id",
    "y7_report": f"""WITH {ASSIGN}, p AS (SELECT count(DISTINCT cell) AS c FROM asg GROUP BY result_id)
        SELECT (SELECT round(avg(c), 6) FROM p) AS mean_cells, (SELECT quantile_cont(c, 0.5)::DOUBLE FROM p) AS median_cells, count(DISTINCT cell) AS used_cells,
               round(avg(conf), 7) AS mean_conf, round(quantile_cont(conf, 0.1), 7) AS p10_conf FROM asg""",
    "d2_align": _DTW,
    "d7_default_guard": _guided_sql("SELECT result_id, error, round(score, 7) AS score FROM fin WHERE jaccard >= 0.65::FLOAT"),
    "d8_guided": _guided_sql("SELECT result_id, overlap, error, round(score, 7) AS score, path_len FROM fin WHERE overlap >= 2"),
    "e5_levels": _guided_sql("""SELECT level, count(*) AS n_kept, round(avg(score), 6) AS mean_score FROM fin JOIN (VALUES ('L2', 0, NULL), ('L3', 2, NULL), ('L4', 4, NULL), ('L5', 5, NULL),
        ('L6', NULL, 0.0), ('L7', NULL, 0.5), ('L8', NULL, 0.65), ('L9', NULL, 0.8)) t(level, bits, jac) ON overlap >= bits OR jaccard >= jac::FLOAT GROUP BY level
        UNION ALL SELECT 'L1', count(*), round(avg((list_sum(""" + _BEST.format("a", "b", "list_dot_product") + ") + list_sum(" + _BEST.format("b", "a", "list_dot_product")
        + ")) / 2), 6) FROM pr JOIN ov USING (result_id)"),
    "e19_actions": f"""WITH {EDGES_FULL}, n AS (SELECT src AS node FROM edges WHERE src IS NOT NULL UNION SELECT dst FROM edges WHERE dst IS NOT NULL),
        en AS (SELECT unnest([src, dst]) AS node, score, coalesce(nullif(colbert, '-inf'::DOUBLE), 0) AS c, (coalesce(nullif(sparse, '-inf'::DOUBLE), 0) + coalesce(nullif(relational, '-inf'::DOUBLE), 0)) / 2 AS r FROM ef),
        s0 AS (SELECT node, avg(score) AS v, avg(c) AS a, avg(r) AS k FROM en GROUP BY node), ad AS (SELECT src AS x, dst AS y FROM ef UNION ALL SELECT dst, src FROM ef),
        ac AS (SELECT {_ACT.format(t="t.", s="s.")} AS action FROM ad JOIN s0 s ON s.node = x JOIN s0 t ON t.node = y), ok AS (SELECT action FROM ac WHERE action IS NOT NULL)
        SELECT count(*) AS n, round(min(action), 6) AS least, round(quantile_cont(action, 0.5), 6) AS p50, round(quantile_cont(action, 0.9), 6) AS p90,
               round(quantile_cont(action, 0.99), 6) AS p99, round(max(action), 6) AS most, count(*) FILTER (WHERE action < 0.0020001) AS n_small FROM ok""",
    "k3_states": f"WITH {KIN} SELECT result_id, pos, round(v, 6) AS v, round(a, 6) + 0.0 AS a, round(k, 6) + 0.0 AS k FROM ks",
    "f12_last_states": f"WITH {KIN} SELECT result_id, round(v, 6) AS v, round(a, 6) + 0.0 AS a, round(k, 6) + 0.0 AS k FROM ks QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY pos DESC) = 1",
    "f14_frame_graph": f"WITH {KIN} SELECT src, dst, round(score, 6) + 0.0 AS score FROM fg",
    "f14_directed": f"""WITH {KIN}, later AS (SELECT a.result_id * 64 + a.pos AS src, a.result_id * 64 + b.pos AS dst, b.pos - a.pos AS gap, list_cosine_similarity(a.x, b.x) AS score
          FROM fr a JOIN fr b ON a.result_id = b.result_id AND a.pos < b.pos)
        SELECT src, dst, round(score, 6) + 0.0 AS score FROM later WHERE gap <= 2 UNION ALL SELECT src, dst, round(score, 6) + 0.0 FROM later WHERE score >= 0.7""",
    "f15_min_step": f"""WITH {KIN}, n AS (SELECT result_id * 64 + pos AS node, v, a, k FROM ks), e AS (SELECT src, dst FROM fg UNION ALL SELECT dst, src FROM fg),
        x AS (SELECT {_ACT.format(t="t.", s="s.")} AS action FROM e JOIN n s ON s.node = src JOIN n t ON t.node = dst)
        SELECT round(min(action) FILTER (WHERE action > 1e-9 AND isfinite(action)), 8) AS min_step FROM x""",
    "f11_node_states": f"WITH {PROX} SELECT node, round(v, 7) + 0.0 AS v, round(a, 7) + 0.0 AS a, round(k, 7) + 0.0 AS k FROM sta",
    "f7_beam": f"WITH {PROX}, {_levels(True, 8)}, {_ends(8)} SELECT root, array_to_string(path, '>') AS path, round(cost, 7) AS cost FROM done",
    "f6_levels": f"WITH {PROX}, {_levels(True, 8)}, {_COUNTS} SELECT * FROM cnt",
    "f17_exhaustive": f"WITH {PROX}, {_levels(False)}, {_ends()} SELECT root, round(min(cost), 7) AS cost FROM done GROUP BY root",
    "f18_deviation": f"""WITH {PROX}, e AS (WITH {_levels(False)}, {_ends()} SELECT root, min(cost) AS c FROM done GROUP BY root),
        b AS (WITH {_levels(True)}, {_ends()} SELECT root, min(cost) AS c FROM done GROUP BY root)
        SELECT count(*) AS n_roots, round(avg(greatest(b.c - e.c, 0)), 7) AS mean_gap, round(max(greatest(b.c - e.c, 0)), 7) AS max_gap, bool_and(b.c >= e.c - 1e-9) AS sound
        FROM b JOIN e USING (root)""",
    "f16_throughput": f"""WITH {PROX}, {_levels(True, 8)}, {_COUNTS}, h AS (SELECT unnest([1, 2, 3, 4, 5, 8]) AS horizon)
        SELECT horizon::INT AS horizon, CAST(sum(n_generated) AS BIGINT) AS n_generated, CAST(sum(n_kept) AS BIGINT) AS n_kept FROM h JOIN cnt ON depth <= horizon GROUP BY horizon""",
}
