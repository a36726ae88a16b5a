"""Queries of the scalar layer over the edge table: fusion, order, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from hodograph.functions import numeric as N
from hodograph.functions import scalar as S
from hodograph.runtime import read

SAT = "CASE WHEN isnan({0}) THEN {0} WHEN {0} < 0 THEN 0.0 WHEN {0} > 1 THEN 1.0 ELSE {0} END"
SHOW = "CASE WHEN NOT isnan({0}) THEN round({0}, 9) + 0.0 END"
AXES = f"""
axes AS (SELECT *, {SAT.format('((colbert + 1) / 2)')} AS d, {SAT.format('(1 - exp(-10.64 * sparse))')} AS s,
                {SAT.format('((relational + 1) / 2)')} AS c FROM edges)"""
KNOWN = "coalesce(NOT isnan({0}), false)"


def _axes(spark, sf):
    e = read(spark, sf, "edges")
    d, s, c = S.normalize(F.col("colbert"), F.col("sparse"), F.col("relational"))
    return e.select("*", d.alias("d"), s.alias("s"), c.alias("c"))


def c1_normalize(spark, sf):
    return _axes(spark, sf).select("src", "dst", "graph_id", *(N.shown(F.col(x)).alias(x) for x in "dsc"))


def c1_bad_lambda(spark, sf):
    e = read(spark, sf, "edges")
    d, s, c = S.normalize(F.col("colbert"), F.col("sparse"), F.col("relational"), -1.0)
    return e.select(d.alias("d"), s.alias("s"), c.alias("c")).agg(
        F.count_if(N.known(F.col("d"))).alias("n_dense"), F.count_if(N.known(F.col("s"))).alias("n_sparse"), F.count_if(N.known(F.col("c"))).alias("n_colbert")
    )


def c2_saturate(spark, sf):
    x = (F.col("l_quantity") - 10) / 20
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.sat01(x), 6).alias("x"))


def c3_combine(spark, sf):
    return _axes(spark, sf).select("src", "dst", N.shown(S.combine([F.col(x) for x in "dsc"])).alias("combined"))


def c3_by_graph(spark, sf):
    """Fusion with each graph's own weights, which may be invalid."""
    cfg = read(spark, sf, "graph_config").select("graph_id", "pesi")
    w = [F.col("pesi")[i] for i in range(3)]
    a = _axes(spark, sf).join(cfg, "graph_id")
    return a.select("graph_id", "src", "dst", N.shown(S.combine([F.col(x) for x in "dsc"], w)).alias("combined"))


def c4_pareto(spark, sf):
    """Each edge's axes against its graph's weights read as a point."""
    cfg = read(spark, sf, "graph_config").select("graph_id", "pesi")
    a = _axes(spark, sf).join(cfg, "graph_id")
    o = S.pareto([F.col(x) for x in "dsc"], [F.col("pesi")[i] for i in range(3)])
    return a.groupBy("graph_id", o.alias("winner")).agg(F.count(F.lit(1)).alias("n"))


def g4_distance(spark, sf):
    return _axes(spark, sf).select("src", "dst", N.shown(S.distance_to_ideal([F.col(x) for x in "dsc"])).alias("distance"))


def _gate(spark, sf):
    p = S.probe(F.col("colbert"), F.col("sparse"), 0.3, 0.7)
    e = read(spark, sf, "edges").withColumn("probe", p)
    deadline = F.col("computed_at") + F.expr("INTERVAL 5 MINUTES")
    return e.withColumn("verdict", S.verdict(F.col("probe"), F.col("loaded_at"), deadline, 0.9))


def t1_probe(spark, sf):
    return _gate(spark, sf).select("src", "dst", N.shown(F.col("probe")).alias("probe"), N.known(F.col("probe")).alias("valid"))


def t3_gate(spark, sf):
    return _gate(spark, sf).select("src", "dst", "graph_id", "verdict")


def t3_gated_match(spark, sf):
    """The gate ahead of the costly step: blocked rows never reach the combination."""
    kept = _gate(spark, sf).filter("verdict <> 'block'")
    d, s, c = S.normalize(F.col("colbert"), F.col("sparse"), F.col("relational"))
    return kept.select("graph_id", "verdict", S.combine([d, s, c]).alias("x")).groupBy("graph_id", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(N.known(F.col("x")), F.col("x"))), 6).alias("mean_combined")
    )


def t4_budget(spark, sf):
    """Rows whose time was up, and the seconds left to the others."""
    left = F.unix_micros(F.col("computed_at") + F.expr("INTERVAL 5 MINUTES")) - F.unix_micros("loaded_at")
    e = read(spark, sf, "edges").filter("computed_at IS NOT NULL AND loaded_at IS NOT NULL").withColumn("left", left)
    return e.groupBy("graph_id").agg(
        F.count_if(F.col("left") <= 0).alias("n_expired"), F.sum(F.greatest("left", F.lit(0).cast("long"))).alias("micros_left")
    )


def k1_action(spark, sf):
    """Inertial action of each line item's change against the next line of its order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cols = ["l_quantity", "l_discount", "l_tax"]
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols, *(F.lead(c).over(w).alias("n" + c) for c in cols))
    a = S.inertial_action([F.col(c) for c in cols], [F.col("n" + c) for c in cols], 2.0, 4.0, 30.0, 1.0)
    return li.filter("nl_quantity IS NOT NULL").select("l_orderkey", "l_linenumber", F.when(a == float("inf"), None).otherwise(F.round(a, 5)).alias("action"))


def q7_bounds(spark, sf):
    """Amplitude bounds of each supplier's branches, and whether it cannot beat the incumbent."""
    return _branches(spark, sf)


def _branches(spark, sf):
    from hodograph.operators.collapse import bounds, branches_of

    return bounds(branches_of(read(spark, sf, "lineitem")), 1.0, 2.0).select(
        "candidate_id", "n_branches", F.round("lower", 6).alias("lower"), F.round("upper", 4).alias("upper")
    )


QUERIES = {
    f.__name__: f
    for f in (c1_normalize, c1_bad_lambda, c2_saturate, c3_combine, c3_by_graph, c4_pareto, g4_distance, t1_probe, t3_gate, t3_gated_match, t4_budget, k1_action, q7_bounds)
}

_COMB = "(d * 0.215 + s * 0.552 + c * 0.233)"
_GATE = f"""
gate AS (SELECT *, CASE WHEN {KNOWN.format('d')} AND {KNOWN.format('s')} THEN d * 0.3 + s * 0.7 ELSE 'nan'::DOUBLE END AS probe FROM axes),
ver AS (SELECT *, CASE WHEN coalesce(loaded_at >= computed_at + INTERVAL 5 MINUTE, false) THEN 'timeout'
                       WHEN isnan(probe) OR probe >= 0.9 THEN 'pass' ELSE 'block' END AS verdict FROM gate)"""
_GE = " AND ".join(f"({KNOWN.format(a)} AND {a} >= w{i})" for i, a in enumerate("dsc", 1))
_GT = " OR ".join(f"({KNOWN.format(a)} AND {a} > w{i})" for i, a in enumerate("dsc", 1))
_LE = " AND ".join(f"({KNOWN.format(a)} AND {a} <= w{i})" for i, a in enumerate("dsc", 1))
_LT = " OR ".join(f"({KNOWN.format(a)} AND {a} < w{i})" for i, a in enumerate("dsc", 1))

SQL = {
    "c1_normalize": f"WITH {AXES} SELECT src, dst, graph_id, " + ", ".join(f"{SHOW.format(x)} AS {x}" for x in "dsc") + " FROM axes",
    "c1_bad_lambda": f"""WITH {AXES} SELECT count(*) FILTER (WHERE {KNOWN.format('d')}) AS n_dense, CAST(0 AS BIGINT) AS n_sparse,
                         count(*) FILTER (WHERE {KNOWN.format('c')}) AS n_colbert FROM axes""",
    "c2_saturate": "SELECT l_orderkey, l_linenumber, round(least(greatest((l_quantity - 10) / 20, 0), 1), 6) AS x FROM lineitem",
    "c3_combine": f"WITH {AXES} SELECT src, dst, {SHOW.format(_COMB)} AS combined FROM axes",
    "c3_by_graph": f"""WITH {AXES}, j AS (SELECT axes.*, pesi, CASE WHEN abs(list_sum(pesi) - 1) < 1e-9 AND list_min(pesi) >= 0
                         THEN d * pesi[1] + s * pesi[2] + c * pesi[3] END AS x FROM axes JOIN graph_config USING (graph_id))
                       SELECT graph_id, src, dst, {SHOW.format('x')} AS combined FROM j""",
    "c4_pareto": f"""WITH {AXES}, j AS (SELECT axes.*, pesi[1] AS w1, pesi[2] AS w2, pesi[3] AS w3 FROM axes JOIN graph_config USING (graph_id))
                     SELECT graph_id, CASE WHEN {_GE} AND ({_GT}) THEN 'A' WHEN {_LE} AND ({_LT}) THEN 'B' ELSE '-' END AS winner, count(*) AS n
                     FROM j GROUP BY ALL""",
    "g4_distance": f"WITH {AXES}, j AS (SELECT *, 0.215*(1-d)*(1-d) + 0.552*(1-s)*(1-s) + 0.233*(1-c)*(1-c) AS x FROM axes) SELECT src, dst, {SHOW.format('x')} AS distance FROM j",
    "t1_probe": f"WITH {AXES}, {_GATE} SELECT src, dst, {SHOW.format('probe')} AS probe, NOT isnan(probe) AS valid FROM ver",
    "t3_gate": f"WITH {AXES}, {_GATE} SELECT src, dst, graph_id, verdict FROM ver",
    "t3_gated_match": f"""WITH {AXES}, {_GATE}, x AS (SELECT *, {_COMB} AS x FROM ver WHERE verdict <> 'block')
                          SELECT graph_id, verdict, count(*) AS n, round(avg(x) FILTER (WHERE NOT isnan(x)), 6) AS mean_combined FROM x GROUP BY ALL""",
    "t4_budget": """WITH x AS (SELECT graph_id, epoch_us(computed_at) + 300000000 - epoch_us(loaded_at) AS l FROM edges
                               WHERE computed_at IS NOT NULL AND loaded_at IS NOT NULL)
                    SELECT graph_id, count(*) FILTER (WHERE l <= 0) AS n_expired, CAST(sum(greatest(l, 0)) AS BIGINT) AS micros_left FROM x GROUP BY graph_id""",
    "k1_action": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, l_discount AS a, l_tax AS k,
                      lead(l_quantity) OVER w AS v2, lead(l_discount) OVER w AS a2, lead(l_tax) OVER w AS k2 FROM lineitem
                      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
                    SELECT l_orderkey, l_linenumber, CASE WHEN abs(v2 - v) < 30 THEN round(900 * ((v2-v)/30)*((v2-v)/30) / (1 + sqrt(1 - ((v2-v)/30)*((v2-v)/30)))
                      + 2 * (a2-a)*(a2-a) + 4 * abs(k2-k), 5) END AS action FROM x WHERE v2 IS NOT NULL""",
    "q7_bounds": """WITH b AS (SELECT l_suppkey AS candidate_id, l_discount * 10 * 0.215 + l_tax * 10 * 0.552 + (1 - l_quantity / 50) * 0.233 AS action FROM lineitem),
                    g AS (SELECT candidate_id, count(*) AS n, min(action) AS m FROM b WHERE action <= 1.0 AND candidate_id IS NOT NULL GROUP BY 1)
                    SELECT candidate_id, n AS n_branches, round(exp(-m / 2), 6) AS lower, round(n * exp(-m / 2), 4) AS upper FROM g""",
}
