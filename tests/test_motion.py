import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodograph.operators import align as A
from hodograph.operators import beam as B
from hodograph.operators import cells as Z
from hodograph.operators import evaluate as E
from hodograph.operators import kinematics as K
from hodograph.plans.config import AlignConfig, SolverConfig

from .conftest import rows


def all_paths(n, m):
    """Every monotone path from (0, 0) to (n-1, m-1)."""
    def go(i, j):
        if (i, j) == (n - 1, m - 1):
            yield [(i, j)]
            return
        for di, dj in ((1, 1), (0, 1), (1, 0)):
            if i + di < n and j + dj < m:
                for rest in go(i + di, j + dj):
                    yield [(i, j), *rest]
    return list(go(0, 0))


@pytest.mark.parametrize("n,m,seed", [(3, 4, 0), (4, 4, 1), (5, 2, 2)])
def test_alignment_is_optimal(n, m, seed):
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(n, 5)), r.normal(size=(m, 5))
    c = A.cosine_costs(x, y)
    best = min(sum(c[i, j] for i, j in p) for p in all_paths(n, m))
    g = A.align(x, y, AlignConfig(window=10))
    assert g.total == pytest.approx(best) and g.path in all_paths(n, m)


def test_alignment_edges():
    z, e = np.zeros((1, 2)), np.eye(2)
    assert A.cosine_costs(z, e[:1])[0, 0] == 1 and A.cosine_costs(e[:1], -e[:1])[0, 0] == 2
    assert A.align(np.ones((10, 2)), np.ones((2, 2)), AlignConfig(window=1)).total == math.inf
    assert A.align(None, e, AlignConfig()).error == "empty" and A.align(np.eye(3), e, AlignConfig()).error == "dimension"
    assert A.align(np.array([[np.nan, 1]]), e, AlignConfig()).error == "nan"
    same = A.align(np.ones((3, 2)), np.ones((3, 2)), AlignConfig())
    assert same.path == [(0, 0), (1, 1), (2, 2)] and same.divergence(3, 3, 0.5) == pytest.approx(0, abs=1e-12)
    a, b = np.random.default_rng(1).normal(size=(2, 6, 3))
    assert A.align(a, b, AlignConfig(window=10)).total == pytest.approx(A.align(b, a, AlignConfig(window=10)).total)


def test_band_follows_agreement():
    w, f = A.band_widths(np.array([1.0, 0.0, 0.5, 0.31], np.float32), 6, AlignConfig(window=20, w_min=1, w_max=9))
    assert w.tolist() == [1, 9, 5, 1, 9, 9] and f[0] == 1 and f[1] == pytest.approx(1.3)
    assert A.band_widths(np.array([0.0], np.float32), 1, AlignConfig(window=0, w_min=9, w_max=1))[0].tolist() == [1]


def test_align_pairs(spark):
    m = "array<array<double>>"
    data = [(1, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]], [1.0, 1.0]), (2, None, [[1.0]], [0.0]), (3, [[1.0, 0.0]] * 10, [[1.0, 0.0]] * 2, [1.0, 1.0]), (4, [[1.0]], [[1.0]], None)]
    df = spark.createDataFrame(data, f"k int, a {m}, b {m}, p array<double>")
    plain = {r.k: r for r in A.align_pairs(df, ["k"], "a", "b", AlignConfig(window=1)).collect()}
    assert plain[1].score == pytest.approx(0, abs=1e-12) and plain[2].error == "empty" and plain[3].score == math.inf
    steered = {r.k: r for r in A.align_pairs(df, ["k"], "a", "b", AlignConfig(window=1), "p").collect()}
    assert steered[3].error is None and steered[3].score is None and steered[4].error == "guides"


def test_gated_alignment_reports_dimensions_first(spark):
    x, y = [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(1, x, x, "pass"), (2, x, x, "block"), (3, x, y, "block"), (4, x, y, "pass")], "id long, a array<array<double>>, b array<array<double>>, verdict string")
    got = rows(A.align_gated(df, ["id"], "a", "b", "verdict", AlignConfig(window=5)))
    assert got == [(1, "pass", None, 0.0), (2, "block", None, None), (3, "block", "dimension", None), (4, "pass", "dimension", None)]


def test_kinematic_states(spark):
    df = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 0.0], [0.0, 2.0]])], "k int, m array<array<double>>")
    got = rows(K.frame_states(df, "k", "m"))
    assert [g[2:] for g in got] == [(1.0, 0.0, 0.0), (0.0, -1.0, pytest.approx(math.pi / 2)), (2.0, 2.0, pytest.approx(math.pi / 2))]
    e = spark.createDataFrame([(1, 2, 0.8, 0.7, 0.6, 0.5), (1, 3, 0.4, 0.3, 0.2, 0.1)], "src long, dst long, score double, colbert double, sparse double, relational double")
    n = spark.createDataFrame([(1,), (9,)], "node long")
    got = {r.node: (r.v, r.a, r.k) for r in K.node_states(n, e).collect()}
    assert got[1] == pytest.approx((0.6, 0.5, 0.35)) and got[9] == (0, 0, 0)


def search(spark, links, states, cfg, root=0, **kw):
    adj = spark.createDataFrame(links, "node long, other long")
    s = spark.createDataFrame([(n, float(v), 0.0, 0.0) for n, v in states.items()], "node long, v double, a double, k double")
    roots = s.filter(F.col("node") == root).withColumnRenamed("node", "root")
    paths, levels = B.beam_search(adj, s, roots, cfg, **kw)
    return sorted(tuple(r.path) for r in paths.collect()), levels, (adj, s, roots)


def test_beam(spark):
    cfg = SolverConfig(horizon=3)
    assert search(spark, [(0, 1)], {0: 0, 1: 1}, cfg)[0] == [(1,)]
    assert search(spark, [(0, 1), (0, 2)], {0: 0, 1: 1, 2: 1}, cfg)[0] == [(1,), (2,)]
    assert search(spark, [(0, 1), (0, 2)], {0: 0, 1: 1, 2: 90}, cfg)[0] == [(1,)]
    cycle = [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert search(spark, cycle, {0: 0, 1: 1, 2: 2}, cfg)[0] == []
    assert search(spark, cycle, {0: 0, 1: 1, 2: 2}, cfg, emit_dead_ends=True)[0] == [(1, 2)]
    assert search(spark, [(5, 6)], {0: 0, 5: 1, 6: 2}, cfg)[0] == [()]
    assert search(spark, [(0, 1)], {0: 1, 1: 1}, cfg)[0] == []
    assert search(spark, [(0, 1)], {0: 0, 1: 1}, SolverConfig(horizon=0))[0] == [()]


def test_beam_never_beats_exhaustive(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 12, (40, 2)) if a != b]
    links = sorted({*links, *((b, a) for a, b in links)})
    cfg = SolverConfig(horizon=3, kappa=1e5)
    _, _, (adj, s, roots) = search(spark, links, {i: i * 0.1 for i in range(12)}, cfg)
    paths, _ = B.beam_search(adj, s, roots, cfg)
    cheap = B.exhaustive(adj, s, roots, cfg).first()
    assert paths.agg(F.min("cost")).first()[0] >= cheap.cost - 1e-9


def test_projection_errors(spark):
    table = spark.createDataFrame([(2, 1, [[1.0], [0.5]])], "k int, dim int, centroidi array<array<float>>")
    data = [("ok", [0, 1], [0, 1], [1.0, 1.0], 1), ("walk", [0], [0, 1], [1.0], 1), ("none", None, [0], [1.0], 1), ("empty", [], [], [], 1), ("dim", [0], [0], [1.0], 3), ("cell", [2], [0], [1.0], 1)]
    walks = spark.createDataFrame(data, "id string, celle array<int>, pos array<int>, conf array<float>, wdim int")
    got = {r.id: r.error for r in Z.projection_errors(walks, "id", table, "wdim").collect()}
    assert got == {"ok": None, "walk": "walk", "none": "walk", "empty": "walk", "dim": "dimension", "cell": "cell"}
    assert {r.error for r in Z.projection_errors(walks, "id", table.withColumn("dim", F.lit(4))).collect()} == {"dictionary"}
    assert {r.error for r in Z.projection_errors(walks, "id", table.limit(0)).collect()} == {"dictionary"}


def test_projection(spark):
    c = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    data = [("a", [0, 1, 2], [0, 1, 2], [0.9, 0.8, 0.7]), ("out", [0, 7], [0, 1], [1.0, 1.0]), ("zero", [0, 1], [0, 1], [0.0, 0.0]), ("null", None, [0], [1.0]), ("odd", [0], [0, 1], [1.0])]
    w = spark.createDataFrame(data, "k string, celle array<int>, pos array<int>, conf array<float>")
    got = {r.k: r.points for r in Z.project(w, "k", c, Z.WEIGHTED).collect()}
    assert got["a"][0] == pytest.approx([0.9 / 1.7, 0.8 / 1.7], abs=1e-6) and all(got[k] is None for k in ("out", "zero", "null", "odd"))
    assert {r.k: r.points is None for r in Z.project(w, "k", c).collect()}["zero"] is False


def test_bag_similarity(spark):
    t = spark.createDataFrame([(1, [0, 1, 1], [0.5, 0.5, 0.5]), (2, [0, 1, 1], [0.5, 0.5, 0.5]), (3, [9], [1.0]), (4, None, None)], "n long, celle array<int>, conf array<float>")
    p = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert rows(Z.bag_similarity(Z.cell_bags(t, "n"), p, "n")) == [(1, 2, 1.0), (1, 3, 0.0), (1, 4, 0.0)]


def test_zones_and_assignment(spark):
    m = spark.createDataFrame([(i, [[1.0, 0.01 * i], [0.01 * i, 1.0]]) for i in range(1, 20)], "k int, m array<array<double>>")
    c = Z.train_zones(m, "m", 2)
    a = Z.assign_cells(m, "k", "m", c).collect()
    assert len({x.cell for x in a if x.pos == 0}) == 1 and all(x.conf > 0.9 for x in a)
    t = Z.cell_trajectories(Z.assign_cells(m, "k", "m", c), "k").first()
    assert t.pos == [0, 1]


def test_evaluation(spark):
    s = spark.createDataFrame([("L", "a", 0.5), ("L", "a", 0.9), ("L", "b", 0.5), ("L", "b", 0.1), ("L", "b", float("nan"))], "level string, category string, score double")
    auc = {r.category: r.auc for r in E.auc_one_vs_rest(s, "level", "category", "score").collect()}
    assert auc == {"a": 1.0, "b": 0.25}
    assert E.auc_one_vs_rest(s.filter("category = 'a'"), "level", "category", "score").first().auc == 0.5
    assert rows(E.auc_pairwise(s, "level", "category", "score")) == [("L", "a", "b", 1.0)]
    t = {round(r.theta, 2): (r.fnr, r.tnr) for r in E.threshold_sweep(s.withColumn("p", F.col("category") == "a"), "p", "score").collect()}
    assert t[0.5] == (0.0, 0.5) and t[0.51] == (0.5, 1.0) and t[0.0] == (0.0, 0.0)
    q = E.truncating_quantiles(s, ["level"], "score", {"lo": "0", "mid": "CAST((total - 1) * 0.5D AS BIGINT)", "hi": "total - 1"}).first()
    assert (q.lo, q.mid, q.hi) == (0.1, 0.5, 0.9)
    d = spark.createDataFrame([("g", i, float(i), float(-i)) for i in range(4)] + [("h", 0, 1.0, 1.0)], "g string, i int, a double, b double")
    assert {r.g: r.rho for r in E.spearman_by_index(d, "g", "i", "a", "b").collect()} == {"g": pytest.approx(-1), "h": 0.0}


def test_zones_are_as_many_as_the_reference_trains(spark, monkeypatch):
    """The query asks for 256 cells and the operator's own iterations."""
    from hodograph.plans import q_motion

    asked = {}

    def train(*args, **kwargs):
        asked.update(k=args[2], rest=kwargs)
        raise InterruptedError

    monkeypatch.setattr(q_motion, "sound_matrices", lambda *_: None)
    monkeypatch.setattr(q_motion.Z, "train_zones", train)
    try:
        q_motion.y3_zones(spark, "")
    except InterruptedError:
        pass
    assert asked == {"k": 256, "rest": {}}
