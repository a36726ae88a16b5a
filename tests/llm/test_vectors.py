"""Problems 2, 4 and 6: clusters, nearest vectors, runs."""

import itertools
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hodograph.llm import cells, ivfpq, markov, runs
from hodograph.operators import skyline
from hodograph.runtime import Scratch

from ..conftest import rows

NAN = float("nan")


# --- runs -----------------------------------------------------------------------------------------------------------
def cost(seq, cuts, unlike, penalty):
    total, edges = 0.0, [0, *cuts, len(seq)]
    for a, b in itertools.pairwise(edges):
        part = seq[a:b]
        total += penalty + min(sum(0.0 if x == r else (unlike[x, r] if max(x, r) < len(unlike) else 1.0) for x in part) for r in set(seq))
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=8), st.integers(0, 3))
def test_segmentation_is_optimal(seq, seed):
    r = np.random.default_rng(seed)
    u = r.random((5, 5))
    u = (u + u.T) / 2
    np.fill_diagonal(u, 0)
    got = runs.segment(np.array(seq), lambda own: np.array([[0.0 if x == y else (u[x, y] if max(x, y) < len(u) else 1.0) for y in own] for x in own]), 0.3)
    best = min(cost(seq, c, u, 0.3) for k in range(len(seq)) for c in itertools.combinations(range(1, len(seq)), k))
    assert cost(seq, [a for a, _, _ in got][1:], u, 0.3) == pytest.approx(best)
    assert [b for _, b, _ in got] == [a - 1 for a, _, _ in got[1:]] + [len(seq) - 1]


def test_runs_of_odd_rows(spark):
    same = runs.Unlikeness(np.array([[1, 0], [1, 0.01], [0, 1]]))
    data = [
        ("a", [0, 1, 2, 2, 9, 9, 8], [0, 5, 6, 7, 9, 8, 10]), ("a", [0, 1, 2, 2, 9, 9, 8], [0, 5, 6, 7, 9, 8, 10]), ("twice", [0, 0, 2], [3, 3, 4]),
        ("null", None, [1]), ("none", [], []), ("holes", [0, None, 0], [1, 2, None]), (None, [0], [0]), ("short", [2, 2, 2], [1, 2]),
    ]
    df = spark.createDataFrame([(*d, "x") for d in data], "fact_id string, celle array<int>, pos array<int>, start_pos string")
    got = rows(runs.collapse_runs(df, same).drop("cell"))
    assert [g for g in got if g[0] == "a"] == [("a", 0, 5, 2, 5), ("a", 10, 10, 1, 0), ("a", 6, 7, 2, 1), ("a", 8, 9, 2, 1)]
    assert [g for g in got if g[0] == "twice"] == [("twice", 3, 3, 1, 0), ("twice", 4, 4, 1, 0)]
    assert [g for g in got if g[0] == "holes"] == [("holes", 1, 1, 1, 0)]
    assert [g for g in got if g[0] == "short"] == [("short", 1, 2, 2, 1)]
    assert {g[0] for g in got} == {"a", "twice", "holes", "short"}
    assert runs.collapse_runs(df.limit(0), same).count() == 0


def test_a_long_sequence(spark):
    n = 20_000
    df = spark.createDataFrame([("long", [i // 100 % 3 for i in range(n)], list(range(n)))], "fact_id string, celle array<int>, pos array<int>")
    got = runs.collapse_runs(df, runs.Unlikeness(np.eye(3))).collect()
    assert len(got) == n // 100 and all(g.n_steps == 100 for g in got)


@pytest.mark.parametrize("cells", [np.zeros(1_000_000), np.arange(1_000_000) // 7 % 2], ids=["equal", "near"])
def test_time_is_linear_in_a_run(cells):
    """A million equal or nearly equal steps, all of which tie, are one run."""
    began = time.perf_counter()
    got = runs.segment(cells.astype(np.int64), runs.Unlikeness(np.array([[1, 0], [1, 0.1]])))
    assert len(got) == 1 and got[0][:2] == (0, 999_999) and time.perf_counter() - began < 10


def test_graded_runs_take_in_odd_steps():
    """With a greater penalty one odd step within a run does not end it; two boundaries would cost more."""
    c = np.array([[1, 0, 0], [0.8, 0.6, 0], [0, 0, 1.0]])
    seq = np.array([0, 0, 1, 0, 0, 2, 2, 2])
    assert [r[:2] for r in runs.segment(seq, runs.Unlikeness(c), runs.TOLERANT)] == [(0, 4), (5, 7)]
    assert [r[:2] for r in runs.segment(seq, runs.Unlikeness(c))] == [(0, 1), (2, 2), (3, 4), (5, 7)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 6), min_size=1, max_size=12), min_size=1, max_size=30))
def test_sequences_side_by_side(seqs):
    """Many sequences at once give what each gives alone."""
    u = runs.Unlikeness(np.random.default_rng(1).normal(size=(5, 3)))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    starts, typical = runs.segment_all(np.concatenate(seqs), offsets, u, 0.3)
    want = [(a + o, z) for s, o in zip(seqs, offsets) for a, _, z in runs.segment(np.array(s), u, 0.3)]
    assert list(zip(starts.tolist(), typical.tolist())) == want


# --- clusters -------------------------------------------------------------------------------------------------------
def trajectories(spark, data):
    return spark.createDataFrame([(*d, 1) for d in data], "fact_id string, celle array<int>, pos array<int>, conf array<float>, id int")


def test_points(spark):
    c = np.eye(3)
    data = [
        ("a", [0, 1], [0, 1], [1.0, 1.0]), ("b", [0, 0, 7, 1], [0, 0, 1, 2], [0.5, 0.5, 9.0, NAN]), ("c", [0], [0], [0.0]), ("d", None, [0], [1.0]),
        ("e", [1, None], [0, 1], [-1.0, 1.0]), ("f", [2, 1], [0, 1], [0.5, None]), ("a", [0, 1], [0, 1], [1.0, 1.0]), (None, [0], [0], [1.0]), ("g", [], [], []),
    ]
    t = trajectories(spark, data)
    got = {r.id: np.frombuffer(r.vec, np.float32).tolist() for r in markov.points(t, c).collect()}
    assert got.keys() == {"a", "b", "f"} and got["b"] == [1, 0, 0] and got["a"] == pytest.approx([0.7071, 0.7071, 0], abs=1e-3)
    table = spark.createDataFrame([(c.tolist(),)], "centroidi array<array<float>>")
    joined = {r.id: np.frombuffer(r.vec, np.float32).tolist() for r in markov.points_by_join(t, table).collect()}
    assert joined == {k: pytest.approx(v) for k, v in got.items()}
    by_join = {r.fact_id: r.vec for r in cells.project_by_join(cells.steps(t, conf=True), spark.createDataFrame([(i, c[i].tolist()) for i in range(3)], "cell int, vec array<double>")).collect()}
    assert by_join.keys() == {"a", "b", "f"} and by_join["a"] == [0.5, 0.5, 0]


def blobs(n_groups, sizes, dim=32, spread=0.05, alone=30, seed=0):
    r = np.random.default_rng(seed)
    x, label = [], []
    for g in range(n_groups):
        center = r.normal(size=dim)
        for _ in range(sizes[g % len(sizes)]):
            x.append(center / np.linalg.norm(center) + spread * r.normal(size=dim) / np.sqrt(dim))
            label.append(g)
    for k in range(alone):
        x.append(r.normal(size=dim))
        label.append(n_groups + k)
    order = r.permutation(len(x))
    return cells.unit(np.array(x)).astype(np.float32)[order], np.array(label)[order]


@pytest.mark.parametrize("block", [markov.BLOCK, 16])
def test_markov_clusters(spark, monkeypatch, block):
    """One group holds a third of the records; with small blocks its buckets are cut and its attractors are many."""
    monkeypatch.setattr(markov, "BLOCK", block)
    monkeypatch.setattr(markov, "LOCAL", min(block, markov.LOCAL))
    x, label = blobs(8, [120, 7, 20, 5, 40], alone=40)
    df = spark.createDataFrame([(f"f{i:04d}", bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id string, vec binary, n long").repartition(3)
    got = {r.id: r.cluster_id for r in markov.markov_clusters(df, x.shape[1]).collect()}
    want = {}
    for i, g in enumerate(label):
        want.setdefault(g, f"f{i:04d}")
    assert got == {f"f{i:04d}": want[g] for i, g in enumerate(label)}


def test_flow_stands_behind_every_row(spark, monkeypatch):
    """Each record of a group has an edge and an entry of the flow, in its block or among attractors; the others have none."""
    monkeypatch.setattr(markov, "LOCAL", 16)
    x, label = blobs(8, [120, 7, 20, 5, 40], alone=40)
    ids = [f"f{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, bytearray(v.tobytes()), 1) for i, v in zip(ids, x)], "id string, vec binary, n long").repartition(3)
    scratch = Scratch(spark, "t")
    top, member = markov.local_levels(df, x.shape[1], 0.8, scratch)
    pairs = scratch.cut(markov.similar_pairs(top, x.shape[1], 0.8, scratch), "pairs")
    flow = markov.markov_flow(pairs, top.select("id", "n"), scratch)
    via = dict(map(tuple, member.collect()))
    held = {r.id: r.n for r in top.collect()}
    linked = {v for p in pairs.collect() for v in (p.a, p.b)}
    flows = {f.j for f in flow.collect()}
    size = np.bincount(label)
    for i, g in zip(ids, label):
        assert (held[via[i]] > 1 or via[i] in linked & flows) == (size[g] > 1)
    assert linked == flows and len(linked) >= 2


def test_members_link_clusters_whose_attractors_are_far_apart(spark, monkeypatch):
    """Two blocks hold two records each; three of four pairs between them are links, that of the attractors is none."""
    turn = np.radians([0.0, 20.0, 25.0, 45.0])
    x = np.column_stack([np.cos(turn), np.sin(turn), 0 * turn]).astype(np.float32)
    ddl = "id string, vec binary, n long"
    df = spark.createDataFrame([(i, bytearray(v.tobytes()), 1) for i, v in zip("abcd", x)], ddl)
    top = spark.createDataFrame([(i, bytearray(x[k].tobytes()), 2) for i, k in (("a", 0), ("d", 3))], ddl)
    member = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "d"), ("d", "d")], "id string, via string")
    monkeypatch.setattr(markov, "local_levels", lambda *_: (top, member))
    assert {(r.id, r.cluster_id) for r in markov.markov_clusters(df, 3).collect()} == {(i, "a") for i in "abcd"}


@pytest.mark.parametrize("block", [markov.BLOCK, 16])
def test_links_of_clusters_are_those_of_their_members(spark, monkeypatch, block):
    """Each link of two members counts once, though most pairs share many tables, blocks and copies included."""
    monkeypatch.setattr(markov, "BLOCK", block)
    x, label = blobs(11, [90, 7, 20], alone=10, spread=0.3)
    x, via = np.vstack([x, x[:9]]), np.random.default_rng(1).integers(0, 12, len(x) + 9)
    sim = x.astype(float) @ x.T.astype(float)
    want = {}
    for i, j in zip(*np.nonzero(np.where(sim >= 0.8, via[:, None] < via[None, :], False)), strict=True):
        want[f"{via[i]:02d}", f"{via[j]:02d}"] = want.get((f"{via[i]:02d}", f"{via[j]:02d}"), 0) + sim[i, j]
    size = np.bincount(via)
    pts = spark.createDataFrame([(f"f{i:04d}", bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id string, vec binary, n long").repartition(3)
    top = spark.createDataFrame([(f"{v:02d}", bytearray(x[0].tobytes()), int(n)) for v, n in enumerate(size)], "id string, vec binary, n long")
    member = spark.createDataFrame([(f"f{i:04d}", f"{v:02d}") for i, v in enumerate(via)], "id string, via string")
    got = {(r.a, r.b): r.sim for r in markov.cluster_links(pts, top, member, x.shape[1], 0.8, Scratch(spark, "t")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], w / size[int(k[0])] / size[int(k[1])], rel_tol=1e-5) for k, w in want.items())


def test_narrow_clusters_meet_as_wholes(spark, monkeypatch):
    """Links of cones, of cones that only some members of link, and of rows with cones are those of their members; hashes see rows in no cone only."""
    r, hashed = np.random.default_rng(3), []
    turn = np.radians([0, 4, 30, 42, 50, 62, 75, 170])  # middles of clusters, from all linked to none
    x, via = [], []
    for c, t in enumerate(turn):
        for _ in range(60 if c < 7 else 1):
            v = np.array([np.cos(t), np.sin(t), *np.zeros(6)])
            x.append(v + 0.05 * r.normal(size=8) * (c < 7))
            via.append(c)
    for t in np.radians([36, 55, 66, 110]):  # alone
        x.append(np.array([np.cos(t), np.sin(t), *np.zeros(6)]))
        via.append(via[-1] + 1)
    x, via = cells.unit(np.array(x)).astype(np.float32), np.array(via)
    sim, want = x.astype(float) @ x.T.astype(float), {}
    for i, j in zip(*np.nonzero(np.where(sim >= 0.8, via[:, None] < via[None, :], False)), strict=True):
        want[f"{via[i]:02d}", f"{via[j]:02d}"] = want.get((f"{via[i]:02d}", f"{via[j]:02d}"), 0) + sim[i, j]
    size, links = np.bincount(via), markov.member_links
    monkeypatch.setattr(markov, "LOCAL", 40)
    monkeypatch.setattr(markov, "member_links", lambda rows, *a: hashed.append(rows.count()) or links(rows, *a))
    pts = spark.createDataFrame([(f"f{i:04d}", bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id string, vec binary, n long").repartition(3)
    top = spark.createDataFrame([(f"{v:02d}", bytearray(x[0].tobytes()), int(n)) for v, n in enumerate(size)], "id string, vec binary, n long")
    member = spark.createDataFrame([(f"f{i:04d}", f"{v:02d}") for i, v in enumerate(via)], "id string, via string")
    for limit in (skyline.BROADCAST_LIMIT, 8 * markov.CONE_BYTES):  # all cones at once, and in blocks
        monkeypatch.setattr("hodograph.operators.skyline.BROADCAST_LIMIT", limit)
        got = {(r.a, r.b): r.sim for r in markov.cluster_links(pts, top, member, 8, 0.8, Scratch(spark, "t")).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], w / size[int(k[0])] / size[int(k[1])], rel_tol=1e-6) for k, w in want.items())
    assert len(want) > 12 and hashed[0] < 120


def test_flow_of_cliques_and_copies():
    """Equal records, near ones and a bridge: cliques stay whole, also where each entry is tiny."""
    x = np.tile(np.eye(8, dtype=np.float32)[:1], (markov.LOCAL, 1))
    assert len(set(markov.local_clusters(x, np.ones(len(x), dtype=np.int64), 0.8).tolist())) == 1
    x, label = blobs(3, [300, 6, 90], alone=5)
    own = markov.local_clusters(x, np.ones(len(x), dtype=np.int64), 0.8)
    assert len({(a, b) for a, b in zip(own.tolist(), label.tolist())}) == len(set(own.tolist())) == len(set(label.tolist()))
    s = np.eye(10)
    s[:5, :5] = s[5:, 5:] = 1
    s[4, 5] = s[5, 4] = 0.3
    flow = markov.flow_of(s, np.ones(10)) > 0
    assert not flow[:5, 5:].any() and not flow[5:, :5].any()


def test_edges_of_a_million_vectors_are_found():
    """Pairs of cosine 0.80 to 0.85 under the tables for a million rows: 0.99 of them share a bucket."""
    r = np.random.default_rng(5)
    n, dim = 4000, 64
    bits, tables = markov.tables_for(1_000_000, 0.8, 1e-3)
    a = cells.unit(r.normal(size=(n, dim)))
    b = r.normal(size=(n, dim))
    b = cells.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    c = r.uniform(0.80, 0.85, size=(n, 1))
    planes = markov._planes(tables, bits, dim, 5)
    x, y = (markov._signatures(v.astype(np.float32), planes) for v in (a, c * a + np.sqrt(1 - c**2) * b))
    assert (x == y).any(axis=1).mean() >= 0.99


def test_flow_without_an_end_is_an_error(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], "a string, b string, sim double")
    w = spark.createDataFrame([(i, 1) for i in "abc"], "id string, n long")
    with pytest.raises(RuntimeError):
        markov.markov_flow(pairs, w, Scratch(spark, "t"), rounds=1)


def test_similar_pairs_at_the_limit(spark):
    """Pairs of cosine 0.81: the tables hold their promise for the wanted cosine, not only for 0.90."""
    r = np.random.default_rng(3)
    n, dim = 1250, 64
    a = cells.unit(r.normal(size=(n, dim)))
    b = r.normal(size=(n, dim))
    b = cells.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    x = np.vstack([a, 0.81 * a + math.sqrt(1 - 0.81**2) * b]).astype(np.float32)
    df = spark.createDataFrame([(f"f{i:04d}", bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id string, vec binary, n long")
    got = {(p.a, p.b) for p in markov.similar_pairs(df, dim, 0.8, Scratch(spark, "t")).collect()}
    assert sum((f"f{i:04d}", f"f{i + n:04d}") not in got for i in range(n)) <= 5


def test_typical_members_are_of_all(spark):
    """Every member is ranked by its mean similarity; the leader, here the least typical, does not stand for the group."""
    x, label = blobs(3, [40, 9, 2], alone=3, spread=0.3)
    ids = [f"f{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, bytearray(v.tobytes()), 1) for i, v in zip(ids, x)], "id string, vec binary, n long")
    want, groups = [], []
    for g in set(label.tolist()):
        own = np.flatnonzero(label == g)
        flow = np.round((x[own].astype(float) @ x[own].T.astype(float)).mean(axis=1), 6)
        order = np.lexsort((own, -flow))
        groups += [(ids[i], ids[own[0]], len(own), ids[own[order[-1]]], 0.0) for i in own]
        want += [(ids[own[0]], ids[own[i]], r + 1) for r, i in enumerate(order[:3])]
    c = spark.createDataFrame(groups, "id string, cluster_id string, size long, leader string, flow double")
    got = markov.typical_members(c, df.repartition(3), x.shape[1])
    assert rows(got.select("cluster_id", "id", "rank")) == sorted(want)


def test_markov_of_few(spark):
    ddl = "id string, vec binary, n long"
    assert markov.markov_clusters(spark.createDataFrame([], ddl), 4).count() == 0
    v = np.array([1, 0, 0, 0], np.float32)
    one = spark.createDataFrame([("a", bytearray(v.tobytes()), 1)], ddl)
    assert [(r.id, r.cluster_id) for r in markov.markov_clusters(one, 4).collect()] == [("a", "a")]


def test_markov_flow_parts_two_cliques_with_a_bridge(spark):
    e = [(a, b, 1.0) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 5), 2)] + [(4, 10, 0.3)]
    pairs = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", s) for a, b, s in e], "a string, b string, sim double")
    w = spark.createDataFrame([(f"{i:02d}", 1) for i in [*range(5), *range(10, 15)]], "id string, n long")
    flow = markov.markov_flow(pairs, w, Scratch(spark, "t")).collect()
    assert {(f.i[0], f.j[0]) for f in flow if f.v > 0.01} == {("0", "0"), ("1", "1")}


# --- nearest vectors ------------------------------------------------------------------------------------------------
def brute_nearest(key, k, x, min_cos):
    out = set()
    for a in range(len(x)):
        s = np.round(x[a].astype(float) @ x.T.astype(float), 6)
        cand = sorted((-s[b], key[b]) for b in range(len(x)) if b != a and s[b] >= min_cos)
        out |= {(key[a], c) for _, c in cand[: k[a] or 0]}
    return out


def vectors(spark, key, k, x):
    return spark.createDataFrame([(int(i), None if n is None else int(n), bytearray(v.astype(np.float32).tobytes())) for i, n, v in zip(key, k, x)], "key long, k int, vec binary")


@pytest.mark.parametrize("block,work", [(ivfpq.BLOCK, ivfpq.WORK), (16, 64)])
def test_nearest_vectors(spark, block, work):
    """Recall against brute force, with copies and a list that is cut into blocks and splits."""
    r = np.random.default_rng(0)
    x, _ = blobs(40, [6, 3, 30], dim=64, spread=0.3, alone=200)
    x = np.vstack([x, x[:25], x[:5]])
    key, k = r.permutation(len(x)) - 50, r.choice([0, 1, 3, 8], len(x)).tolist()
    k[0] = None
    want = brute_nearest(key, k, x, 0.9)
    got = {(a, b) for a, b, _ in map(tuple, ivfpq.nearest_vectors(vectors(spark, key, k, x), 64, 0.9, Scratch(spark, "t"), ivfpq.Params(per_list=40), block, work).collect())}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("block,work", [(ivfpq.BLOCK, ivfpq.WORK), (64, 4096)])
def test_whole_lists_have_no_floor(spark, block, work):
    """Every vector gets its k neighbours, most of them far under 0.9, from few of many lists."""
    r = np.random.default_rng(2)
    x, _ = blobs(60, [12, 5, 30], dim=64, spread=0.9, alone=300, seed=4)
    x = np.vstack([x, x[:10]])
    key, k = r.permutation(len(x)), r.choice([0, 1, 3, 12, 40], len(x)).tolist()
    want = brute_nearest(key, k, x, -2.0)
    assert len(brute_nearest(key, k, x, 0.9)) < 0.2 * len(want)
    got = ivfpq.nearest_vectors(vectors(spark, key, k, x), 64, None, Scratch(spark, "t"), ivfpq.Params(per_list=40, probes=12), block, work).collect()
    each = {}
    for g in got:
        each[g.key] = each.get(g.key, 0) + 1
    assert each == {a: n for a, n in zip(key.tolist(), k) if n} and len({(g.key, g.other) for g in got}) == len(got)
    assert len(want & {(g.key, g.other) for g in got}) >= 0.9 * len(want)


def test_copies_tie_by_key(spark):
    x = np.tile(np.eye(64, dtype=np.float32)[:1], (10, 1))
    got = rows(ivfpq.nearest_vectors(vectors(spark, range(10), [2] * 10, x), 64, 0.9, Scratch(spark, "t")).drop("cos"))
    assert got == sorted(brute_nearest(list(range(10)), [2] * 10, x, 0.9))
    assert ivfpq.nearest_vectors(vectors(spark, [], [], []), 64, 0.9, Scratch(spark, "t")).count() == 0


def test_unnest(spark):
    ok = [1.0, 2.0]
    data = [(1, 5, [ok, None, [NAN, 1.0], [0.0, 0.0], [1.0], [], ok, [None, 1.0], [float("inf"), 1.0], [1e300, 1e300]]), (2, None, None), (3, 1, []), (4, 1, [ok])]
    df = spark.createDataFrame(data, "row_id long, k int, multivector array<array<double>>").coalesce(1)
    got = df.mapInArrow(ivfpq._unnest(2, 64), "key long, k int, vec binary").collect()
    assert [(g.key, g.k) for g in got] == [(64, 5), (70, 5), (73, 5), (256, 1)]
    assert all(np.linalg.norm(np.frombuffer(g.vec, np.float32)) == pytest.approx(1) for g in got)
