"""Problems 1, 3 and 5: top-n, similar sets, components."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hodograph.llm import components, copies, setjoin, topn
from hodograph.operators import graph

from ..conftest import rows

NAN, INF = float("nan"), float("inf")


# --- top-n ----------------------------------------------------------------------------------------------------------
def test_top_n_against_sorting(spark):
    r = random.Random(1)
    data = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(15)]), r.choice([0.5, 0.25, NAN, INF, -INF, None, round(r.random(), 1)]), "x") for _ in range(600)]
    df = spark.createDataFrame(data, "g int, i int, s double, rank string")  # a clashing name
    want = []
    for g in (1, 2, 3):
        best = {}
        for a, i, s, _ in data:
            if a == g and i is not None and s is not None and s == s and abs(s) != INF:
                best[i] = max(best.get(i, -INF), s)
        want += [(g, i, s, k) for k, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4], 1)]
    assert rows(topn.top_n_per_group(df, "g", "i", "s", 4)) == sorted(want, key=repr)


def test_top_n_own_limits(spark):
    df = spark.createDataFrame([(1, i, 0.5, 2) for i in range(5)] + [(2, i, 0.5, None) for i in range(5)] + [(3, 1, 0.5, 9)] * 3, "g int, i int, s double, n int")
    assert rows(topn.top_n_per_group(df, "g", "i", "s", 10, "n")) == [(1, 0, 0.5, 1), (1, 1, 0.5, 2), (3, 1, 0.5, 1)]
    assert rows(topn.top_n_per_group(df, "g", "i", "s", 0)) == []
    assert rows(topn.top_n_per_group(df.limit(0), "g", "i", "s", 3)) == []


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), F.rand(1).alias("s"))
    plan = topn.top_n_per_group(df, "g", "i", "s", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --- components -----------------------------------------------------------------------------------------------------
def brute_components(pairs):
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(70)],  # a chain
    [(0, i) for i in range(1, 300)] + [(500, 499)],  # a star that holds nearly all
    [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4), (7, 6), (6, 8)],
    [(random.Random(2).randrange(400), random.Random(i).randrange(400)) for i in range(300)],
])
def test_components(spark, pairs):
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "x long, y long, node_id int")
    assert sorted(map(tuple, components.connected_components(df, "x", "y").collect())) == brute_components(pairs)


def test_components_of_nothing_and_of_strings(spark):
    df = spark.createDataFrame([], "x long, y long")
    assert components.connected_components(df, "x", "y").count() == 0
    s = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "z")], "x string, y string")
    assert rows(components.connected_components(s, "x", "y")) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_components_reports_no_end(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "x long, y long").repartition(50)
    with pytest.raises(RuntimeError):
        components.connected_components(df, "x", "y", max_rounds=1)


def test_components_over_many_tasks(spark, monkeypatch):
    """Chains whose links lie in many tasks, which combine three links at once, so that rounds have to join them."""
    monkeypatch.setattr(graph, "LOT", 3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i // 2) for i in range(1, 200)]
    random.Random(3).shuffle(pairs)
    df = spark.createDataFrame(pairs, "x long, y long").repartition(20)
    assert sorted(map(tuple, components.connected_components(df, "x", "y").collect())) == brute_components(pairs)


# --- similar sets ---------------------------------------------------------------------------------------------------
def brute_pairs(sets, t):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def make_sets(seed, n=150, width=12):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        if i % 3 and out:
            s = set(r.choice(list(out.values())))
            for _ in range(r.randrange(4)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(1000))
            out[f"s{i:04d}"] = s
        else:
            out[f"s{i:04d}"] = {r.randrange(1000) for _ in range(width)}
    return out


@pytest.mark.parametrize("hot", [setjoin.HOT_BUCKET, 2])
def test_similar_sets(spark, hot):
    """Also where every bucket counts as hot and is split by rare tokens."""
    sets = make_sets(4)
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, s array<bigint>").repartition(3)
    pairs, members = setjoin.similar_sets(df, "k", "s", 0.6, hot_bucket=hot)
    got = set(map(tuple, copies.expand_pairs(pairs, members).collect()))
    assert got == brute_pairs(sets, 0.6)


def test_similar_sets_of_odd_rows(spark):
    data = [("a", [1, 2, 3, 4, 5]), ("b", [5, 4, 3, 2, 1, 1]), ("c", [1, 2, 3, None]), ("d", []), ("e", None), (None, [1]), ("a", [1, 2, 3, 4, 5])]
    df = spark.createDataFrame([(*d, "x") for d in data], "k string, s array<bigint>, rep string")
    pairs, members = setjoin.similar_sets(df, "k", "s", 0.6)
    assert rows(members) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert rows(pairs) == [("a", "c", 0.6)]  # the limit is included
    assert rows(copies.expand_pairs(pairs, members)) == [("a", "b"), ("a", "c"), ("b", "c")]
    pairs, members = setjoin.similar_sets(df.limit(0), "k", "s")
    assert pairs.count() == 0 and members.count() == 0


def test_counting_ids(spark):
    ddl = "sequence_id string, ids array<bigint>, w array<float>, pos array<bigint>, st array<tinyint>"
    data = [("a", [1, 4, 5, 6, 5], [1.0, 0.002, 0.5, NAN, 0.4], [0] * 5, [0] * 5), ("b", [7], [1.0], [0], [1]), ("c", [7], [1.0], [0], None), ("d", [7], [1.0, 1.0], [0], [0])]
    got = dict(rows(spark.createDataFrame(data, ddl).select("sequence_id", setjoin.counting_ids())))
    assert got == {"a": [5], "b": None, "c": None, "d": None}


def test_a_group_of_copies_stays_linear(spark):
    members = spark.createDataFrame([(f"a{i:03d}", "a000") for i in range(40)] + [(f"b{i:03d}", "b000") for i in range(40)], "id string, rep string")
    pairs = spark.createDataFrame([("a000", "b000")], "a string, b string")
    with pytest.warns(UserWarning, match="40 records"):
        got = set(map(tuple, copies.expand_pairs(pairs, members, write_out=100).collect()))
    assert len(got) == 2 * 39 + 79 and all(a < b for a, b in got)
    linked = {x for p in got for x in p}
    assert linked == {r[0] for r in members.select("id").collect()}
    full = copies.expand_pairs(pairs, members)
    assert full.count() == 80 * 79 // 2
