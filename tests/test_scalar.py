import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hodograph.functions import scalar as S
from hodograph.plans.config import GraphConfig

NAN, INF = float("nan"), float("inf")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def axes(spark, d, s, c, lam=S.LAMBDA):
    got = spark.range(1).select(*(a.alias(f"x{i}") for i, a in enumerate(S.normalize(F.lit(d), F.lit(s), F.lit(c), lam)))).first()
    return tuple(got)


def test_normalize(spark):
    assert axes(spark, 0.0, 0.5, 0.0, 1.0) == pytest.approx((0.5, 1 - math.exp(-0.5), 0.5))
    d, s, c = axes(spark, NAN, 0.5, 1.0)
    assert math.isnan(d) and not math.isnan(s) and c == 1.0
    d, s, c = axes(spark, 1.0, 0.5, -1.0, -3.0)
    assert (d, c) == (1.0, 0.0) and math.isnan(s)
    assert axes(spark, INF, -INF, -INF) == (1.0, 0.0, 0.0)


def test_probe_and_weights(spark):
    assert one(spark, S.probe(F.lit(0.0), F.lit(0.0))) == pytest.approx(0.25)
    assert one(spark, S.probe(F.lit(1.0), F.lit(0.0))) == pytest.approx(0.5)
    assert math.isnan(one(spark, S.probe(F.lit(1.0), F.lit(0.0), 0.7, 0.7)))
    for w in ((-0.1, 0.6, 0.5), (0.5, 0.5, 0.5), (NAN, 0.5, 0.5), (INF, 0, 0)):
        assert not S.valid_weights(w)
    with pytest.raises(ValueError):
        GraphConfig(weights=(0.5, 0.5, 0.5))


@pytest.mark.parametrize("score,late,want", [(0.5, False, "pass"), (0.25, False, "block"), (NAN, False, "pass"), (None, False, "pass"), (1.0, True, "timeout")])
def test_gate(spark, score, late, want):
    assert one(spark, S.verdict(F.lit(score).cast("double"), F.lit(1), F.lit(1 if late else 2))) == want


@pytest.mark.parametrize("s,t,kw,want", [
    ((1, 0, 0), (2, 0, 0), {}, 0.5000125), ((1, 0, 0), (3, 0, 0), {}, 2.0002), ((0, 1, 0), (0, 4, 0), {"beta": 2.0}, 18.0),
    ((0, 0, 1), (0, 0, -2), {"gamma": 4.0}, 12.0), ((0, 0, 0), (100, 0, 0), {}, INF), ((0, 0, 0), (0, 0, 0), {"c": 0.0}, INF),
])
def test_inertial_action(spark, s, t, kw, want):
    got = one(spark, S.inertial_action([F.lit(float(x)) for x in s], [F.lit(float(x)) for x in t], **kw))
    assert got == pytest.approx(want, rel=1e-4)


def test_branch_costs(spark):
    w = (0.4, 0.3, 0.3)
    sim = lambda x: S.branch_action(F.lit(2.0), F.lit(1.0), S.colbert_cost(F.lit(x)), w)
    assert one(spark, sim(0.5)) == pytest.approx(1.25)
    assert one(spark, sim(NAN)) == pytest.approx(1.4)
    assert one(spark, sim(-0.5)) == pytest.approx(1.4)
    assert one(spark, S.lower_bound(F.lit(5.0), F.lit(2), 5, 0.5)) == pytest.approx(6.5)


def test_pareto(spark):
    L = lambda *x: [F.lit(v) for v in x]
    assert one(spark, S.pareto(L(0.9, 0.8, 0.7), L(0.5, 0.5, 0.5))) == "A"
    assert one(spark, S.pareto(L(0.5, 0.5, 0.5), L(0.9, 0.8, 0.7))) == "B"
    assert one(spark, S.pareto(L(0.9, 0.1, 0.5), L(0.1, 0.9, 0.5))) == "-"
    assert one(spark, S.pareto(L(0.5, 0.5, 0.5), L(0.5, 0.5, 0.5))) == "-"
    assert one(spark, S.pareto(L(NAN, 0.9, 0.9), L(0.1, 0.1, 0.1))) == "-"
    assert one(spark, S.distance_to_ideal(L(0.9, 0.1, 0.5), (0.2, 0.8, 0.0))) == pytest.approx(0.650)
    assert one(spark, S.distance_to_ideal(L(0.5, 0.2, 0.5), (0.2, 0.8, 0.0))) == pytest.approx(0.562)


axis = st.floats(0, 1)
weight = st.tuples(st.floats(0.01, 1), st.floats(0.01, 1), st.floats(0.01, 1))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.tuples(axis, axis, axis), st.tuples(axis, axis, axis)), min_size=20, max_size=50), weight)
def test_dominance_orders_scores(spark, pairs, raw):
    w = (raw[0] / sum(raw), raw[1] / sum(raw))
    w = (*w, 1 - sum(w))
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], ", ".join(f"{n} double" for n in "abcxyz"))
    a, b = [F.col(c) for c in "abc"], [F.col(c) for c in "xyz"]
    for r in df.select(S.pareto(a, b).alias("o"), S.combine(a, w).alias("p"), S.combine(b, w).alias("q"), S.pareto(b, a).alias("r")).collect():
        assert -1e-9 <= r.p <= 1 + 1e-9
        assert {"A": "B", "B": "A", "-": "-"}[r.o] == r.r
        if r.o == "A":
            assert r.p >= r.q - 1e-12
