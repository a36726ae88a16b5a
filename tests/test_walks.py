import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodograph.operators import vectors as V
from hodograph.operators import walks as K
from hodograph.sources import readers, sinks

from .conftest import rows

M128 = (1 << 128) - 1


def bits(token):
    h1 = token * K.MULTIPLIER_1 & M128
    h2 = h1 * K.MULTIPLIER_2 & M128
    return [(h1 >> 64) & 63, (h2 >> 64) & 63, (h1 >> 32) & 63, (h2 >> 32) & 63]


def test_token_bits_match_wide_arithmetic(spark):
    r = random.Random(0)
    tokens = [0, 1, 4, (1 << 32) - 1, 250_000] + [r.randrange(1 << 32) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in tokens], "t long")
    for row in df.select("t", *(c.alias(f"b{i}") for i, c in enumerate(K.token_bits(F.col("t"))))).collect():
        assert list(row)[1:] == bits(row.t)


def walks(spark, data):
    return spark.createDataFrame(data, "sequence_id string, ids array<bigint>, w array<float>, pos array<bigint>, st array<tinyint>")


def seqs(spark, sets):
    return K.sequences(walks(spark, [(k, list(t), [0.5] * len(t), list(range(len(t))), [0] * len(t)) for k, t in sets.items()]))


def test_signature_overlaps(spark):
    m = {r.token: (r.m0, r.m1) for r in K.token_masks(spark.createDataFrame([(t,) for t in (1, 2, 100000, 4000000)], "t long"), "t").collect()}
    sig = lambda *ts: [sum({1 << b for t in ts for b in range(64) if m[t][h] >> b & 1}) for h in (0, 1)]
    x = lambda a, b: sum(bin(u & v).count("1") for u, v in zip(a, b))
    assert x(sig(1, 2), sig(1, 2)) == 8 and x(sig(1, 2), sig(100000, 4000000)) == 1
    s = {r.sequence_id: (r.sig0, r.sig1) for r in K.signatures(seqs(spark, {"a": [100000], "b": [4000000, 100000]}), "sequence_id").collect()}
    assert s["a"] == m[100000] and s["b"] == tuple(p | q for p, q in zip(m[100000], m[4000000]))


def test_walk_errors(spark):
    data = [
        ("ok", [0, 5, 6], [0.1, 0.2, 0.7], [0, 1, 2], [0, 1, 0]), ("short", [5, 6], [0.1], [0, 1], [0, 0]), ("order", [5, 6, 7], [0.1] * 3, [0, 1, 1], [0] * 3),
        ("special", [0, 1, 2], [0.1] * 3, [0, 1, 2], [0] * 3), ("nan", [5], [float("nan")], [0], [0]), ("null", None, [0.1], [0], [0]), ("none", [], [], [], []),
    ]
    got = {r.sequence_id: (r.error, r.frames) for r in K.sequences(walks(spark, data)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "ok": None, "short": "misaligned", "order": "misaligned", "special": "nothing_left", "nan": "nothing_left", "null": "misaligned", "none": "nothing_left",
    }
    assert [round(f[0].weight, 3) for f in got["ok"][1]] == [0.0, 0.0, 0.7]


def test_positional_jaccard(spark):
    f = "array<struct<token:bigint,weight:float>>"
    df = spark.createDataFrame(
        [(1, [(1, 0.5), (2, 0.3)], [(1, 0.5), (3, 0.3)]), (2, [(1, -0.5)], [(1, 0.0)]), (3, [], [])], f"k int, a {f}, b {f}"
    )
    got = dict(rows(df.select("k", K.positional_jaccard(F.col("a"), F.col("b")))))
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: 1.0}


def test_payloads(spark):
    good = {"results": [{"multivector": [[1.0, 0.0]], "n_tokens": 1, "dim": 2}]}
    bad = {"results": [{"multivector": [[1.0, 0.0]], "n_tokens": 2, "dim": 2, "tokens": ["x"]}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, '{"results": []}'), (4, None)], "k int, p string")
    got = {r.k: r for r in K.parse_colbert(df, "p").collect()}
    assert got[1].error is None and got[1].tokens == [""]
    assert [got[i].error for i in (2, 3, 4)] == ["count_mismatch", "no_result", "no_result"]
    frames = {"results": [{"n": 2, "frames": [[{"token": 5, "weight": 0.5}, {"token": 6, "weight": 0.2}], [{"token": 7, "weight": 0.1}]], "status": [0, 0]}]}
    w = K.parse_frames_walk(spark.createDataFrame([("x", json.dumps(frames))], "sequence_id string, p string"), "p")
    assert w.first().pos == [0, 0, 1] and w.select(K.walk_error()).first()[0] == "misaligned"


def test_late_interaction():
    e = np.eye(3)
    assert V.maxsim(e, e) == pytest.approx(1) and V.maxsim(e[:1], e[1:]) == pytest.approx(0)
    for q, d in ((None, e), (e, None), (np.zeros((1, 3)), e), (np.full((1, 3), np.nan), e), (np.eye(2), e)):
        assert math.isnan(V.maxsim(q, d))
    r = np.random.default_rng(0)
    a, b = r.normal(size=(5, 8)), r.normal(size=(7, 8))
    want = np.mean([max(x @ y / np.linalg.norm(x) / np.linalg.norm(y) for y in b) for x in a])
    assert V.maxsim(a, b) == pytest.approx(want) and abs(V.maxsim32(a, b) - want) < 1e-4
    assert V.self_dense(a[:1]) == 0 and V.length_ratio(a, b) == pytest.approx(2 / 12)


def test_matrices_of_any_shape(spark):
    data = [(1, [[1.0, 0.0], [0.0, 1.0]]), (2, None), (3, []), (4, [[1.0], [1.0, 2.0]]), (5, [None, [1.0, 2.0]]), (6, [[3.0, 4.0]])]
    df = spark.createDataFrame(data, "k int, m array<array<double>>").coalesce(1)
    got = dict(rows(V.score_matrices(df, ["k"], "m", None, {"n": lambda a, _: -1.0 if a is None else float(a.sum())})))
    assert got == {1: 2.0, 2: -1.0, 3: -1.0, 4: -1.0, 5: -1.0, 6: 7.0}


def test_files(spark, tmp_path):
    d = {"versione": "v1", "K": 2, "dim": 2, "metric": "cosine", "centroidi": [[1.0, 0.0], [0.0, 1.0]], "more": 1}
    (tmp_path / "d.json").write_text(json.dumps(d, indent=1))
    t = readers.read_dictionary(spark, str(tmp_path / "d.json"))
    assert t.first().k == 2
    sinks.write_dictionary(t, str(tmp_path / "out"))
    assert readers.read_dictionary(spark, str(tmp_path / "out")).first().centroidi == [[1.0, 0.0], [0.0, 1.0]]
    (tmp_path / "t.json").write_text(json.dumps({"f1": {"celle": [1], "pos": [0], "conf": [0.5]}, "f2": {"celle": [], "pos": [], "conf": []}}))
    assert readers.read_trajectories(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "i.json").write_text(json.dumps({"p": {"category": "c", "text_a": "x", "text_b": "y"}}))
    assert rows(readers.read_pair_index(spark, str(tmp_path / "i.json"))) == [("p", "c", "x", "y")]
    side = lambda k: {f"p_{k}_dense": np.ones((2, 3), np.float32), f"p_{k}_ids": np.array([1, 2], np.int16), f"p_{k}_weights": np.array([0.5, 0.1], np.float32)}
    np.savez(tmp_path / "x.npz", **side("a"), **side("b"), p_a_status=np.array([0, 1], np.int8), other=np.ones(1))
    got = {r.side: r for r in readers.read_npz(spark, str(tmp_path / "x.npz")).collect()}
    assert got["a"].ids == [1, 2] and got["a"].status == [0, 1] and got["b"].status is None and len(got["b"].dense) == 2
