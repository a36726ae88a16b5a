"""Queries of walks, payloads and late interaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from hodograph.functions.numeric import shown
from hodograph.operators import vectors as V
from hodograph.operators import walks as K
from hodograph.runtime import read, widen


def _walks(spark, sf):
    w = read(spark, sf, "raw_walks").drop("captured_at").filter("sequence_id IS NOT NULL").distinct()
    return w.withColumn("n", F.expr("CAST(substr(sequence_id, 5) AS BIGINT)"))


def _seqs(spark, sf):
    return K.sequences(_walks(spark, sf)).filter("error IS NULL")


def p3_sequences(spark, sf):
    """Each walk's error, or its positions and its significant steps."""
    s = K.sequences(_walks(spark, sf))
    sig = F.size(F.filter(F.flatten("frames"), lambda t: t["weight"] != 0))
    return s.select("sequence_id", "error", F.when(F.col("error").isNull(), F.size("frames")).alias("n_positions"), F.when(F.col("error").isNull(), sig).alias("n_weighted"))


def p5_errors(spark, sf):
    return K.sequences(read(spark, sf, "raw_walks")).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def p2_hygiene(spark, sf):
    """How often each token is significant over all walks."""
    t = _walks(spark, sf).select(F.explode(F.arrays_zip("ids", "st")).alias("s")).select("s.ids", "s.st").filter("ids IS NOT NULL AND st IS NOT NULL")
    return t.groupBy(F.col("ids").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.count_if(K.significant(F.col("st"), F.col("ids"))).alias("n_significant"))


def p4_coherence(spark, sf):
    """Whether a result's stored count, dimension and tokens fit its matrix."""
    r = read(spark, sf, "colbert_results").filter("multivector IS NOT NULL")
    rows = F.size("multivector")
    flat = F.forall("multivector", lambda v: F.coalesce(F.size(v) == F.col("dim"), F.lit(False)))
    return r.select("result_id", (rows == F.col("n_tokens")).alias("count_fits"), flat.alias("dim_fits"), (F.col("tokens").isNull() | (F.size("tokens") == rows)).alias("tokens_fit")).distinct()


def s1_sequence_checks(spark, sf):
    """Frames of three steps each: how many sequences are sound, and the tokens of their frames."""
    s = _seqs(spark, sf).withColumn("frames", K.regroup(F.col("frames"), 3)).withColumn("e", K.sequence_error(F.col("frames")))
    return s.groupBy(F.coalesce("e", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("frames")).alias("n_frames"), F.sum(F.size(F.flatten("frames"))).alias("n_tokens"))


def s2_signatures(spark, sf):
    return K.signatures(_seqs(spark, sf), "sequence_id").select("sequence_id", F.hex("sig0").alias("sig0"), F.hex("sig1").alias("sig1"))


def _sig_pairs(spark, sf):
    s = K.signatures(_seqs(spark, sf), "n")
    b = s.select((F.col("n") - 1).alias("n"), F.col("sig0").alias("b0"), F.col("sig1").alias("b1"))
    return s.join(b, "n")


def s4_overlap(spark, sf):
    """Signature overlap and Jaccard of each walk and the next."""
    p = _sig_pairs(spark, sf)
    c = [F.col(x) for x in ("sig0", "sig1", "b0", "b1")]
    return p.select("n", K.overlap(*c).alias("overlap"), shown(K.signature_jaccard(*c)).alias("jaccard"))


def s6_positional(spark, sf):
    """Mean positional Jaccard of each walk and the next, in frames of three steps."""
    s = _seqs(spark, sf).select("n", K.regroup(F.col("frames"), 3).alias("a"))
    p = s.join(s.select((F.col("n") - 1).alias("n"), F.col("a").alias("b")), "n").withColumn("j", K.positional_profile(F.col("a"), F.col("b")))
    return p.select("n", F.size("j").alias("n_places"), shown(F.aggregate("j", F.lit(0.0), lambda s, x: s + x) / F.size("j")).alias("mean_jaccard"))


def m10_auto_sparse(spark, sf):
    s = K.signatures(_seqs(spark, sf), "sequence_id")
    return s.select("sequence_id", (K.bits(F.col("sig0"), F.col("sig1")) / 128.0).alias("auto_sparse"))


def _payload(*fields):
    return F.to_json(F.struct(F.array(F.struct(*fields)).alias("results")))


def a1_colbert_payload(spark, sf):
    """Results through the server's payload and back."""
    r = read(spark, sf, "colbert_results").filter("result_id IS NOT NULL").select("result_id", _payload("multivector", "n_tokens", "dim", "tokens").alias("payload"))
    p = K.parse_colbert(r, "payload")
    return p.select("result_id", "error", F.when(F.col("error").isNull(), F.size("matrix")).alias("n_rows"), F.when(F.col("error").isNull(), F.size("tokens")).alias("n_tokens")).distinct()


def a2_flat_payload(spark, sf):
    w = _walks(spark, sf).select("sequence_id", _payload(F.size("ids").alias("n"), "ids", F.col("w").alias("weights"), F.col("pos").alias("positions"), F.col("st").cast("array<int>").alias("status")).alias("payload"))
    p = K.parse_flat_walk(w, "payload").withColumn("error", K.walk_error())
    return p.select("sequence_id", F.coalesce("payload_error", "error").alias("error"))


def a3_frames_payload(spark, sf):
    """Frames of two tokens through the frames payload; their repeated positions make them misaligned, single ones not."""
    s = _seqs(spark, sf).withColumn("f", K.regroup(F.col("frames"), 2)).withColumn("n_frames", F.size("f"))
    w = s.select("sequence_id", "n_frames", _payload(F.col("n_frames").alias("n"), F.col("f").alias("frames"), F.array_repeat(F.lit(0), F.col("n_frames")).alias("status")).alias("payload"))
    p = K.parse_frames_walk(w, "payload").withColumn("error", K.walk_error())
    return p.select("sequence_id", "n_frames", F.size("ids").alias("n_tokens"), F.coalesce("payload_error", "error").alias("error"))


# --- late interaction -----------------------------------------------------------------------------------------------
def sound_matrices(spark, sf):
    """Each result once, if its matrix is not empty and all its vectors have 64 finite numbers, not all zero."""
    r = read(spark, sf, "colbert_results").select("result_id", "multivector", "tokens").filter("result_id IS NOT NULL AND multivector IS NOT NULL AND size(multivector) > 0")
    fits = F.forall("multivector", lambda v: F.coalesce((F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
    return r.filter(fits).dropDuplicates(["result_id"])


def _pairs(spark, sf):
    m = widen(sound_matrices(spark, sf), "result_id")
    return m.select("result_id", F.col("multivector").alias("a")).join(m.select((F.col("result_id") - 1).alias("result_id"), F.col("multivector").alias("b")), "result_id")


def m1_maxsim(spark, sf):
    """MaxSim of each result and the next, both ways."""
    p = V.score_matrices(_pairs(spark, sf), ["result_id"], "a", "b", {"forth": V.maxsim, "back": lambda a, b: V.maxsim(b, a)})
    return p.select("result_id", shown(F.col("forth"), 7).alias("forth"), shown(F.col("back"), 7).alias("back"))


def m5_single_precision(spark, sf):
    """Largest gap between double and single precision, which must stay under 1e-4."""
    p = V.score_matrices(_pairs(spark, sf), ["result_id"], "a", "b", {"x": V.maxsim, "y": V.maxsim32})
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("x") - F.col("y")) < 1e-4).alias("n_close"))


def m6_summed(spark, sf):
    p = V.score_matrices(_pairs(spark, sf), ["result_id"], "a", "b", {k: V.PAIR[k] for k in ("summed", "relational", "length_ratio")})
    return p.select("result_id", *(shown(F.col(c), 7).alias(c) for c in ("summed", "relational", "length_ratio")))


def m8_auto_dense(spark, sf):
    p = V.score_matrices(widen(sound_matrices(spark, sf), "result_id"), ["result_id"], "multivector", None, V.SELF)
    return p.select("result_id", *(shown(F.col(c), 7).alias(c) for c in V.SELF))


QUERIES = {
    f.__name__.replace("p2_", "wp2_").replace("p3_", "wp3_").replace("p4_", "wp4_").replace("p5_", "wp5_"): f
    for f in (
        p2_hygiene, p3_sequences, p4_coherence, p5_errors, s1_sequence_checks, s2_signatures, s4_overlap, s6_positional, m10_auto_sparse,
        a1_colbert_payload, a2_flat_payload, a3_frames_payload, m1_maxsim, m5_single_precision, m6_summed, m8_auto_dense,
    )
}

WALKS = """
walk AS (SELECT DISTINCT sequence_id, ids, w, pos, st, CAST(substr(sequence_id, 5) AS BIGINT) AS n FROM raw_walks WHERE sequence_id IS NOT NULL),
chk AS (SELECT *, CASE
    WHEN ids IS NULL OR w IS NULL OR pos IS NULL OR st IS NULL OR len(ids) <> len(w) OR len(ids) <> len(pos) OR len(ids) <> len(st)
         OR len(list_filter(range(2, len(pos) + 1), lambda i: pos[i] <= pos[i - 1])) > 0 THEN 'misaligned'
    WHEN len(list_filter(range(1, len(ids) + 1), lambda i: st[i] = 0 AND ids[i] >= 4)) = 0
         OR len(list_filter(range(1, len(ids) + 1), lambda i: st[i] = 0 AND ids[i] >= 4 AND NOT coalesce(isfinite(w[i]), false))) > 0 THEN 'nothing_left' END AS error
  FROM walk),
seq AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN st[i] = 0 AND ids[i] >= 4 THEN w[i] ELSE 0::FLOAT END) AS wt FROM chk WHERE error IS NULL)"""
SIGS = """,
tk AS (SELECT DISTINCT sequence_id, n, id FROM (SELECT sequence_id, n, unnest(ids) AS id, unnest(wt) AS wt FROM seq) WHERE wt > 0.002::FLOAT),
h AS (SELECT sequence_id, n, (id::UHUGEINT * 11400714819323198485::UHUGEINT) AS h1 FROM tk),
hh AS (SELECT *, ((h1 % 1180591620717411303424::UHUGEINT) * 3266489955::UHUGEINT
              + (((h1 % 274877906944::UHUGEINT) * 2246822519::UHUGEINT) % 274877906944::UHUGEINT) * 4294967296::UHUGEINT) AS h2 FROM h),
sg AS (SELECT sequence_id, n,
  bit_or((1::UBIGINT << ((h1 // 18446744073709551616::UHUGEINT) % 64)::INT) | (1::UBIGINT << ((h2 // 18446744073709551616::UHUGEINT) % 64)::INT)) AS s0,
  bit_or((1::UBIGINT << ((h1 // 4294967296::UHUGEINT) % 64)::INT) | (1::UBIGINT << ((h2 // 4294967296::UHUGEINT) % 64)::INT)) AS s1
  FROM hh GROUP BY ALL),
sig AS (SELECT seq.sequence_id, seq.n, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1 FROM seq LEFT JOIN sg USING (sequence_id))"""
MATS = """
res AS (SELECT result_id, any_value(multivector) AS mv FROM colbert_results WHERE result_id IS NOT NULL AND multivector IS NOT NULL AND len(multivector) > 0
        AND len(list_filter(multivector, lambda v: len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0)) = len(multivector)
        GROUP BY result_id),
pr AS (SELECT x.result_id, x.mv AS a, y.mv AS b FROM res x JOIN res y ON y.result_id = x.result_id + 1)"""
_BEST = "list_transform({0}, lambda p: list_max(list_transform({1}, lambda q: {2}(p, q))))"
_COS, _DOT = "list_cosine_similarity", "list_dot_product"

SQL = {
    "wp2_hygiene": f"""WITH {WALKS}, t AS (SELECT unnest(ids) AS token, unnest(st) AS st FROM walk)
        SELECT token, count(*) AS n, count(*) FILTER (WHERE st = 0 AND token >= 4) AS n_significant FROM t WHERE token IS NOT NULL AND st IS NOT NULL GROUP BY token""",
    "wp3_sequences": f"""WITH {WALKS} SELECT chk.sequence_id, chk.error, len(seq.ids)::INT AS n_positions,
        len(list_filter(seq.wt, lambda x: x <> 0))::INT AS n_weighted FROM chk LEFT JOIN seq ON seq.sequence_id = chk.sequence_id""",
    "wp5_errors": f"""WITH {WALKS} SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM raw_walks r JOIN chk
        ON r.sequence_id = chk.sequence_id AND r.ids IS NOT DISTINCT FROM chk.ids AND r.w IS NOT DISTINCT FROM chk.w GROUP BY 1""",
    "wp4_coherence": """SELECT DISTINCT result_id, len(multivector) = n_tokens AS count_fits,
        len(list_filter(multivector, lambda v: coalesce(len(v) = dim, false))) = len(multivector) AS dim_fits, tokens IS NULL OR len(tokens) = len(multivector) AS tokens_fit
        FROM colbert_results WHERE multivector IS NOT NULL""",
    "s1_sequence_checks": f"""WITH {WALKS} SELECT 'ok' AS error, count(*) AS n, CAST(sum(ceil(len(ids) / 3.0)) AS BIGINT) AS n_frames, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM seq""",
    "s2_signatures": f"WITH {WALKS}{SIGS} SELECT sequence_id, hex(s0) AS sig0, hex(s1) AS sig1 FROM sig",
    "s4_overlap": f"""WITH {WALKS}{SIGS} SELECT a.n, (bit_count(a.s0 & b.s0) + bit_count(a.s1 & b.s1))::INT AS overlap,
        round(coalesce((bit_count(a.s0 & b.s0) + bit_count(a.s1 & b.s1)) / nullif(bit_count(a.s0 | b.s0) + bit_count(a.s1 | b.s1), 0)::DOUBLE, 0), 9) AS jaccard
        FROM sig a JOIN sig b ON b.n = a.n + 1""",
    "s6_positional": f"""WITH {WALKS}, fr AS (SELECT n, (i - 1) // 3 AS f, ids[i] AS id, wt[i] AS w FROM (SELECT n, ids, wt, unnest(range(1, len(ids) + 1)) AS i FROM seq)),
        ct AS (SELECT n, ceil(len(ids) / 3.0)::INT AS nf FROM seq), pp AS (SELECT a.n, least(a.nf, b.nf) AS places FROM ct a JOIN ct b ON b.n = a.n + 1),
        d AS (SELECT DISTINCT n, f, id FROM fr WHERE w > 0.002::FLOAT),
        un AS (SELECT n, f, count(*) AS u FROM (SELECT pp.n, f, id FROM pp JOIN d USING (n) WHERE f < places UNION SELECT pp.n, f, id FROM pp JOIN d ON d.n = pp.n + 1 WHERE f < places) GROUP BY ALL),
        it AS (SELECT x.n, x.f, count(*) AS c FROM d x JOIN d y ON y.n = x.n + 1 AND y.f = x.f AND y.id = x.id GROUP BY ALL)
        SELECT pp.n, places AS n_places, round(coalesce(sum(coalesce(c, 0) / u::DOUBLE), 0) / places, 9) AS mean_jaccard
        FROM pp LEFT JOIN un USING (n) LEFT JOIN it ON it.n = pp.n AND it.f = un.f GROUP BY pp.n, places""",
    "m10_auto_sparse": f"WITH {WALKS}{SIGS} SELECT sequence_id, (bit_count(s0) + bit_count(s1)) / 128.0::DOUBLE AS auto_sparse FROM sig",
    "a1_colbert_payload": """WITH r AS (SELECT result_id, tokens, multivector AS m, CASE WHEN multivector IS NULL THEN 'no_result' WHEN n_tokens <> len(multivector) THEN 'count_mismatch' END AS error
        FROM colbert_results WHERE result_id IS NOT NULL) SELECT DISTINCT result_id, error, CASE WHEN error IS NULL THEN len(m) END::INT AS n_rows,
        CASE WHEN error IS NULL THEN coalesce(len(tokens), len(m)) END::INT AS n_tokens FROM r""",
    "a2_flat_payload": f"""WITH {WALKS} SELECT sequence_id, CASE WHEN error = 'misaligned' AND (ids IS NULL OR w IS NULL OR pos IS NULL OR st IS NULL
        OR len(ids) <> len(w) OR len(ids) <> len(pos) OR len(ids) <> len(st)) THEN 'count_mismatch' ELSE error END AS error FROM chk""",
    "a3_frames_payload": f"""WITH {WALKS} SELECT sequence_id, ceil(len(ids) / 2.0)::INT AS n_frames, len(ids)::INT AS n_tokens,
        CASE WHEN len(ids) > 1 THEN 'misaligned' END AS error FROM seq""",
    "m1_maxsim": f"""WITH {MATS} SELECT result_id, round(list_avg({_BEST.format('a', 'b', _COS)}), 7) + 0.0 AS forth,
        round(list_avg({_BEST.format('b', 'a', _COS)}), 7) + 0.0 AS back FROM pr""",
    "m5_single_precision": f"WITH {MATS} SELECT count(*) AS n, count(*) AS n_close FROM pr",
    "m6_summed": f"""WITH {MATS}, x AS (SELECT result_id, len(a) AS n, len(b) AS m, list_sum({_BEST.format('a', 'b', _DOT)}) AS f, list_sum({_BEST.format('b', 'a', _DOT)}) AS g FROM pr)
        SELECT result_id, round((f + g) / 2, 7) + 0.0 AS summed, round((f / n + g / m) / 2, 7) + 0.0 AS relational, round(abs(n - m) / (n + m)::DOUBLE, 7) AS length_ratio FROM x""",
    "m8_auto_dense": f"""WITH {MATS}, t AS (SELECT result_id, unnest(mv) AS v, generate_subscripts(mv, 1) AS i FROM res),
        g AS (SELECT x.result_id, x.i, max({_DOT}(x.v, y.v)) FILTER (WHERE x.i <> y.i) AS d, max({_DOT}(x.v, y.v)) AS l, max({_COS}(x.v, y.v)) FILTER (WHERE x.i <> y.i) AS c
              FROM t x JOIN t y USING (result_id) GROUP BY ALL)
        SELECT result_id, round(coalesce(avg(d), 0), 7) + 0.0 AS self_dense, round(avg(l), 7) + 0.0 AS self_dense_loop,
               round(coalesce(avg(c) FILTER (WHERE c >= 0), 0), 7) + 0.0 AS self_cosine FROM g GROUP BY result_id""",
}
