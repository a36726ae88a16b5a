"""Walks of token ids: hygiene, sequences, signatures and overlaps; payloads of a capture server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodograph.functions.numeric import finite

# Least weight of a token that is present, first ordinary id, and the two multipliers of the signature.
PRESENT = 0.002
FIRST_ID = 4
MULTIPLIER_1, MULTIPLIER_2 = 0x9E3779B97F4A7C15, 0x85EBCA77C2B2AE63


# --- hygiene --------------------------------------------------------------------------------------------------------
def significant(status: Column, token: Column) -> Column:
    return (status == 0) & (token >= FIRST_ID)


def walk_error() -> Column:
    """Why a stored walk is no sequence, or null: ``misaligned`` (a null array, unequal lengths, positions that do not
    grow) or ``nothing_left`` (no significant step, or one whose weight is not finite)."""
    lengths = (F.size("ids") == F.size("w")) & (F.size("ids") == F.size("pos")) & (F.size("ids") == F.size("st"))
    filled = F.col("ids").isNotNull() & F.col("w").isNotNull() & F.col("pos").isNotNull() & F.col("st").isNotNull()
    n = F.size("pos")
    grows = F.forall(F.sequence(F.lit(2), n), lambda i: F.element_at("pos", i) > F.element_at("pos", i - F.lit(1)))
    rising = F.when(n < 2, True).otherwise(grows)
    steps = F.arrays_zip("ids", "w", "st")
    some = F.exists(steps, lambda s: significant(s["st"], s["ids"]))
    sound = F.forall(steps, lambda s: ~significant(s["st"], s["ids"]) | finite(s["w"].cast("double")))
    return F.when(~F.coalesce(filled & lengths & rising, F.lit(False)), "misaligned").when(~F.coalesce(some & sound, F.lit(False)), "nothing_left")


def sequences(walks: DataFrame) -> DataFrame:
    """Walks with ``error`` and ``frames``: one frame per step, steps that do not count having weight 0."""
    frame = F.transform(
        F.arrays_zip("ids", "w", "st"),
        lambda s: F.array(F.struct(s["ids"].alias("token"), F.when(significant(s["st"], s["ids"]), s["w"]).otherwise(F.lit(0).cast("float")).alias("weight"))),
    )
    w = walks.withColumn("error", walk_error())
    return w.withColumn("frames", F.when(F.col("error").isNull(), frame))


def regroup(frames: Column, size: int) -> Column:
    """Frames joined ``size`` at a time, tokens of a frame in order of id."""
    starts = F.sequence(F.lit(0), F.floor((F.size(frames) - 1) / size).cast("int"))
    return F.transform(starts, lambda i: F.array_sort(F.flatten(F.slice(frames, i * size + 1, F.lit(size)))))


def sequence_error(frames: Column) -> Column:
    """A sequence must have frames, each a token, each token a finite weight."""
    empty = F.coalesce(F.size(frames) < 1, F.lit(True)) | frames.isNull()
    holes = F.exists(frames, lambda f: F.size(f) < 1)
    odd = F.exists(frames, lambda f: F.exists(f, lambda t: ~finite(t["weight"].cast("double"))))
    return F.when(empty, "empty").when(holes, "empty_frame").when(odd, "bad_weight")


# --- signatures -----------------------------------------------------------------------------------------------------
def _limbs(x: int, n: int) -> list[int]:
    return [(x >> (16 * i)) & 0xFFFF for i in range(n)]


def token_bits(token: Column) -> list[Column]:
    """The four bit places of a token: two in each half of the signature.

    The products need 128 bits; only bits up to 69 of them are used, so they are formed from 16-bit limbs modulo 2^80 in
    BIGINT, which no step overflows for tokens under 2^32.
    """
    h1, carry = [], F.lit(0).cast("long")
    for c in _limbs(MULTIPLIER_1, 4):
        s = token * c + carry
        h1.append(s.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftright(s, 16)
    h1.append(carry)
    low = [*h1[:4], carry.bitwiseAND(F.lit(0xFFFF))]
    h2, carry = [], F.lit(0).cast("long")
    c2 = _limbs(MULTIPLIER_2, 5)
    for k in range(5):
        s = carry
        for i in range(k + 1):
            if c2[k - i]:
                s = s + low[i] * c2[k - i]
        h2.append(s.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftright(s, 16)
    six = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    return [six(h1[4]), six(h2[4]), six(h1[2]), six(h2[2])]


def token_masks(tokens: DataFrame, col: str) -> DataFrame:
    """``(token, m0, m1)``: both masks of every distinct token."""
    t = tokens.select(F.col(col).cast("long").alias("token")).distinct()
    a, b, c, d = token_bits(F.col("token"))
    t = t.select("token", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return t.selectExpr("token", "shiftleft(1L, a) | shiftleft(1L, b) AS m0", "shiftleft(1L, c) | shiftleft(1L, d) AS m1")


def signatures(seqs: DataFrame, key: str) -> DataFrame:
    """``(key, sig0, sig1)`` of sequences with frames: the union of the masks of their present tokens.

    Masks are formed once per distinct token and joined on it; ``bit_or`` combines before the shuffle.
    """
    tok = seqs.select(key, F.explode(F.flatten("frames")).alias("t")).filter(F.col("t.weight") > F.lit(PRESENT).cast("float"))
    tok = tok.filter(~F.isnan("t.weight")).select(key, F.col("t.token").alias("token")).distinct()
    sig = tok.join(token_masks(tok, "token"), "token").groupBy(key).agg(F.bit_or("m0").alias("sig0"), F.bit_or("m1").alias("sig1"))
    zero = F.lit(0).cast("long")
    return seqs.select(key).distinct().join(sig, key, "left").select(key, F.coalesce("sig0", zero).alias("sig0"), F.coalesce("sig1", zero).alias("sig1"))


def bits(a0: Column, a1: Column) -> Column:
    return F.bit_count(a0) + F.bit_count(a1)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common bits of two signatures, 0 to 128."""
    return bits(a0.bitwiseAND(b0), a1.bitwiseAND(b1))


def signature_jaccard(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    union = bits(a0.bitwiseOR(b0), a1.bitwiseOR(b1))
    return F.when(union > 0, overlap(a0, a1, b0, b1) / union).otherwise(F.lit(0.0))


def positional_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the present tokens of two frames (tokens once per frame); 1 if both frames are empty, 0 if nothing is
    present in either."""
    present = lambda f: F.array_distinct(F.transform(F.filter(f, lambda t: t["weight"] > F.lit(PRESENT).cast("float")), lambda t: t["token"]))
    pa, pb = present(a), present(b)
    union = F.size(F.array_union(pa, pb))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(pa, pb)) / union)


def positional_profile(a: Column, b: Column) -> Column:
    """Positional Jaccard at each place of the shorter sequence."""
    return F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), positional_jaccard)


# --- server payloads ------------------------------------------------------------------------------------------------
COLBERT = "multivector:array<array<double>>,n_tokens:int,dim:int,tokens:array<string>"
FLAT = "n:int,ids:array<bigint>,weights:array<float>,positions:array<bigint>,status:array<int>"
FRAMES = "n:int,frames:array<array<struct<token:bigint,weight:float>>>,status:array<int>"


def _first(payload: Column, shape: str) -> Column:
    return F.get(F.from_json(payload, f"results array<struct<{shape}>>")["results"], 0)


def parse_colbert(df: DataFrame, payload: str) -> DataFrame:
    """First result of a token-matrix payload: ``matrix``, ``tokens`` and ``error``.

    ``no_result`` without one, ``count_mismatch`` if ``n_tokens`` is not the number of rows. Missing tokens become empty
    placeholders.
    """
    r = df.withColumn("r", _first(F.col(payload), COLBERT))
    error = F.when(F.col("r").isNull() | F.col("r.multivector").isNull(), "no_result").when(F.col("r.n_tokens") != F.size("r.multivector"), "count_mismatch")
    tokens = F.coalesce(F.col("r.tokens"), F.array_repeat(F.lit(""), F.size("r.multivector")))
    return r.withColumn("error", error).withColumn("matrix", F.col("r.multivector")).withColumn("tokens", F.when(F.col("matrix").isNotNull(), tokens)).drop("r")


def parse_flat_walk(df: DataFrame, payload: str) -> DataFrame:
    """First result of a flat walk payload as ``ids, w, pos, st`` and ``error``; ``n`` must be all four lengths."""
    r = df.withColumn("r", _first(F.col(payload), FLAT))
    same = (F.size("r.ids") == F.col("r.n")) & (F.size("r.weights") == F.col("r.n")) & (F.size("r.positions") == F.col("r.n")) & (F.size("r.status") == F.col("r.n"))
    error = F.when(F.col("r").isNull(), "no_result").when(~F.coalesce(same, F.lit(False)), "count_mismatch")
    return r.select(
        *df.columns, error.alias("payload_error"), F.col("r.ids").alias("ids"), F.col("r.weights").alias("w"), F.col("r.positions").alias("pos"),
        F.col("r.status").cast("array<tinyint>").alias("st"),
    )


def parse_frames_walk(df: DataFrame, payload: str) -> DataFrame:
    """First result of a frames payload, flattened: a token's position and status are its frame's.

    A frame of several tokens repeats its position, which :func:`walk_error` then calls misaligned; that is intended.
    """
    r = df.withColumn("r", _first(F.col(payload), FRAMES))
    same = (F.size("r.frames") == F.col("r.n")) & (F.size("r.status") == F.col("r.n"))
    error = F.when(F.col("r").isNull(), "no_result").when(~F.coalesce(same, F.lit(False)), "count_mismatch")
    flat = F.flatten(
        F.transform("r.frames", lambda f, i: F.transform(f, lambda t: F.struct(t["token"].alias("id"), t["weight"].alias("w"), i.cast("long").alias("p"), F.get(F.col("r.status"), i).alias("s"))))
    )
    x = r.withColumn("x", flat)
    pick = lambda name, kind: F.transform("x", lambda t: t[name].cast(kind)).alias({"id": "ids", "p": "pos", "s": "st"}.get(name, name))
    return x.select(*df.columns, error.alias("payload_error"), pick("id", "bigint"), pick("w", "float"), pick("p", "bigint"), pick("s", "tinyint"))
