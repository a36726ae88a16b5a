"""Problem 3: all pairs of set-valued records whose sets overlap strongly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hodograph.llm.copies import expand_pairs
from hodograph.runtime import Scratch, read, unbroadcast, widen

#: Rows that one band bucket may hold before its rows must also share a rare token to meet.
HOT_BUCKET = 1000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: What is known of a set in a bucket: its size, and a bitmap of its items.
SIGNED = ["rep", "band", "key", "n", "b0", "b1"]


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` hashes after which a pair at the threshold is missed with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def band_keys(flat: np.ndarray, offsets: np.ndarray, rows: int, bands: int, seed: int = 7) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets given as one flat array with offsets."""
    with np.errstate(over="ignore"):
        base = _mix(flat.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed))
        out = np.zeros((len(offsets) - 1, bands), dtype=np.uint64)
        for b in range(bands):
            for r in range(rows):
                salt = np.uint64((b * rows + r + 1) * 0xD1342543DE82EF95 % (1 << 64))
                least = np.minimum.reduceat(_mix(base ^ salt), offsets[:-1])
                out[:, b] = _mix(out[:, b] * np.uint64(31) + least)
    return out.view(np.int64)


def bitmaps(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two words (sets x 2) with one bit of 128 set for each item."""
    with np.errstate(over="ignore"):
        place = _mix(flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    bit = np.uint64(1) << (place & np.uint64(63))
    halves = [np.where(place >> np.uint64(6) == h, bit, np.uint64(0)) for h in (0, 1)]
    return np.stack([np.bitwise_or.reduceat(x, offsets[:-1]) for x in halves], axis=1).view(np.int64)


def _signer(rows: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                sets = part.column("set")
                offsets = np.asarray(sets.offsets, dtype=np.int64)
                flat, offsets = np.asarray(sets.flatten()), offsets - offsets[0]
                keys, maps = band_keys(flat, offsets, rows, bands), bitmaps(flat, offsets)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep").take(pa.array(np.repeat(np.arange(n), bands))),
                        pa.array(np.tile(np.arange(bands, dtype=np.int32), n)),
                        pa.array(keys.reshape(-1)),
                        pa.array(np.repeat(np.diff(offsets).astype(np.int32), bands)),
                        pa.array(np.repeat(maps[:, 0], bands)),
                        pa.array(np.repeat(maps[:, 1], bands)),
                    ],
                    SIGNED,
                )

    return sign


def _candidates(signed: DataFrame, sets: DataFrame, threshold: float, hot_bucket: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs that share a bucket and can reach the threshold, as a written table."""
    counts = signed.groupBy("band", "key").count().filter("count > 1")
    shared = scratch.cut(signed.join(unbroadcast(counts), ["band", "key"]), "shared")
    cold = shared.filter(F.col("count") <= hot_bucket).select(*SIGNED, F.lit(0).cast("long").alias("token"))
    hot = shared.filter(F.col("count") > hot_bucket).select(*SIGNED)
    if not hot.isEmpty():
        # Two sets at the threshold share one of their rarest tokens (prefix filter): an exact way to split a hot bucket.
        near = sets.join(unbroadcast(hot.select("rep").distinct()), "rep", "left_semi")
        freq = near.select(F.explode("set").alias("token")).groupBy("token").count()
        ranked = near.select("rep", F.explode("set").alias("token")).join(unbroadcast(freq), "token")
        order = F.array_sort(F.collect_list(F.struct("count", "token")))
        keep = F.size("o") - F.ceil(F.size("o") * threshold - 1e-9) + 1
        rare = ranked.groupBy("rep").agg(order.alias("o")).select("rep", F.explode(F.slice("o", 1, keep.cast("int"))).alias("t"))
        cold = cold.union(hot.join(unbroadcast(rare.select("rep", F.col("t.token").alias("token"))), "rep").select(*SIGNED, "token"))
    left = cold.withColumnsRenamed({"rep": "a", "n": "na", "b0": "a0", "b1": "a1"})
    right = cold.withColumnRenamed("rep", "b")
    met = left.join(unbroadcast(right), ["band", "key", "token"]).filter("a < b")
    # Sets differ in at least as many items as their bitmaps in bits, which bounds what they share; most chance meetings
    # end here, before they are made distinct and before any set is fetched.
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    most = F.least((F.col("na") + F.col("n") - apart) / 2, F.col("na").cast("double"), F.col("n").cast("double"))
    out = scratch.cut(met.filter(most >= threshold * (F.col("na") + F.col("n") - most) - 1e-9).select("a", "b").distinct(), "candidates")
    scratch.drop(shared)
    return out


def similar_sets(
    df: DataFrame, key: str, items: str, threshold: float = 0.6, rows: int = 5, miss: float = 5e-4,
    hot_bucket: int = HOT_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of equal sets, and the classes.

    Returns ``(pairs, members)``: ``pairs(a, b, jaccard)`` has class representatives with ``a < b`` and a Jaccard
    similarity of at least ``threshold`` (the limit included); ``members(id, rep)`` has every record with a non-empty
    set, where ``rep`` is the least id with exactly that set.

    * Null keys, null or empty sets and null elements do not take part; repeated elements count once; a key given
      again counts once (the greatest set, if they differ).
    * For records of two tables, union them with distinct keys.
    * Sets are of whole numbers. Minwise signatures are cut into bands of ``rows`` hashes, so many that a pair at the threshold is missed with
      probability ``miss`` at most; candidates of any band are made distinct and verified exactly, so no false pair is
      returned. Copies are collapsed before, so a hot set is one row. In a bucket of more than ``hot_bucket`` sets only
      sets that share a token of their prefix meet, which loses no pair.
    * Nothing is broadcast: classes, candidates and members grow with the data, so all joins on them are by sort-merge.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "setjoin")
    clean = F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())))
    one = df.select(F.col(key).alias("id"), clean.cast("array<bigint>").alias("set")).filter("id IS NOT NULL AND size(set) > 0")
    one = one.groupBy("id").agg(F.max("set").alias("set"))
    one = scratch.cut(one.withColumn("h", F.xxhash64("set")).withColumn("h2", F.hash("set")), "sets")
    sets = one.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.first("set").alias("set"), F.count(F.lit(1)).alias("n"))
    sets = scratch.cut(sets, "classes")
    copied = sets.filter("n > 1").select("h", "h2", "rep")
    members = one.join(unbroadcast(copied), ["h", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    bands = bands_for(threshold, rows, miss)
    signed = widen(sets.select("rep", "set"), "rep").mapInArrow(_signer(rows, bands), "rep string, band int, key long, n int, b0 long, b1 long")
    found = _candidates(signed, sets.select("rep", "set"), threshold, hot_bucket, scratch)
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = found.join(unbroadcast(a), "a").join(unbroadcast(b), "b").withColumn("inter", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("inter")
    pairs = both.filter(F.col("inter") >= threshold * union - 1e-9).select("a", "b", (F.col("inter") / union).alias("jaccard"))
    return pairs, members


def counting_ids() -> Column:
    """Distinct ids of a walk's counting steps; null for a null array, arrays of unequal length or no such step.

    Weights are single precision and are compared so: a stored 0.002 does not count.
    """
    whole = (F.size("ids") == F.size("w")) & (F.size("ids") == F.size("pos")) & (F.size("ids") == F.size("st"))
    steps = F.arrays_zip("ids", "w", "st")
    ok = F.filter(steps, lambda s: (s["st"] == 0) & (s["ids"] >= 4) & ~F.isnan(s["w"]) & (s["w"] > F.lit(0.002).cast("float")))
    ids = F.array_distinct(F.transform(ok, lambda s: s["ids"]))
    filled = F.col("ids").isNotNull() & F.col("w").isNotNull() & F.col("pos").isNotNull() & F.col("st").isNotNull()
    return F.when(filled & whole & (F.size(ids) > 0), ids)


def _walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    walks = read(spark, sf_dir, "raw_walks").select("sequence_id", counting_ids().alias("set"))
    return similar_sets(walks, "sequence_id", "set")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = _walks(spark, sf_dir)
    return expand_pairs(pairs.select("a", "b"), members).select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each walk with a set: its class of equal sets and the number of other classes similar to that."""
    pairs, members = _walks(spark, sf_dir)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(unbroadcast(ends), "rep", "left")
    return out.select(F.col("id").alias("sequence_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}

_SETS = """
WITH steps AS (
  SELECT DISTINCT sequence_id, unnest(ids) AS id, unnest(w) AS w, unnest(st) AS st FROM raw_walks
  WHERE len(ids) = len(w) AND len(ids) = len(pos) AND len(ids) = len(st)),
tok AS (SELECT DISTINCT sequence_id AS s, id FROM steps WHERE st = 0 AND id >= 4 AND w > 0.002::FLOAT AND NOT isnan(w)),
n AS (SELECT s, count(*) AS n FROM tok GROUP BY s),
hit AS (SELECT x.s AS a, y.s AS b, count(*) AS c FROM tok x JOIN tok y ON x.id = y.id AND x.s < y.s GROUP BY x.s, y.s),
pair AS (SELECT a, b, c, na.n AS na, nb.n AS nb FROM hit JOIN n na ON na.s = a JOIN n nb ON nb.s = b
         WHERE c >= 0.6 * (na.n + nb.n - c))
"""
SQL = {
    "p3_found": _SETS + "SELECT a AS seq_a, b AS seq_b FROM pair",
    "p3_classes": _SETS + """,
same AS (SELECT b AS s, min(a) AS rep FROM pair WHERE c = na AND c = nb GROUP BY b),
cls AS (SELECT n.s, coalesce(rep, n.s) AS rep FROM n LEFT JOIN same USING (s)),
links AS (SELECT x.rep, count(DISTINCT y.rep) AS n FROM
            (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair) p JOIN cls x ON x.s = p.a JOIN cls y ON y.s = p.b
          WHERE x.rep <> y.rep GROUP BY x.rep)
SELECT s AS sequence_id, cls.rep AS class_id, coalesce(links.n, 0) AS n_links FROM cls LEFT JOIN links ON links.rep = cls.rep""",
}
