"""Problem 4: the most similar vectors of every vector, by an inverted file with product-quantised residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hodograph.llm.cells import dictionary, unit
from hodograph.runtime import BROADCAST_LIMIT, Scratch, TooLarge, read, unbroadcast, widen

#: Vectors of one block of a list; a longer list is cut into blocks.
BLOCK = 16384
#: Query rows times list rows that one group of the search works on before its queries are split too.
WORK = 1 << 26


@dataclass(frozen=True)
class Params:
    """Everything that trades recall for time.

    ``per_list``: vectors that a list has on average, until there are 4,096 lists or four times the root of the vectors;
    from there on lists and what they hold both grow with the root. ``train_per_list``: bound of
    the training sample, per list. ``sub``: product-quantiser parts. ``probes``: lists searched per vector. ``margin``:
    a vector is reranked if its estimated similarity is at least the wanted one less this. ``depth``: where no similarity
    is wanted, the ``depth * k + 32`` best estimates of a block are reranked at most.
    """

    per_list: int = 400
    train_per_list: int = 16
    sub: int = 16
    probes: int = 4
    margin: float = 0.2
    depth: int = 4
    iterations: int = 6
    seed: int = 11


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray  # lists x dim, unit rows
    books: np.ndarray  # sub x 256 x (dim / sub)

    def probe(self, x: np.ndarray, n: int) -> np.ndarray:
        n = min(n, len(self.coarse))
        s = x @ self.coarse.T
        return np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(x), 1))

    def ranked(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """The lists of these ranks, from 0 for the one a vector is in; fewer where there are no more."""
        return np.argsort(-(x @ self.coarse.T), axis=1, kind="stable")[:, first:last]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.coarse.T, axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.coarse[lists]
        sub, _, width = self.books.shape
        out = np.empty((len(x), sub), dtype=np.uint8)
        for m in range(sub):
            part, book = r[:, m * width : (m + 1) * width], self.books[m]
            out[:, m] = np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables (queries x sub x 256): inner products with every codeword."""
        sub, _, width = self.books.shape
        return np.einsum("qmw,mkw->qmk", q.reshape(len(q), sub, width), self.books, optimize=True)


def _kmeans(x: np.ndarray, k: int, iterations: int, rng, spherical: bool) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.vstack([c, np.zeros((k - len(c), x.shape[1]), dtype=x.dtype)])
    for _ in range(iterations):
        half = np.float32(0 if spherical else 0.5) * (c * c).sum(1)
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)])
        total, count = np.zeros_like(c), np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.flatnonzero(count))
        total[count > 0] = np.add.reduceat(x[order], starts, axis=0)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(np.float32)
        if spherical:
            c = unit(c).astype(np.float32)
    return c


def lists_for(n: int, p: Params) -> int:
    return max(1, 2 ** round(math.log2(max(min(n / p.per_list, max(4096.0, 4 * math.sqrt(n))), 1))))


def _coarse(x: np.ndarray, k: int, iterations: int, rng) -> np.ndarray:
    """``k`` list centroids; many of them in two levels, each cell of the first being divided by its share of the sample."""
    if k <= 1024:
        return _kmeans(x, k, iterations, rng, True)
    top = _kmeans(x, int(math.sqrt(k)), iterations, rng, True)
    own = np.concatenate([np.argmax(x[i : i + 4096] @ top.T, axis=1) for i in range(0, len(x), 4096)])
    cells = [x[own == i] for i in range(len(top))]
    return np.vstack([_kmeans(c, min(len(c), max(1, round(k * len(c) / len(x)))), iterations, rng, True) for c in cells if len(c)])


def train(sample: np.ndarray, n: int, p: Params) -> Index:
    """Fit lists and codebooks on a bounded sample of unit vectors; ``n`` is the number of vectors to index."""
    rng = np.random.default_rng(p.seed)
    dim = sample.shape[1]
    coarse = _coarse(sample, lists_for(n, p), p.iterations, rng)
    sub = p.sub if dim % p.sub == 0 else 1
    res = sample[:65536] - coarse[np.concatenate([np.argmax(sample[i : i + 4096] @ coarse.T, axis=1) for i in range(0, min(len(sample), 65536), 4096)])]
    width = dim // sub
    books = np.stack([_kmeans(res[:, m * width : (m + 1) * width], 256, p.iterations, rng, False) for m in range(sub)])
    return Index(coarse, books.astype(np.float32))


# --- Arrow steps ----------------------------------------------------------------------------------------------------
def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _unnest(dim: int, stride: int):
    """(row_id, k, multivector) to (key, k, vec): one row per vector of ``dim`` finite numbers that are not all zero."""

    def unnest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                outer = part.column("multivector")
                n_vec = np.diff(np.asarray(outer.offsets, dtype=np.int64))
                n_vec[~np.asarray(outer.is_valid())] = 0
                inner = outer.flatten()
                sizes = np.diff(np.asarray(inner.offsets, dtype=np.int64))
                flat = np.asarray(inner.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
                sizes[~np.asarray(inner.is_valid())] = 0
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                row = np.repeat(np.arange(part.num_rows), n_vec)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n_vec) - n_vec, n_vec)
                full = np.flatnonzero(sizes == dim)
                x = flat[starts[full][:, None] + np.arange(dim)] if len(full) else np.zeros((0, dim))
                with np.errstate(over="ignore"):
                    ok = np.isfinite(x).all(axis=1)
                    x = x[ok]
                    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) if len(x) else x
                    some = np.abs(x).max(axis=1) > 0 if len(x) else np.zeros(0, dtype=bool)
                full = full[ok][some]
                ids = np.asarray(part.column("row_id"), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[full]] * stride + nth[full]), part.column("k").take(pa.array(row[full])), _rows(unit(x[some]).astype(np.float32))],
                    ["key", "k", "vec"],
                )

    return unnest


ROUTED = ["list", "side", "id", "k", "codes", "vec"]
_ROUTED = "list int, side int, id long, k long, codes binary, vec binary"


def _router(bc, dim: int, probes: int, first: int = 0):
    """(id, vec) to index rows (side 0, with codes) and query rows (side 1, one per probed list).

    With a column ``floor`` the lists of the ranks from ``first`` up to ``probes`` are probed; with ``first`` above 0 the
    rows are queries only."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = bc.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                x = _matrix(part.column("vec"), dim)
                floor = "floor" in part.schema.names
                probe = index.ranked(x, first, probes) if floor else index.probe(x, probes)
                n, p = probe.shape
                if first:
                    take = pa.array(np.repeat(np.arange(n), p))
                    codes, side = pa.nulls(n * p, pa.binary()), pa.array(np.ones(n * p, dtype=np.int32))
                    cols = [pa.array(probe.reshape(-1).astype(np.int32)), side, part.column("id").take(take), part.column("k").take(take), codes, part.column("vec").take(take)]
                    yield pa.RecordBatch.from_arrays([*cols, part.column("floor").take(take)], [*ROUTED, "floor"])
                    continue
                own = probe[:, 0] if floor else index.nearest(x)
                take = pa.array(np.concatenate([np.arange(n), np.repeat(np.arange(n), p)]))
                codes = pa.array([r.tobytes() for r in index.encode(x, own)] + [None] * (n * p), pa.binary())
                side = np.repeat(np.array([0, 1], dtype=np.int32), [n, n * p])
                cols = [pa.array(np.concatenate([own, probe.reshape(-1)]).astype(np.int32)), pa.array(side), part.column("id").take(take), part.column("k").take(take), codes, part.column("vec").take(take)]
                yield pa.RecordBatch.from_arrays([*cols, part.column("floor").take(take)] if floor else cols, [*ROUTED, "floor"] if floor else ROUTED)

    return route


def _searcher(bc, dim: int, min_cos: float | None, p: Params):
    """Groups of rows sorted by (list, blocks, side): an index block, then the queries that meet it.

    Without ``min_cos`` each query has its own in the column ``floor``, where null asks for the best of the block."""

    def scan(index: Index, lst: int, ids, codes, vecs, qid, qk, q, floor) -> pa.RecordBatch | None:
        t = index.tables(q)
        est = np.repeat((q @ index.coarse[lst])[:, None], len(ids), axis=1)
        for m in range(t.shape[1]):
            est += np.take(t[:, m, :], codes[:, m], axis=1)
        if min_cos is None:
            n = np.minimum(p.depth * qk + 32, len(ids))
            cut = np.sort(est, axis=1)[np.arange(len(q)), len(ids) - n]
            i, j = np.nonzero(est >= np.maximum(cut, floor - p.margin)[:, None])
        else:
            i, j = np.nonzero(est >= min_cos - p.margin)
        if not len(i):
            return None
        cos = np.einsum("nd,nd->n", q[i].astype(np.float64), vecs[j].astype(np.float64))
        ok = (cos >= (floor[i] if min_cos is None else min_cos) - 1e-6) & (qid[i] != ids[j])
        i, j, cos = i[ok], j[ok], np.round(cos[ok], 6)
        # Of each query the best k of this block, least id first among equals.
        order = np.lexsort((ids[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        first = np.searchsorted(i, i)
        ok = np.arange(len(i)) - first < qk[i]
        return pa.RecordBatch.from_arrays(
            [pa.array(qid[i[ok]]), pa.array(qk[i[ok]]), pa.array(ids[j[ok]]), pa.array(cos[ok])], ["id", "k", "other", "cos"]
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = bc.value
        group, ids, codes, vecs = None, [], [], []
        block = None
        for batch in batches:
            g = np.asarray(batch.column("grp"), dtype=np.int64)
            side = np.asarray(batch.column("side"))
            edge = np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip(np.append(0, edge), np.append(edge, len(g)), strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if g[a] != group:
                    group, ids, codes, vecs, block = g[a], [], [], [], None
                pid = np.asarray(part.column("id"), dtype=np.int64)
                if side[a] == 0:
                    ids.append(pid)
                    codes.append(np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint8).reshape(len(pid), -1))
                    vecs.append(_matrix(part.column("vec"), dim))
                    continue
                if not ids:
                    continue
                if block is None:
                    block = np.concatenate(ids), np.concatenate(codes).astype(np.intp), np.concatenate(vecs)
                lst = int(part.column("list")[0].as_py())
                qk, q = np.asarray(part.column("k"), dtype=np.int64), _matrix(part.column("vec"), dim)
                floor = np.full(len(pid), -2.0) if min_cos is not None else part.column("floor").fill_null(-2.0).to_numpy(zero_copy_only=False)
                step = min(256, max(1, (1 << 20) // len(block[0])))  # bounds the estimates and the tables
                for s in range(0, len(pid), step):
                    found = scan(index, lst, *block, pid[s : s + step], qk[s : s + step], q[s : s + step], floor[s : s + step])
                    if found is not None and found.num_rows:
                        yield found

    return search


# --- the operator ---------------------------------------------------------------------------------------------------
def build_index(vectors: DataFrame, dim: int, p: Params) -> Index:
    """Fit on ``train_per_list`` vectors a list (4,096 at least), those of the least hashed ids, so evenly over all."""
    n = vectors.count()
    lists = lists_for(n, p)
    if (2 * lists + 256) * dim * 4 > BROADCAST_LIMIT:  # two levels may come out at somewhat more lists
        raise TooLarge(f"index of {lists} lists of {dim} dimensions")
    want = max(4096, lists * p.train_per_list)
    share = min(1.0, 1.2 * want / max(n, 1))
    hashed = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = hashed.orderBy(F.xxhash64("id"), "id").limit(want).select("vec").toArrow().column("vec")
    sample = np.frombuffer(b"".join(c for ch in rows.chunks for c in ch.to_pylist()), dtype=np.float32).reshape(-1, dim)
    return train(sample, n, p) if len(sample) else Index(np.zeros((1, dim), np.float32), np.zeros((1, 256, dim), np.float32))


def _scan(routed: DataFrame, bc, dim: int, min_cos: float | None, p: Params, block: int, work: int) -> DataFrame:
    """``(id, k, other, cos)``: what the query rows of ``routed`` find in the index rows of their lists."""
    spark = routed.sparkSession
    sizes = routed.groupBy("list").agg(F.sum(F.expr("int(side = 0)")).alias("ni"), F.sum(F.expr("int(side = 1)")).alias("nq"))
    sizes = sizes.filter("ni > 0 AND nq > 0").withColumn("bi", F.ceil(F.col("ni") / block).cast("int"))
    sizes = sizes.withColumn("bq", F.ceil(F.col("nq") * F.col("ni") / F.col("bi") / work).cast("int")).select("list", "bi", "bq")
    # One row per list, whose centroids were broadcast before.
    split = routed.join(F.broadcast(sizes), "list")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("bi")).otherwise(F.col("bq"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("bq")).otherwise(F.col("bi")) - 1))
    split = split.withColumn("mine", mine).withColumn("other", other)
    i, q = F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    split = split.withColumn("grp", F.xxhash64("list", i, q)).select("grp", "side", "list", "id", "k", "codes", "vec", *(["floor"] if min_cos is None else []))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
    return split.repartition(tasks, "grp").sortWithinPartitions("grp", "side").mapInArrow(
        _searcher(bc, dim, min_cos, p), "id long, k long, other long, cos double"
    )


def _whole_top(one: DataFrame, bc, dim: int, scratch: Scratch, p: Params, block: int, work: int) -> DataFrame:
    """What holds the ``k`` best of every vector, whatever their similarity.

    A vector first searches its own list; the ``k``-th best there is the least that the other lists have to offer, so
    they yield few rows more than ``k``. Who has not found ``k`` by then searches all lists that are left.
    """
    lists = len(bc.value.coarse)
    w = Window.partitionBy("id").orderBy(F.col("cos").desc(), F.col("other"))
    ask = widen(one.select("id", "k", "vec"), "id")
    routed = ask.withColumn("floor", F.lit(None).cast("double")).mapInArrow(_router(bc, dim, 1), _ROUTED + ", floor double")
    routed = scratch.cut(routed, "routed")
    index = routed.filter("side = 0")
    found = scratch.cut(_scan(routed.filter("side = 0 OR k > 0"), bc, dim, None, p, block, work), "found")
    near = max(1, min(p.probes, lists))
    for first, last, short in ((1, near, False), (near, lists, True)):
        if first >= last:
            continue
        # The k-th best so far, if there are as many.
        kth = found.withColumn("r", F.row_number().over(w)).filter("r = k").select("id", F.col("cos").alias("floor"))
        left = one.filter("k > 0").select("id", "k", "vec").join(unbroadcast(kth), "id", "left")
        if short and (left := scratch.cut(left.filter("floor IS NULL"), "short")).isEmpty():
            break
        more = left.mapInArrow(_router(bc, dim, last, first), _ROUTED + ", floor double")
        found = found.union(scratch.cut(_scan(index.union(more), bc, dim, None, p, block, work), "found"))
    return found


def nearest_vectors(vectors: DataFrame, dim: int, min_cos: float | None, scratch: Scratch, p: Params = Params(), block: int = BLOCK, work: int = WORK) -> DataFrame:
    """``(key, other, cos)``: for every vector those of its ``k`` most similar others that have at least ``min_cos``, all ``k``
    if that is None.

    ``vectors(key, k, vec)``: distinct keys, unit vectors as float32 bytes; a null ``k`` or ``k < 1`` asks for nothing,
    but such a vector can be found. Equal similarity (to 6 digits) goes by the lesser key.

    Equal vectors are indexed once; a found vector stands for its least keys, as many as ``k`` can use. Every vector is
    indexed, in the list of its nearest coarse centroid, and searches ``probes`` lists: asymmetric distance tables
    estimate all of a list, what comes within ``margin`` of ``min_cos`` is reranked by the exact cosine. Lists are cut
    into blocks and, where queries times block exceed ``work``, queries are split, so a list that holds a third of all
    vectors is many groups of bounded size. The index (see :class:`Params`) is bounded and the only thing broadcast.
    """
    k_max = vectors.agg(F.max("k")).first()[0] or 0
    keys = vectors.withColumn("h", F.xxhash64("vec")).select("h", "vec", "key", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    one = keys.groupBy("h", "vec").agg(F.min("key").alias("id"), F.max("k").alias("k"), F.count(F.lit(1)).alias("n"))
    one = scratch.cut(one, "distinct")
    index = build_index(one, dim, p)
    bc = vectors.sparkSession.sparkContext.broadcast(index)
    if min_cos is None:
        top = _whole_top(one, bc, dim, scratch, p, block, work)
    else:
        routed = widen(one.select("id", "k", "vec"), "id").mapInArrow(_router(bc, dim, p.probes), _ROUTED)
        routed = scratch.cut(routed.filter("side = 0 OR k > 0"), "routed")
        top = scratch.cut(_scan(routed, bc, dim, min_cos, p, block, work), "found")
        scratch.drop(routed)
    w = Window.partitionBy("id").orderBy(F.col("cos").desc(), F.col("other"))
    top = top.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k_max).filter("r <= k").select("id", "other", "cos")
    # From distinct vectors to keys. A copy has cosine 1 with its copies; only the least k_max + 1 keys can matter.
    some = one.filter("n > 1").select("h", "vec", "id")
    rank = Window.partitionBy("id").orderBy("key")
    copies = keys.join(unbroadcast(some), ["h", "vec"]).select("id", "key", "k")
    least = copies.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= F.lit(k_max + 1)).select("id", "key")
    asks = copies.union(one.filter("n = 1").select("id", F.col("id").alias("key"), "k")).filter("k > 0")
    far = top.join(unbroadcast(least.select(F.col("id").alias("other"), F.col("key").alias("o"))), "other", "left")
    far = far.select("id", F.coalesce("o", "other").alias("other"), "cos")
    near = least.select("id", F.col("key").alias("other"), F.lit(1.0).alias("cos"))
    full = asks.join(unbroadcast(far.union(near)), "id").filter("key <> other").select("key", "k", "other", "cos")
    v = Window.partitionBy("key").orderBy(F.col("cos").desc(), F.col("other"))
    best = full.withColumn("r", F.row_number().over(v)).filter(F.col("r") <= k_max).filter("r <= k")
    return (best if min_cos is None else best.filter(F.col("cos") >= min_cos)).select("key", "other", "cos")


def collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """All token vectors and cell centroids as ``(key, k, vec)``.

    Key: ``result_id * 64 + i``, or ``-1 - cell``. ``k`` is the graph's, for a centroid the largest of all. A result
    given again counts once. Vectors that are null, not as long as a centroid, not finite or all zero do not count.
    """
    c = dictionary(spark, sf_dir)
    cfg = read(spark, sf_dir, "graph_config").select("graph_id", "k").dropna()
    k_max = cfg.agg(F.max("k")).first()[0] or 0
    rows = read(spark, sf_dir, "colbert_results").select("result_id", "graph_id", "multivector").filter("result_id IS NOT NULL AND multivector IS NOT NULL")
    once = rows.groupBy("result_id").agg(F.max(F.struct(F.col("graph_id"), F.col("multivector"))).alias("r"))
    once = once.select(F.col("result_id").alias("row_id"), "r.graph_id", "r.multivector").join(cfg, "graph_id", "left")
    dim = c.shape[1]
    vectors = once.select("row_id", "k", "multivector").mapInArrow(_unnest(dim, 64), "key long, k int, vec binary")
    ok = np.isfinite(c).all(axis=1) & (np.abs(c).max(axis=1) > 0) if len(c) else np.zeros(0, dtype=bool)
    cells = [(-1 - int(i), int(k_max), bytearray(unit(c[i]).astype(np.float32).tobytes())) for i in np.flatnonzero(ok)]
    return vectors.union(spark.createDataFrame(cells, "key long, k int, vec binary")), dim


#: For whole lists of neighbours, most of which are far: twelve lists have 0.9 of them and more.
WHOLE = Params(per_list=800, probes=12)


def _nearest(spark: SparkSession, sf_dir: str, min_cos: float | None, p: Params = Params()) -> DataFrame:
    vectors, dim = collection(spark, sf_dir)
    scratch = Scratch(spark, "ivfpq")
    return nearest_vectors(scratch.cut(vectors, "vectors"), dim, min_cos, scratch, p)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases have a cosine of at least 0.90, so nothing below is looked for."""
    n = _nearest(spark, sf_dir, 0.90)
    return n.select(F.least("key", "other").alias("vec_a"), F.greatest("key", "other").alias("vec_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour lists themselves, whole and with ranks."""
    w = Window.partitionBy("key").orderBy(F.col("cos").desc(), F.col("other"))
    return _nearest(spark, sf_dir, None, WHOLE).withColumn("rank", F.row_number().over(w)).withColumn("cos", F.round("cos", 4))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}

_VECS = """
WITH res AS (SELECT result_id, any_value(graph_id) AS graph_id, any_value(multivector) AS mv FROM colbert_results
             WHERE multivector IS NOT NULL AND result_id IS NOT NULL GROUP BY result_id),
tok AS (SELECT result_id * 64 + i AS key, k, v FROM (
          SELECT result_id, k, unnest(mv) AS v, generate_subscripts(mv, 1) - 1 AS i FROM res LEFT JOIN graph_config USING (graph_id))
        WHERE len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
cen AS (SELECT -1 - (generate_subscripts(centroidi, 1) - 1) AS key, (SELECT max(k) FROM graph_config) AS k,
               unnest(centroidi)::DOUBLE[] AS v FROM cell_dictionary),
vec AS (SELECT * FROM tok UNION ALL SELECT * FROM cen),
near AS (SELECT a.key, a.k, b.key AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cos
         FROM vec a JOIN vec b ON a.key <> b.key AND list_cosine_similarity(a.v, b.v) >= 0.9),
top AS (SELECT key, other, cos, row_number() OVER (PARTITION BY key ORDER BY cos DESC, other) AS rank FROM near
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY cos DESC, other) <= k)
"""
SQL = {
    "p4_found": _VECS + "SELECT DISTINCT least(key, other) AS vec_a, greatest(key, other) AS vec_b FROM top",
}
