"""Proximity graph: construction from facts, access and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hodograph.functions.numeric import finite, known
from hodograph.functions.scalar import LAMBDA, combine, distance_to_ideal, normalize
from hodograph.operators.skyline import blocks, local_band
from hodograph.plans.config import GraphConfig
from hodograph.runtime import Scratch, widen

CHANNELS = ["colbert", "sparse", "relational"]
#: Links that a task combines at once, and scores that it holds at once.
LOT, CELLS = 1 << 22, 1 << 20
#: Scores that a batch may work out otherwise than a column are equal up to this.
CLOSE = 1e-9


# --- construction ---------------------------------------------------------------------------------------------------
def first_by_id(facts: DataFrame, order: str) -> DataFrame:
    """One row per id: the first in ``order``. Null ids are left out."""
    return facts.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(order, *CHANNELS)).alias("f")).select("id", *(f"f.{c}" for c in CHANNELS))


def _signs(columns) -> Column:
    """Which channels are negative, as bits."""
    return sum((F.when(F.col(c) < 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0)).cast("int")


def partners(facts: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(signs, id, channels)`` of facts that can be among the ``k`` best partners of any fact with these signs; their number.

    A pair's score, and every tie rule after it, can only gain when the product of a channel grows, so when the partner's
    channel grows or, for a fact whose own is negative, falls. So a fact that ``k + 1`` others with lesser ids match or
    exceed in all channels, each in the direction of its sign, is never needed (one more than ``k``, since the fact itself
    is no partner). What is left grows with a power of the logarithm of the rows and turns the comparison of all pairs into
    facts times partners. There are eight combinations of signs at most.
    """
    typed = scratch.cut(facts.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in CHANNELS)), "facts")
    out, total = None, 0
    for signs in sorted(r[0] for r in typed.select(_signs(CHANNELS)).distinct().collect()):  # eight at most
        way = [1 if signs >> i & 1 else -1 for i in range(len(CHANNELS))]
        some, n = local_band(typed, [*CHANNELS, "id"], [*way, 1], k + 1, False, scratch)
        some = some.select(F.lit(signs).alias("signs"), "id", *CHANNELS)
        out, total = some if out is None else out.union(some), total + n
    return (typed.select(F.lit(0).alias("signs"), "id", *CHANNELS), 0) if out is None else (out, total)


def _chosen(held: list[tuple[int, np.ndarray, np.ndarray]], k: int, weights: tuple[float, float, float]):
    """Each fact of a batch with its ``k`` best of the ``held`` partners ``(signs, ids, channels)`` and all that come within
    :data:`CLOSE` of the last of them, so that whoever ranks them by exact scores and tie rules misses none."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            signs = whole.column("signs").to_numpy(zero_copy_only=False)
            for s, ids, other in held:
                mine = whole.filter(pa.array(signs == s))
                if not len(ids) or not mine.num_rows:
                    continue
                src = mine.column("src").to_numpy(zero_copy_only=False)
                x = np.column_stack([mine.column(c).to_numpy(zero_copy_only=False) for c in CHANNELS])
                lot = max(1, CELLS // len(ids))
                for at in range(0, len(src), lot):
                    with np.errstate(all="ignore"):
                        dense, sparse, rest = (x[at : at + lot, c, None] * other[None, :, c] for c in range(3))
                        score = weights[0] * np.clip((dense + 1) / 2, 0, 1) + weights[1] * np.clip(1 - np.exp(-LAMBDA * sparse), 0, 1) + weights[2] * np.clip((rest + 1) / 2, 0, 1)
                    score[np.isnan(score) | (src[at : at + lot, None] == ids[None, :])] = -np.inf
                    last = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(score), -np.inf)
                    i, j = np.nonzero((score >= last[:, None] - CLOSE) & (score > -np.inf))
                    rows = mine.take(pa.array(i + at))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("src"), pa.array(ids[j]), *(rows.column(c) for c in CHANNELS), *(pa.array(other[j, c]) for c in range(3))],
                        ["src", "dst", *CHANNELS, *("o_" + c for c in CHANNELS)],
                    )

    return choose


def scored_pairs(facts: DataFrame, cfg: GraphConfig) -> DataFrame:
    """``(src, dst, score, distance, total, colbert, sparse, relational)``: each fact with the partners that can be among its
    ``k`` best.

    Partners are handed to every task in blocks of bounded bytes; facts are spread before they meet them. A task keeps of
    each fact what matches its ``k``-th best score in a block, so pairs with all partners are neither exchanged nor sorted.
    """
    sound = facts.filter(known(F.col("colbert")) & known(F.col("sparse")) & known(F.col("relational")))
    k, spark, kind = max(cfg.k, 1), facts.sparkSession, dict(facts.dtypes)["id"]
    other, n = partners(sound, k, Scratch(spark, "partners"))
    signed = sound.select(F.col("id").cast("long").alias("src"), *(F.col(c).cast("double").alias(c) for c in CHANNELS), _signs(CHANNELS).alias("signs"))
    signed, both = widen(signed, "src"), None
    out = "src long, dst long, " + ", ".join(f"{p}{c} double" for p in ("", "o_") for c in CHANNELS)
    for part in blocks(other, n, 40):
        t = part.toArrow()
        sign, ids = (t.column(c).to_numpy() for c in ("signs", "id"))
        x = np.column_stack([t.column(c).to_numpy() for c in CHANNELS])
        held = [(int(s), ids[sign == s], x[sign == s]) for s in np.unique(sign)]
        shared = spark.sparkContext.broadcast(held)
        met = signed.mapInArrow(lambda batches, shared=shared: _chosen(shared.value, k, cfg.weights)(batches), out)
        both = met if both is None else both.union(met)
    both = both.select(F.col("src").cast(kind).alias("src"), "dst", *((F.col(c) * F.col("o_" + c)).alias(c) for c in CHANNELS))
    axes = normalize(F.col("colbert"), F.col("sparse"), F.col("relational"))
    return both.select(
        "*", combine(axes, cfg.weights).alias("score"), distance_to_ideal(axes, cfg.weights).alias("distance"), (axes[0] + axes[1] + axes[2]).alias("total")
    )


def nearest(facts: DataFrame, cfg: GraphConfig) -> DataFrame:
    """The ``k`` best partners of each fact; by score, then distance to the ideal, then sum of axes, then id."""
    w = Window.partitionBy("src").orderBy(F.col("score").desc(), F.col("distance"), F.col("total").desc(), F.col("dst"))
    ranked = scored_pairs(facts, cfg).filter(known(F.col("score"))).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= max(cfg.k, 1))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges once per pair with ``src < dst``, the best-scored of its copies; loops and null ends are left out."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    best = F.max(F.struct("score", *CHANNELS)).alias("e")
    e = edges.filter("src <> dst").groupBy(lo.alias("src"), hi.alias("dst")).agg(best)
    return e.select("src", "dst", "e.*")


def build_graph(facts: DataFrame, cfg: GraphConfig) -> DataFrame:
    """Edges of the proximity graph of ``facts(id, colbert, sparse, relational)``.

    Of each fact's ``k`` best partners those stay that reach both the floor and the cutoff percentile of their scores.
    """
    near = nearest(facts, cfg)
    floor, cut = min(max(cfg.floor, 0.0), 1.0), min(max(cfg.cutoff, 0.0), 1.0)
    bar = near.groupBy("src").agg(F.greatest(F.percentile("score", F.lit(cut)), F.lit(floor)).alias("bar"))
    return undirected(near.join(bar, "src").filter("score >= bar").select("src", "dst", "score", *CHANNELS))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Stored edges as an undirected graph; rows with an unknown or infinite score are left out."""
    return undirected(edges.filter(finite(F.col("score"))))


# --- access ---------------------------------------------------------------------------------------------------------
def adjacency(edges: DataFrame) -> DataFrame:
    """``(node, other)`` in both directions."""
    e = edges.select("src", "dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select(F.col("dst").alias("node"), F.col("src").alias("other")))


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the edge between them, whatever the order; a null score where there is none."""
    keyed = pairs.withColumn("src", F.least("a", "b")).withColumn("dst", F.greatest("a", "b"))
    return keyed.join(edges.select("src", "dst", "score"), ["src", "dst"], "left").select("a", "b", "score")


def edges_of(edges: DataFrame, node: Column) -> DataFrame:
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


# --- metrics --------------------------------------------------------------------------------------------------------
def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, degree)`` of every node, 0 included."""
    d = adjacency(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").join(adjacency(edges), "node", "left_anti")


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c)``: each triangle once. Edges point from the lesser to the greater degree, so a hub opens few wedges."""
    d = adjacency(edges).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("src", "dst").join(d.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").filter("x < y")
    closed = wedge.join(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    return closed.select(F.col("u").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, clustering)``: closed pairs of neighbours over all of them; null under two neighbours."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    d = degrees(nodes, edges).join(t, "node", "left")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.select("node", F.when(F.col("degree") >= 2, F.coalesce("t", F.lit(0)) / pairs).alias("clustering"))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges ``(a, b)`` of ``n`` numbered nodes."""
    p = np.arange(n)
    while True:
        x, y = p[a], p[b]
        if (x == y).all():
            return p
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while ((up := p[p]) != p).any():
            p = up


def local_stars(pairs: DataFrame, lo: str, hi: str) -> DataFrame:
    """``(lo, hi)``: links with the same components, those that each task sees of one component being a star around its least.

    A combiner before links are exchanged: a chain within a task's rows takes no rounds any more. Links are taken in lots of
    :data:`LOT`, so a task holds a bounded number of them. Links of equal or null ends are left out.
    """
    kind = dict(pairs.dtypes)[lo]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            a, b = (t.column(c).combine_chunks() for c in ("lo", "hi"))
            names = pc.unique(pa.concat_arrays([a, b]))
            names = names.take(pc.sort_indices(names))
            root = _roots(*(pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False) for x in (a, b)), len(names))
            member = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(root[member])), names.take(pa.array(member))], ["lo", "hi"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LOT:
                yield from stars()
                held, n = [], 0
        if n:
            yield from stars()

    return pairs.select(F.col(lo).alias("lo"), F.col(hi).alias("hi")).filter("lo <> hi").mapInArrow(combine, f"lo {kind}, hi {kind}")


def component_labels(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, label)`` of nodes with an edge: the least node of their component.

    Alternates two star steps: neighbours above a node move to its least neighbour, then those below do, until all is
    stars. Every round is a written table; the number of rounds grows with the logarithm of the size. What each task holds
    of a component is made a star first.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    now = local_stars(edges, "src", "dst").select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    now = scratch.cut(now.distinct())
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = Observation()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        least = scratch.cut(least.observe(seen, F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("loose")).select("u", "m"))
        if not seen.get["loose"]:
            break
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = scratch.cut(big.filter("u <> v").distinct())
        small = big.join(big.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        nxt = local_stars(nxt, "v", "u").select(F.col("hi").alias("u"), F.col("lo").alias("v")).distinct()
        nxt = scratch.cut(nxt)
        scratch.drop(now, least, big)
        now = nxt
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, mean and population variance of the degree, mean clustering, components and orphans."""
    d = degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.var_pop("degree"), 6).alias("var_degree"),
        F.count_if(F.col("degree") == 0).alias("n_orphans"),
    )
    c = clustering(nodes, edges).agg(F.round(F.coalesce(F.avg("clustering"), F.lit(0.0)), 6).alias("mean_clustering"))
    n = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    k = component_labels(edges).agg(F.count_distinct("label").alias("linked"))
    one = d.crossJoin(c).crossJoin(n).crossJoin(k)  # four tables of one row
    return one.select("n_nodes", "n_edges", "mean_degree", "var_degree", "n_orphans", "mean_clustering", (F.col("linked") + F.col("n_orphans")).alias("n_components"))
