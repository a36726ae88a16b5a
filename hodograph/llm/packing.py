"""Problem 7: texts into containers of fixed capacity, with a controlled mixture of sources."""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hodograph.runtime import Scratch, read, small_rows, widen

#: A byte-level BPE rank file in the format of tiktoken: a token in base 64 and its rank on each line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens and rows that one packing task gets; more make more tasks, each with at most one badly filled window.
PART_TOKENS, PART_ROWS = 8_000_000, 50_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """Byte-level BPE from a rank file. The file is read where the work is done and is never part of this package."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(n, pa.int64())], ["id", "source", "tokens"])

    return count


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens)`` of every whole text that is not null and not empty; a null source is ``''``.

    A document given again counts once.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    src = src.filter("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counted = widen(src, "id").mapInArrow(_counter(path), "id long, source string, tokens long")
    return counted.groupBy("id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("id", "m.source", "m.tokens")


class Queue:
    """Items of one source in order of size."""

    def __init__(self, items: list[tuple[int, int, int]]):
        items.sort()
        self.sizes = [x[0] for x in items]
        self.names = [x[1:] for x in items]

    def fit(self, room: float) -> int:
        """Index of the largest item that fits, or -1."""
        return bisect_right(self.sizes, room) - 1

    def take(self, at: int) -> tuple[int, int, int]:
        return self.sizes.pop(at), *self.names.pop(at)


def pack(items: list[tuple[str, int, int, int]], capacity: int, share: dict[str, float], carry: dict[str, float]) -> list[tuple[int, int, str, int, int, int]]:
    """``(window, slot, source, id, piece, tokens)`` of items ``(source, id, piece, tokens)``, each at most the capacity.

    Deficit round-robin: a window credits each source with its share of the capacity on top of what it is still owed
    (``carry`` at first); the source that is owed most gives its largest item within both its credit and the room, or,
    if no source has one, its largest within the room. Whatever was overdrawn is owed by the source in later windows.
    A window closes when nothing fits. Nothing is split or left over.
    """
    by: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for source, i, piece, tokens in items:
        by[source].append((tokens, i, piece))
    queues = {s: Queue(x) for s, x in sorted(by.items())}
    credit = {s: carry.get(s, 0.0) for s in queues}
    out, window = [], 0
    while queues:
        room, slot = capacity, 0
        for s in queues:
            credit[s] += capacity * share.get(s, 0.0)
        ranked = sorted((-credit[s], s) for s in queues)  # who is owed most; one source moves with each item
        while True:
            pick = next(((r, at) for r, (owed, s) in enumerate(ranked) if (at := queues[s].fit(min(room, -owed))) >= 0), None)
            pick = pick or next(((r, at) for r, (_, s) in enumerate(ranked) if (at := queues[s].fit(room)) >= 0), None)
            if pick is None:
                break
            r, at = pick
            s = ranked.pop(r)[1]
            tokens, i, piece = queues[s].take(at)
            out.append((window, slot, s, i, piece, tokens))
            room, slot = room - tokens, slot + 1
            credit[s] -= tokens
            if queues[s].sizes:
                insort(ranked, (-credit[s], s))
            else:
                del queues[s]
        window += 1
    return out


def _packer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity"].iloc[0])
    first = rows.drop_duplicates("source")
    placed = pack(
        list(zip(rows["source"], rows["id"], rows["piece"], rows["tokens"], strict=True)), capacity,
        dict(zip(first["source"], first["share"], strict=True)), dict(zip(first["source"], first["carry"], strict=True)),
    )
    out = pd.DataFrame(placed, columns=["window", "slot", "source", "id", "piece", "tokens"])
    out.insert(0, "part", key[1])
    out.insert(0, "container_id", key[0])
    return out


def pack_texts(
    counts: DataFrame, containers: DataFrame, scratch: Scratch, shares: DataFrame | None = None,
    part_tokens: int = PART_TOKENS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """``(container_id, part, window, slot, source, id, piece, tokens)``: every text placed once per container kind.

    ``counts(id, source, tokens)``; ``containers(container_id, capacity)``, those with a null or no positive capacity
    are left out; ``shares(source, share)`` are target token proportions, by default those of the corpus. A text of more
    tokens than the capacity is cut into full pieces, which fill windows alone, and a rest; no other text is cut. Texts
    without tokens need no container.

    Documents are dealt by the hash of their id to parts of bounded size, so a source that holds a third of all rows is
    spread as evenly as any. The deficit that a part starts with is what all parts before it leave: their tokens by
    source are summed first, so parts pack at the same time and the mixture carries over as if they followed each other.
    """
    spark = counts.sparkSession
    counts = scratch.cut(counts.filter("tokens > 0"), "counts")
    total = counts.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-(total["t"] or 0) // part_tokens), -(-total["n"] // part_rows))
    counts = counts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    by = counts.groupBy("part", "source").agg(F.sum("tokens").alias("t"))
    if shares is None:
        shares = by.groupBy("source").agg((F.sum("t") / F.lit(float(total["t"] or 1))).alias("share"))
    # What a source is owed when a part begins: its share of all tokens before, less its own before. Only parts that hold
    # the source need it, so there is one row for each of these and nothing is crossed.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    whole = by.groupBy("part").agg(F.sum("t").alias("whole")).withColumn("ahead", F.coalesce(F.sum("whole").over(first), F.lit(0)))
    sums = by.join(shares.select("source", "share"), "source", "left").fillna(0.0, ["share"]).join(whole, "part")
    own = F.coalesce(F.sum("t").over(before), F.lit(0))
    balance = sums.select("part", "source", "share", (F.col("share") * F.col("ahead") - own).alias("carry"))
    kinds = [(int(r[0]), int(r[1])) for r in small_rows(containers.dropna().distinct(), 1000, "containers") if r[1] > 0]
    if not kinds:
        return spark.createDataFrame([], "container_id int, part int, window long, slot int, source string, id long, piece int, tokens long")
    kind = F.explode(F.array(*(F.struct(F.lit(c).alias("container_id"), F.lit(k).cast("long").alias("capacity")) for c, k in kinds)))
    each = counts.join(balance, ["part", "source"], "left").fillna(0.0, ["share", "carry"]).withColumn("c", kind).select("*", "c.*").drop("c")
    each = each.withColumn("full", F.floor(F.col("tokens") / F.col("capacity"))).withColumn("rest", F.col("tokens") % F.col("capacity"))
    pieces = F.explode(F.when(F.col("full") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("full") - F.expr("int(rest = 0)"))))
    each = each.withColumn("piece", pieces).withColumn("size", F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("rest")))
    each = each.select("container_id", "part", "source", "id", F.col("piece").cast("int").alias("piece"), F.col("size").alias("tokens"), "capacity", "share", "carry")
    return each.groupBy("container_id", "part").applyInPandas(
        _packer, "container_id int, part int, window long, slot int, source string, id long, piece int, tokens long"
    )


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    kinds = read(spark, sf_dir, "containers").select("container_id", "capacity_tokens")
    return pack_texts(counts, kinds, Scratch(spark, "packing"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text with its window in each kind of container."""
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window with its pieces and tokens."""
    return _packed(spark, sf_dir).groupBy("container_id", "part", "window").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("tokens").alias("n_tokens"))


QUERIES = {"p7_packed": p7_packed, "p7_windows": p7_windows}
