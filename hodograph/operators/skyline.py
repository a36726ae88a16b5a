"""Non-dominated rows: fronts for costs and bands for scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hodograph.functions.scalar import dominates
from hodograph.runtime import BROADCAST_LIMIT, Scratch, widen

#: Rows that one task compares with one another.
HELD = 1 << 16


def blocks(df: DataFrame, n: int, row_bytes: int) -> list[DataFrame]:
    """A written table of ``n`` rows as parts of at most :data:`BROADCAST_LIMIT` bytes, each to be broadcast.

    A theta join with all rows is the union (or, for an anti join, the chain) of those with its parts.
    """
    k = max(1, -(-n * row_bytes // BROADCAST_LIMIT))
    if k == 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(k)) == i)) for i in range(k)]


def beaten(x: np.ndarray, y: np.ndarray, strict: bool) -> np.ndarray:
    """For each row of ``x`` how many rows of ``y`` are no greater in all columns (and, if ``strict``, less in one)."""
    out = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        all_le = np.ones((len(part), len(y)), dtype=bool)
        any_lt = np.zeros((len(part), len(y)), dtype=bool)
        for c in range(x.shape[1]):
            all_le &= y[None, :, c] <= part[:, None, c]
            if strict:
                any_lt |= y[None, :, c] < part[:, None, c]
        out[at : at + 512] = (all_le & any_lt).sum(1) if strict else all_le.sum(1)
    return out


def band(x: np.ndarray, limit: int, strict: bool) -> np.ndarray:
    """Mask of the rows that fewer than ``limit`` others beat.

    Rows go in order of their sum, so what beats a row comes before it, ties of the sum aside; and it is enough to count
    those kept so far, since a row that was dropped is beaten by ``limit`` kept ones, which beat all that it beats.
    """
    order = np.lexsort((*x.T[::-1], x.sum(axis=1)))
    keep = np.zeros(len(x), dtype=bool)
    held = np.zeros((0, x.shape[1]))
    for at in range(0, len(x), 512):
        part = order[at : at + 512]
        y = x[part]
        ok = beaten(y, held, strict) < limit if len(held) else np.ones(len(y), dtype=bool)
        y, part = y[ok], part[ok]
        # A row is not less than itself; without strictness it counts itself once.
        ok = (beaten(y, held, strict) if len(held) else 0) + beaten(y, y, strict) - (not strict) < limit
        keep[part[ok]] = True
        held = np.vstack([held, y[ok]])
    return keep


def _local(columns: list[str], signs: list[int], limit: int, strict: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for whole in batches:
            rows = pa.Table.from_batches([whole])
            held = rows if held is None else pa.concat_tables([held, rows])
            x = np.column_stack([s * held[c].to_numpy().astype(np.float64) for c, s in zip(columns, signs, strict=True)])
            held = held.filter(pa.array(band(x, limit, strict)))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return keep


def local_band(df: DataFrame, columns: list[str], signs: list[int], limit: int, strict: bool, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(rows, number)``: rows without those beaten by ``limit`` others that they met in a partition, as a written table.

    Survivors meet again in random partitions of at most :data:`HELD` rows until one holds them all, or, with more than that
    left, a round drops less than a fifth.
    """
    step = _local(columns, signs, limit, strict)
    now, n, parts = widen(df), None, 2
    while True:
        seen = Observation()
        met = scratch.cut(now.mapInArrow(step, df.schema).observe(seen, F.count(F.lit(1)).alias("n")), "band")
        before, n = n, seen.get["n"] or 0
        if parts == 1 or n == 0 or (before is not None and n > max(HELD, 0.8 * before)):
            return met, n
        parts = -(-n // HELD)
        now = met.repartition(parts)


def pareto_front(df: DataFrame, costs: list[str]) -> DataFrame:
    """Rows that no other row dominates (no cost greater, one less). Equal rows all stay; a row with an unknown cost
    is not comparable and stays. An empty input gives an empty result.

    Partitions drop what their own rows dominate. What one last partition has compared is the front; where survivors need
    more, they meet in anti joins with their distinct costs, broadcast in blocks of bounded bytes.
    """
    filled = df.select(*df.columns, *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_c{i}") for i, c in enumerate(costs)))
    names = [f"_c{i}" for i in range(len(costs))]
    scratch = Scratch(df.sparkSession, "front")
    front, n = local_band(filled, names, [1] * len(costs), 1, True, scratch)
    if n > HELD:
        other = scratch.cut(front.select(*(F.col(c).alias("_o" + c) for c in names)).distinct(), "costs")
        rule = dominates([F.col("_o" + c) for c in names], [F.col(c) for c in names])
        for part in blocks(other, n, 8 * len(costs)):
            front = front.join(part, rule, "left_anti")
    return front.select(*df.columns)
