"""Problem 6: runs of equal or nearly equal consecutive events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hodograph.llm.cells import dictionary, steps, unit
from hodograph.runtime import read, widen

#: Cells of at least this cosine count as the same; others are unlike by one less their cosine, so by more than 0.1.
SAME_COSINE = 0.90
#: Cost of one boundary between runs. At up to half of the least unlikeness no run takes in a step of another cell.
PENALTY = 0.05
#: The same for runs that may take in single odd steps: two boundaries cost more than a step of unlikeness under 0.8.
TOLERANT = 0.40
#: States of the dynamic programme that are kept for tracing back at once.
STATES = 1 << 24


class Unlikeness:
    """Graded dissimilarity of cells, worked out for the cells that meet in a sequence; no table of all pairs is made."""

    def __init__(self, centroids: np.ndarray, same: float = SAME_COSINE):
        self.unit, self.same = unit(centroids), same

    def __call__(self, own: np.ndarray) -> np.ndarray:
        """Matrix for these distinct cells; a cell outside the dictionary is alike itself only."""
        d = 1.0 - np.eye(len(own))
        inside = np.flatnonzero((own >= 0) & (own < len(self.unit)))
        if len(inside):
            u = self.unit[own[inside]]
            cos = u @ u.T
            np.fill_diagonal(cos, 1.0)
            d[np.ix_(inside, inside)] = np.where(cos >= self.same - 1e-12, 0.0, 1.0 - cos)
        return d


def segment_all(cells: np.ndarray, offsets: np.ndarray, unlike, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, typical)`` of the runs of sequences given as one array with offsets, in order; no sequence is empty.

    Minimises the sum over runs of the within-run dissimilarity (of all steps to the run's typical cell, one of the
    sequence's) plus ``penalty`` per run; ties keep the run, then go to the least cell. ``unlike`` gives the dissimilarity
    of distinct cells.

    Of all segmentations that end at a step with a run of the same typical cell only the cheapest can win later, whatever
    follows, as what follows costs them the same; the others are pruned. So as many are left as the sequence has distinct
    cells, however long it is and however many tie, and the time is steps times cells. An optimal boundary never parts equal
    neighbours, so those are one step with a weight.
    """
    n = np.diff(offsets)
    seq = np.repeat(np.arange(len(n)), n)
    change = np.ones(len(cells), dtype=bool)
    change[1:] = (cells[1:] != cells[:-1]) | (seq[1:] != seq[:-1])
    at = np.flatnonzero(change)
    tok, weight, owner = cells[at], np.diff(np.append(at, len(cells))).astype(np.float64), seq[at]
    length = np.bincount(owner, minlength=len(n))
    first = np.concatenate([[0], np.cumsum(length)])[:-1]
    starts, typical = np.zeros(len(tok), dtype=bool), np.zeros(len(tok), dtype=np.int64)
    alone = length == 1
    starts[first[alone]], typical[first[alone]] = True, tok[first[alone]]
    # Distinct cells of each sequence, by sequence and cell.
    order = np.lexsort((tok, owner))
    new = np.ones(len(tok), dtype=bool)
    new[1:] = (tok[order][1:] != tok[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds = np.bincount(owner[order][new], minlength=len(n))
    base = np.concatenate([[0], np.cumsum(kinds)])
    own, code = tok[order][new], np.empty(len(tok), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    code -= base[owner]
    todo = np.flatnonzero(~alone)
    todo = todo[np.lexsort((-length[todo], kinds[todo]))]  # of one width together, the longest first
    i = 0
    while i < len(todo):
        k = kinds[todo[i]]
        j = i + int(np.searchsorted(kinds[todo[i:]], k, side="right"))
        j = min(j, i + max(1, int(STATES // max(1, length[todo[i]] * k))))
        _programme(todo[i:j], int(k), tok, code, weight, first, length, own, base, unlike, penalty, starts, typical)
        i = j
    return at[starts], typical[starts]


def _single(cells: list[int], weights: list[float], d: list[list[float]], penalty: float) -> tuple[list[int], list[bool]]:
    """``(state, begins)`` by step of one sequence of few distinct cells, where whole arrays would be mostly overhead."""
    cost, moved, source = [w * weights[0] for w in (row[cells[0]] for row in d)], [0], [0]
    for cell, w in zip(cells[1:], weights[1:], strict=True):
        low = min(cost)
        source.append(cost.index(low))
        low, new = low + penalty, 0
        for r, x in enumerate(cost):
            if low < x:
                x, new = low, new | 1 << r
            cost[r] = x + w * d[r][cell]
        moved.append(new)
    r, state, begins = cost.index(min(cost)), [], []
    for new, before in zip(reversed(moved), reversed(source), strict=True):
        state.append(r)
        begins.append(bool(new >> r & 1))
        if begins[-1]:
            r = before
    begins[-1] = True
    return state[::-1], begins[::-1]


def _programme(some, k, tok, code, weight, first, length, own, base, unlike, penalty, starts, typical) -> None:
    """Fills ``starts`` and ``typical`` for sequences of ``k`` distinct cells each, sorted from the longest."""
    d = np.stack([unlike(own[base[s] : base[s] + k]) for s in some])  # sequences x cells x cells
    if len(some) * k <= 16:
        for s, own_d in zip(some, d, strict=True):
            span = slice(first[s], first[s] + length[s])
            state, begins = _single(code[span].tolist(), weight[span].tolist(), own_d.tolist(), penalty)
            starts[span], typical[span] = begins, own[base[s] + np.array(state)]
        return
    size, rank = length[some], np.arange(len(some))
    most = int(size[0])
    left = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # sequences that have a step t
    cost = np.zeros((len(some), k))
    moved = [None] * most  # bits: the run of this typical cell begins here
    source = [None] * most  # where such a run comes from
    for t in range(most):
        m = int(left[t])
        here = first[some[:m]] + t
        if t:
            best = cost[:m].argmin(axis=1)
            least = cost[rank[:m], best][:, None] + penalty
            new = least < cost[:m]
            cost[:m] = np.where(new, least, cost[:m])
            moved[t], source[t] = np.packbits(new, axis=1), best.astype(np.int32)
        cost[:m] += weight[here][:, None] * d[rank[:m], code[here]]
    state = cost.argmin(axis=1)
    for t in range(most - 1, -1, -1):
        m = int(left[t])
        here = first[some[:m]] + t
        typical[here] = own[base[some[:m]] + state[:m]]
        if t == 0:
            starts[here] = True
            break
        new = (moved[t][rank[:m], state[:m] >> 3] >> (7 - (state[:m] & 7))) & 1
        begun = new.astype(bool)
        starts[here[begun]] = True
        state[:m] = np.where(begun, source[t], state[:m])


def segment(cells: np.ndarray, unlike, penalty: float = PENALTY) -> list[tuple[int, int, int]]:
    """Runs ``(first, last, typical)`` of one non-empty sequence, as indices; see :func:`segment_all`."""
    starts, typical = segment_all(np.asarray(cells, dtype=np.int64), np.array([0, len(cells)]), unlike, penalty)
    return list(zip(starts.tolist(), [*(starts[1:] - 1).tolist(), len(cells) - 1], typical.tolist(), strict=True))


def _runner(unlike: Unlikeness, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                lists = part.column("steps")
                flat = lists.flatten()
                offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
                pos, cells = np.asarray(flat.field("pos"), dtype=np.int64), np.asarray(flat.field("celle"), dtype=np.int64)
                seq = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                once = np.ones(len(pos), dtype=bool)
                once[1:] = (pos[1:] != pos[:-1]) | (seq[1:] != seq[:-1])
                pos, cells, seq = pos[once], cells[once], seq[once]
                n = np.bincount(seq, minlength=part.num_rows)
                bounds = np.concatenate([[0], np.cumsum(n[n > 0])])
                if not len(pos):
                    continue
                starts, typical = segment_all(cells, bounds, unlike, penalty)
                last = np.append(starts[1:], len(pos)) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("fact_id").take(pa.array(seq[starts])), *(pa.array(x.astype(np.int64)) for x in (pos[starts], pos[last], last - starts + 1, typical))],
                    ["fact_id", "start_pos", "end_pos", "n_steps", "cell"],
                )

    return run


def collapse_runs(trajectories: DataFrame, unlike: Unlikeness, penalty: float = PENALTY) -> DataFrame:
    """``(fact_id, start_pos, end_pos, n_steps, duration, cell)``: each sequence as its runs.

    Steps go in ascending ``pos``; a step stored again (same ``pos``) counts once, by its least cell; a gap in ``pos``
    does not end a run. ``duration`` is ``end_pos - start_pos``. Facts with a null id, null arrays or no step have no
    run; facts given again count once; confidences and other columns do not matter. Every sequence is one row, so the
    work is spread by rows and nothing is shuffled after facts are made unique; its time is linear in the steps.
    """
    runs = widen(steps(trajectories, conf=False), "fact_id").mapInArrow(
        _runner(unlike, penalty), "fact_id string, start_pos long, end_pos long, n_steps long, cell long"
    )
    return runs.selectExpr("fact_id", "start_pos", "end_pos", "n_steps", "end_pos - start_pos AS duration", "cell")


def _runs(spark: SparkSession, sf_dir: str, penalty: float = PENALTY) -> DataFrame:
    unlike = Unlikeness(dictionary(spark, sf_dir))
    return collapse_runs(read(spark, sf_dir, "trajectories").select("fact_id", "celle", "pos"), unlike, penalty)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("n_steps > 1").select("fact_id", "start_pos", "end_pos")


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its runs collapsed to one event each."""
    return _runs(spark, sf_dir).drop("cell")


def p6_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with runs that may take in odd steps, where that costs less than two boundaries."""
    return _runs(spark, sf_dir, TOLERANT)


QUERIES = {"p6_found": p6_found, "p6_collapsed": p6_collapsed, "p6_tolerant": p6_tolerant}

_RUNS = """
WITH cen AS (SELECT generate_subscripts(centroidi, 1) - 1 AS cell, unnest(centroidi) AS v FROM cell_dictionary),
same AS (SELECT a.cell AS x, b.cell AS y FROM cen a JOIN cen b ON list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) >= 0.9),
fact AS (SELECT fact_id, max(celle) AS celle, max(pos) AS pos FROM trajectories
         WHERE celle IS NOT NULL AND pos IS NOT NULL AND fact_id IS NOT NULL GROUP BY fact_id),
long AS (SELECT fact_id, unnest(pos) AS pos, unnest(celle) AS cell FROM fact),
step AS (SELECT fact_id, pos, min(cell) AS cell FROM long WHERE pos IS NOT NULL AND cell IS NOT NULL GROUP BY ALL),
prev AS (SELECT *, lag(cell) OVER (PARTITION BY fact_id ORDER BY pos) AS before FROM step),
cut AS (SELECT p.*, CASE WHEN p.cell = p.before OR s.x IS NOT NULL THEN 0 ELSE 1 END AS new
        FROM prev p LEFT JOIN same s ON s.x = p.before AND s.y = p.cell),
num AS (SELECT *, sum(new) OVER (PARTITION BY fact_id ORDER BY pos) AS run FROM cut)
SELECT fact_id, CAST(min(pos) AS BIGINT) AS start_pos, CAST(max(pos) AS BIGINT) AS end_pos{more} FROM num GROUP BY fact_id, run {having}
"""
SQL = {
    "p6_found": _RUNS.format(more="", having="HAVING count(*) > 1"),
    "p6_collapsed": _RUNS.format(
        more=", count(*) AS n_steps, CAST(max(pos) - min(pos) AS BIGINT) AS duration", having=""
    ),
}
