"""Queries through files: what a sink writes to the shared folder a reader reads back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from hodograph.functions.numeric import shown
from hodograph.functions.scalar import WEIGHTS
from hodograph.operators.cells import centroid_rows
from hodograph.plans import q_motion
from hodograph.runtime import _delete, read, shared_dir
from hodograph.sources import generators, readers, sinks


def _folder(spark, name):
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"

    def end():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster then
            pass

    atexit.register(end)
    return path


def y5_dictionary_file(spark, sf):
    """The dictionary as a JSON object and back."""
    path = _folder(spark, "dictionary")
    sinks.write_dictionary(read(spark, sf, "cell_dictionary"), path)
    d = readers.read_dictionary(spark, path)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return d.select("versione", "metric", "k", "dim").crossJoin(centroid_rows(d).select("cell", F.round(length, 6).alias("norm")))  # one row of the former


def y6_trajectory_file(spark, sf):
    """Trajectories as JSON maps, one on a line, and back."""
    path = _folder(spark, "trajectories")
    sinks.write_trajectories(q_motion._facts(spark, sf), path)
    t = readers.read_trajectories(spark, path, lines=True)
    cells = F.array_join(F.transform("celle", lambda c: F.coalesce(c.cast("string"), F.lit("-"))), " ")
    mass = F.aggregate("conf", F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x.cast("double"), F.lit(0.0))))
    return t.select("fact_id", cells.alias("cells"), F.size("pos").alias("n_pos"), shown(mass, 4).alias("mass"))


def r1_pair_index(spark, sf):
    """Each evaluation passage and the next as an index of pairs, written and read."""
    i = read(spark, sf, "eval_items")
    nxt = i.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("text_b"))
    path = _folder(spark, "index")
    pairs = i.join(nxt, "item_id").select(F.col("item_id").cast("string").alias("pair_id"), F.col("lang").alias("category"), F.col("text").alias("text_a"), "text_b")
    sinks.write_pair_index(pairs, path)
    return readers.read_pair_index(spark, path, lines=True).select("pair_id", "category", "text_a", "text_b")


def r6_payload_files(spark, sf):
    """Captured answers as files, and what is in them."""
    c = read(spark, sf, "cell_dictionary").select(F.to_json(F.struct("versione", "k", "dim")).alias("value"))
    path = _folder(spark, "payloads")
    c.write.text(path)
    p = readers.read_payloads(spark, path).select(F.from_json("payload", "versione string, k int, dim int").alias("x"))
    return p.filter("x.k IS NOT NULL").select("x.versione", "x.k", "x.dim")


def q16_generated(spark, sf):
    """Two hundred branches of the reproducible generator."""
    b = generators.branches(spark, 200, 5, 0.3, seed=1)
    return b.select("branch", "candidate_id", *(F.round(c, 12).alias(c) for c in ("s_inertial", "s_geometric", "s_colbert")), F.round("action", 9).alias("action"))


QUERIES = {f.__name__: f for f in (y5_dictionary_file, y6_trajectory_file, r1_pair_index, r6_payload_files, q16_generated)}

SQL = {
    "y5_dictionary_file": """SELECT versione, metric, k, dim, unnest(range(len(centroidi)))::INT AS cell,
        unnest(list_transform(centroidi, lambda v: round(sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])), 6))) AS norm FROM cell_dictionary""",
    "y6_trajectory_file": f"""WITH {q_motion.FACT} SELECT fact_id, array_to_string(list_transform(celle, lambda c: coalesce(c::VARCHAR, '-')), ' ') AS cells, len(pos)::INT AS n_pos,
        round(list_sum(list_transform(conf, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x::DOUBLE END)), 4) + 0.0 AS mass FROM fact""",
    "r1_pair_index": """SELECT a.item_id::VARCHAR AS pair_id, a.lang AS category, a.text AS text_a, b.text AS text_b FROM eval_items a JOIN eval_items b ON b.item_id = a.item_id + 1""",
    "r6_payload_files": "SELECT versione, k, dim FROM cell_dictionary",
    "q16_generated": f"""WITH RECURSIVE g(i, x) AS (SELECT 0, 1::UHUGEINT UNION ALL
          SELECT i + 1, (x * {generators.MULTIPLIER}::UHUGEINT + {generators.INCREMENT}::UHUGEINT) % 18446744073709551616::UHUGEINT FROM g WHERE i < 800),
        u AS (SELECT (i - 1) // 4 AS branch, (i - 1) % 4 AS j, (x // 2048)::DOUBLE / 9007199254740992.0::DOUBLE AS v FROM g WHERE i > 0),
        r AS (SELECT branch, max(v) FILTER (j = 0) < 0.3 AS alike, max(v) FILTER (j = 1) AS a, max(v) FILTER (j = 2) AS b, max(v) FILTER (j = 3) AS c FROM u GROUP BY branch),
        s AS (SELECT branch, a AS s_inertial, CASE WHEN alike THEN a ELSE b END AS s_geometric, CASE WHEN alike THEN a ELSE c END AS s_colbert FROM r)
        SELECT branch::BIGINT AS branch, (branch // 5)::BIGINT AS candidate_id, round(s_inertial, 12) AS s_inertial, round(s_geometric, 12) AS s_geometric, round(s_colbert, 12) AS s_colbert,
               round(s_inertial * {WEIGHTS[0]} + s_geometric * {WEIGHTS[1]} + s_colbert * {WEIGHTS[2]}, 9) AS action FROM s""",
}
