"""Streams run to the end of their input, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hodograph.runtime import Scratch
from hodograph.streaming import events as S


def _run(spark, stream, mode: str):
    """Run with the input at hand; the last state of the result is a written table."""
    scratch = Scratch(spark, "stream")
    out = f"{scratch.base}/result"
    q = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{scratch.base}/progress")
        .foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark, sf):
    # A pattern, as a plain path would have to be a folder.
    return spark.readStream.schema(S.SCHEMA).parquet(f"{sf}/events.parque[t]")


def st_gate_windows(spark, sf):
    return _run(spark, S.gate_windows(_events(spark, sf)), "complete").select("start", "verdict", "n", F.round("mean_score", 9).alias("mean_score"))


def st_user_states(spark, sf):
    return _run(spark, S.user_states(_events(spark, sf)), "append").select("user_id", "event_id", F.round("v", 6).alias("v"), F.round("a", 6).alias("a"), "n_before")


QUERIES = {f.__name__: f for f in (st_gate_windows, st_user_states)}

SQL = {
    "st_gate_windows": """WITH g AS (SELECT date_trunc('hour', ts) AS start, 0.5 * least(greatest((value / 100 + 1) / 2, 0), 1) + 0.5 * (1 - exp(-10.64 * abs(value) / 1000)) AS score
          FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
        SELECT start, CASE WHEN score >= 0.5 THEN 'pass' ELSE 'block' END AS verdict, count(*) AS n, round(avg(score), 9) AS mean_score FROM g GROUP BY ALL""",
    "st_user_states": """SELECT user_id, event_id, round(abs(value), 6) AS v, round(coalesce(abs(value) - lag(abs(value)) OVER w, 0), 6) + 0.0 AS a,
        row_number() OVER w - 1 AS n_before FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
}
