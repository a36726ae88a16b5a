"""Session-level helpers: shared storage, lineage cuts, parallelism and size checks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator hands to every executor by broadcast.
BROADCAST_LIMIT = 64 << 20
#: Bytes of a partition that costly per-row work gets at most, by the planner's estimate.
PARTITION_BYTES = 64 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class TooLarge(ValueError):
    """A side that must be small enough to broadcast is not."""


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary folder; on a cluster, whose machines share no such folder, a
    ``RuntimeError`` is raised.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hodograph-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder during one operator call.

    Each :meth:`cut` replaces a plan by a written table, so that a lost executor costs a re-read and
    not a recomputation. :meth:`drop` frees a table that no later step reads; the rest goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.live: list[str] = []
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # the session is gone; the folder belongs to the cluster then
            pass

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        conf, kept = self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")  # what was exchanged for this table is removed once it is written
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, kept)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.live.append(path)
        return out

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            _delete(self.spark, path)
            self.live.remove(path)

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later step reads."""
        self._remove([df._scratch_path for df in dfs])

    def keep(self, *dfs: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {df._scratch_path for df in dfs}
        self._remove([p for p in self.live if p not in kept])


def slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def unbroadcast(df: DataFrame) -> DataFrame:
    """A side that grows with the data: joined by sort-merge, whatever its compressed files seem to weigh.

    The planner judges a table by the bytes of its files, and arrays and repeated ids are many times larger in a heap.
    """
    return df.hint("merge")


def widen(df: DataFrame, *keys: str, per_slot: int = 2) -> DataFrame:
    """Spread rows over the cluster before costly per-row work.

    A scan of enough splits is left alone. What comes out of an exchange is always spread: adaptive execution would make
    few partitions of few bytes, and to ask how many would run everything before it. Partitions are ``per_slot`` for each
    slot, or more where they would exceed :data:`PARTITION_BYTES` of what is read from storage.
    """
    n, plan = slots(df.sparkSession), df._jdf.queryExecution()
    if "Exchange" not in plan.executedPlan().toString() and plan.toRdd().getNumPartitions() >= n:
        return df
    leaves = plan.optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 60)  # beyond is what the planner says of a source it knows nothing of
    return df.repartition(max(n * per_slot, -(-size // PARTITION_BYTES)), *(F.col(k) for k in keys))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a side that is small by definition. Raises :class:`TooLarge` beyond ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what}: more than {limit} rows")
    return rows
