"""Evaluation of scores against labels. Everything works on counts of distinct values, so hot values are one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hodograph.functions.numeric import known
from hodograph.runtime import Scratch


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, n)`` over known values."""
    return df.filter(known(F.col(value))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def _ranged(c: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The counts as a written table in ranges of (keys, value), with the number of the range as ``pid``.

    Equal values of a key are in one range; a key that holds most values is many ranges.
    """
    return Scratch(c.sparkSession, "ranges").cut(c.repartitionByRange(*keys, value).withColumn("pid", F.spark_partition_id()), "counts")


def _upto(c: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``n`` over the rows of the same keys with at most this value, given :func:`_ranged` counts.

    Each range sums by itself; what lies ahead of it comes from the sums of ranges, which are ranges times keys rows.
    """
    inside = Window.partitionBy("pid", *keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy("pid", *keys).agg(F.sum("n").alias("t")).withColumn("ahead", F.coalesce(F.sum("t").over(before), F.lit(0)))
    return c.withColumn(name, F.sum("n").over(inside)).join(sums.drop("t"), ["pid", *keys]).withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")


def auc_one_vs_rest(scores: DataFrame, level: str, category: str, score: str) -> DataFrame:
    """``(level, category, auc)``: chance that a row of the category scores at least as high as one of the rest.

    Ties count as full wins. 0.5 if either side is empty. Unknown scores do not take part.
    """
    c = _ranged(value_counts(scores, [level, category], score), [level], score)
    c = _upto(_upto(c, [level], score, "all_upto"), [level, category], score, "own_upto")
    c = c.withColumn("below", F.col("all_upto") - F.col("own_upto"))
    total = c.groupBy(level).agg(F.sum("n").alias("all"))
    g = c.groupBy(level, category).agg(F.sum(F.col("n") * F.col("below")).alias("wins"), F.sum("n").alias("p")).join(total, level)
    q = F.col("all") - F.col("p")
    return g.select(level, category, F.when(q > 0, F.col("wins") / (F.col("p") * q)).otherwise(F.lit(0.5)).alias("auc"))


def auc_pairwise(scores: DataFrame, level: str, category: str, score: str) -> DataFrame:
    """``(level, a, b, auc)`` for categories ``a < b``: the better of both directions; ties count as full wins.

    Needs for each value how many rows of each category are at or below it, so distinct values times categories rows,
    which are made range by range.
    """
    c = _ranged(value_counts(scores, [level, category], score), [level], score)
    grid = c.select("pid", level, score).distinct().join(c.select(level, category).distinct(), level)
    full = _upto(grid.join(c, ["pid", level, category, score], "left").fillna(0, ["n"]), [level, category], score, "below")
    x = full.filter("n > 0").select("pid", level, score, F.col(category).alias("x"), "n")
    y = full.select("pid", level, score, F.col(category).alias("y"), "below")
    wins = x.join(y, ["pid", level, score]).filter("x <> y").groupBy(level, "x", "y").agg(F.sum(F.col("n") * F.col("below")).alias("wins"))
    size = c.groupBy(level, category).agg(F.sum("n").alias("n"))
    sx, sy = size.select(level, F.col(category).alias("x"), F.col("n").alias("nx")), size.select(level, F.col(category).alias("y"), F.col("n").alias("ny"))
    auc = wins.join(sx, [level, "x"]).join(sy, [level, "y"]).withColumn("auc", F.col("wins") / (F.col("nx") * F.col("ny")))
    lo, hi = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    return auc.groupBy(level, lo, hi).agg(F.max("auc").alias("auc"))


def threshold_sweep(scores: DataFrame, label: str, score: str, steps: int = 100) -> DataFrame:
    """``(theta, fnr, tnr)`` for thresholds 0, 1/steps, … 1: the shares of positives and of negatives under each.

    Rows are counted once by the number of thresholds they reach; the sweep runs over those counts.
    """
    guess = F.floor(F.col(score) * steps)
    # The quotient i / steps decides, not the product, which may round to the other side.
    reach = F.when((guess + 1) / steps <= F.col(score), guess + 1).when(guess / steps > F.col(score), guess - 1).otherwise(guess)
    reach = F.least(F.greatest(reach, F.lit(-1)), F.lit(steps)).cast("int")
    c = scores.filter(known(F.col(score))).groupBy(reach.alias("reach")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    theta = scores.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    both = theta.join(F.broadcast(c), F.col("reach") < F.col("i"), "left")  # at most steps + 2 rows
    under = both.groupBy("i").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("q"), F.lit(0)).alias("q"))
    all_ = c.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return under.crossJoin(all_).select((F.col("i") / steps).alias("theta"), F.try_divide("p", "np").alias("fnr"), F.try_divide("q", "nq").alias("tnr"))


def truncating_quantiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, str]) -> DataFrame:
    """The value at an index of each group's sorted values. ``picks``: name to an expression of ``total`` for the index."""
    c = _upto(_ranged(value_counts(df, keys, value), keys, value), keys, value, "upto")
    c = c.join(c.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    return c.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") > F.expr(e), F.col(value))).alias(name) for name, e in picks.items()))


def spearman_by_index(df: DataFrame, group: str, index: str, a: str, b: str) -> DataFrame:
    """``(group, n, rho)``: correlation of ordinal ranks (ties in order of the index); 0 under two rows or without spread."""
    ra = F.row_number().over(Window.partitionBy(group).orderBy(a, index)).alias("ra")
    rb = F.row_number().over(Window.partitionBy(group).orderBy(b, index)).alias("rb")
    g = df.select(group, ra, rb).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))
    return g.select(group, "n", F.when((F.col("n") >= 2) & known(F.col("rho")), F.col("rho")).otherwise(F.lit(0.0)).alias("rho"))


def path_set_jaccard(a: DataFrame, b: DataFrame, group: str, path: str) -> DataFrame:
    """``(group, jaccard)`` of two sets of paths; 1 where both are empty is up to the caller, who has the groups."""
    both = a.select(group, path, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(group, path, F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = both.groupBy(group, path).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return each.groupBy(group).agg((F.sum(F.col("x") * F.col("y")) / F.count(F.lit(1))).alias("jaccard"))
