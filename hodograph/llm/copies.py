"""From pairs of classes to pairs of records."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodograph.runtime import unbroadcast

#: Most record pairs that one pair of classes, or one class, is written out to. Beyond it the links run over the
#: representatives, which says the same in membership form, and a warning tells so.
WRITE_OUT = 1_000_000


def expand_pairs(pairs: DataFrame, members: DataFrame, inner: bool = True, write_out: int = WRITE_OUT) -> DataFrame:
    """``(a, b)`` with ``a < b``: all pairs of records of linked classes and, if ``inner``, of records of one class.

    ``pairs(a, b)`` links representatives, ``members(id, rep)`` has every record once. Where the classes of a link
    would give more than ``write_out`` record pairs, each record is paired with the representative of the other class
    only, and a class of copies beyond that size is written as links to its representative: every record keeps its
    links to different content, and a group of copies that holds a third of all rows stays linear. The representative is
    the least id of its class, so such rows are the membership itself. A ``UserWarning`` says when classes are written
    that way. Classes are looked at once for it; nothing is broadcast.
    """
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    links = pairs.select("a", "b")
    if inner:
        same = sizes.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        links = links.union(same)
    ma = unbroadcast(members.select(F.col("rep").alias("a"), F.col("id").alias("ia")))
    mb = unbroadcast(members.select(F.col("rep").alias("b"), F.col("id").alias("ib")))
    if largest**2 <= write_out:  # no two classes can have more, so sizes do not matter
        full = links.join(ma, "a").join(mb, "b").filter("a <> b OR ia < ib")
        return full.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    warnings.warn(f"a class has {largest} records: links that would give more than {write_out} pairs are written over its representative", stacklevel=2)
    na = unbroadcast(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")))
    nb = unbroadcast(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")))
    sized = links.join(na, "a").join(nb, "b").withColumn("big", F.col("na") * F.col("nb") > write_out)
    full = sized.filter("NOT big").join(ma, "a").join(mb, "b").filter("a <> b OR ia < ib").select("ia", "ib")
    stars_a = sized.filter("big").join(ma, "a").select("ia", F.col("b").alias("ib"))
    stars_b = sized.filter("big AND a <> b").join(mb, "b").select(F.col("a").alias("ia"), "ib")
    every = full.union(stars_a.union(stars_b).filter("ia <> ib").distinct())
    return every.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
