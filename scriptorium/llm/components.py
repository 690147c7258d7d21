"""Connected components by alternating large-star and small-star rounds.

A round maps every edge set to one with the same components and fewer steps to
the smallest node; the fixed point is one star for each component.  Each round
is written as a table, so a lost executor repeats one round at most, and only
a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "_a")
    out = both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
    out = down.join(least, F.col("a") == F.col("_a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return out.select("e.a", "e.b").filter("a <> b").distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long) other than the roots themselves.

    ``root`` is the smallest node reachable.  Loops and repeated links are
    allowed; nulls are dropped.  Without links the result is empty.
    """
    e = cut(links.select("a", "b").filter("a <> b").distinct())
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        after = cut(_small_star(_large_star(e)))
        drop_cut(e)
        e, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
