"""Connected components of a large sparse graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``a``, ``b`` (long) to ``node``, ``root``: the smallest node reachable, for every node with a link.

    Each round hangs the greater neighbours of a node on its smallest neighbour, then the smaller ones. Rounds are
    stored in the shared folder, minima are combined before the shuffle, and hub nodes meet in a join that Spark
    can split. Null nodes and loops are ignored; no edges give no rows.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = _state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u")
        small = (
            moved.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        now = stored(small, "links")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
