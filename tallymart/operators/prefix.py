"""Running numbers per key that stay distributed when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, keys: list[str], block: Column, order: list[str], name: str, start: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each key in ``order``, from 0 or from the key's ``start``.

    ``block`` must grow with the order. Rows are ranked inside (key, block) only; block sizes,
    one row each, supply the offset, and ``start(*keys, start)`` is added to these. Keys must not be NULL.
    """
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    if start is not None:
        begun = F.col("_offset") + F.coalesce("start", F.lit(0))
        offsets = offsets.join(start, keys, "left").withColumn("_offset", begun).drop("start")
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_inside") - 1)
        .drop("_block", "_inside", "_offset")
    )
