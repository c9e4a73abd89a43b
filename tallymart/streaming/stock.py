"""Stock levels from arriving movements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators import stock
from tallymart.sources.store import TableStore


def apply_to(
    store: TableStore, products: DataFrame, block: Callable[[], Column], source: str = "stream"
) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler that folds movements onto the stored levels.

    Folding batch after batch gives the same levels as folding everything at once. A batch reads only the partitions of levels
    that its products fall into. Until it has changed them, running it again after a failure folds from the same levels.
    """

    def apply(movements: DataFrame, batch: int) -> None:
        if store.is_done("stock_levels", batch, source):
            return
        touched = movements.select(F.col("product_id").cast("string").alias("product_id"))
        levels = store.read("stock_levels", only=touched)
        fold = stock.fold(movements, products, block=block(), levels=levels)
        events = stock.applied_events(fold).select(
            F.col("seq").alias("stock_event_id"),
            "tenant_id",
            "product_id",
            "delta",
            "resulting_level",
            "event_time",
            F.lit("system").alias("source"),
            F.lit("{}").alias("meta"),
        )
        store.append("stock_events", events, batch, source)
        store.upsert("stock_levels", stock.final_levels(fold), ["product_id"], batch, source)

    return apply
