"""Stock levels as a fold over movements.

A level moves by ``L = max(0, L + delta)`` in file order. With S the running sum of the deltas
the level after each movement is ``S + max(L0, -min(S so far))``, so two running aggregates
replace the loop. Running aggregates over one product's whole history would put a hot product into
one task, so the history is cut into blocks of the file order: inside a block the window is
bounded by the block, and across blocks only one summary row per product and block is carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.dates import at, before, parse_timestamp
from tallymart.sources.files import file_order

EVENTS_PER_BLOCK = 10_000_000

NOT_FOUND = "product not found"
BAD_DELTA = "processing error: delta is not an integer"


@dataclass(frozen=True)
class StockFold:
    """A fold in two parts: movements with their block-local aggregates, and what each block inherits."""

    movements: DataFrame
    carried: DataFrame


def fold(
    events: DataFrame,
    products: DataFrame,
    *,
    block: Column,
    levels: DataFrame | None = None,
    order: list[str] | None = None,
) -> StockFold:
    """Prepare the fold of ``events(product_id, delta, event_time, …)`` onto ``levels``.

    ``order`` is the file order, ``seq`` unless given. ``block`` must grow with it and bounds how many
    rows of one product meet in a task.
    A NULL delta is one that could not be read; it rejects all movements of its product.
    """
    movements = events.filter(F.col("product_id").isNotNull()).withColumn("fold_block", block)
    so_far = Window.partitionBy("product_id", "fold_block").orderBy(*(order or ["seq"])).rowsBetween(Window.unboundedPreceding, 0)
    movements = movements.withColumn("run", F.sum(F.coalesce("delta", F.lit(0))).over(so_far))
    movements = movements.withColumn("low", F.min("run").over(so_far))

    blocks = movements.groupBy("product_id", "fold_block").agg(
        F.sum(F.coalesce("delta", F.lit(0))).alias("moved"),
        F.min("run").alias("lowest"),
        F.count("*").alias("n"),
        F.count_if(F.col("delta") != 0).alias("n_applied"),
        F.max(F.col("delta").isNull()).alias("has_bad"),
        F.max("event_time").alias("last_time"),
    )
    earlier = Window.partitionBy("product_id").orderBy("fold_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("product_id")
    carried = (
        blocks.withColumn("before", F.coalesce(F.sum("moved").over(earlier), F.lit(0)))
        .withColumn("dip", F.col("before") + F.col("lowest"))
        .withColumn("dip_before", F.min("dip").over(earlier))
        .withColumn("dip_whole", F.min("dip").over(whole))
        .withColumn("rejected", F.max("has_bad").over(whole))
        .join(products.select("product_id", "tenant_id"), "product_id", "left")
    )
    if levels is None:
        carried = carried.withColumn("start", F.lit(0).cast("bigint"))
    else:
        start = levels.select("product_id", F.col("available").cast("bigint").alias("start"))
        carried = carried.join(start, "product_id", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    carried = carried.withColumn(
        "reason", F.when(F.col("tenant_id").isNull(), NOT_FOUND).when(F.col("rejected"), BAD_DELTA)
    )
    return StockFold(movements, carried)


def from_lines(lines: DataFrame, as_of) -> DataFrame:
    """Movements from the lines of an NDJSON upload, with their place in the file.

    Lines that are no JSON object or name no product are dropped. A missing delta is zero; one that is
    no whole number is NULL, which rejects its product. Empty members get their defaults.
    """
    doc = F.try_parse_json("value")
    member = {n: F.try_variant_get(doc, f"$.{n}", "string") for n in ("product_id", "delta", "event_time", "source", "meta")}
    read = lines.select("file", "block", "pos", "value", *(c.alias(n) for n, c in member.items()))
    given = F.coalesce(F.array_contains(F.json_object_keys("value"), "delta"), F.lit(False))
    bare = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.delta", "variant")) != "STRING"
    text = F.col("delta")
    delta = (
        F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint"))
        .when(text.isNotNull(), F.when(bare, text.try_cast("double").try_cast("bigint")))
        .when(~given, F.lit(0).cast("bigint"))
    )
    return read.filter(F.coalesce(F.col("product_id"), F.lit("")) != "").select(
        "file",
        "block",
        "pos",
        "product_id",
        delta.alias("delta"),
        F.coalesce(parse_timestamp(F.col("event_time")), at(as_of)).alias("event_time"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("system")).alias("source"),
        F.coalesce(F.nullif("meta", F.lit("")), F.lit("{}")).alias("meta"),
    )


def fold_lines(
    movements: DataFrame, products: DataFrame, *, levels: DataFrame | None = None
) -> StockFold:
    """Fold the movements of upload files in file order; a block is one split of a file.

    Splits are numbered in file order, one row for each, so that movements travel with a number and not with paths and padded paths.
    """
    in_order = Window.orderBy(file_order(F.col("file")), "file", "block")
    splits = movements.select("file", "block").distinct().withColumn("split", F.row_number().over(in_order))
    placed = movements.join(splits, ["file", "block"])
    done = fold(placed, products, block=F.col("split"), levels=levels, order=["split", "pos"])
    return StockFold(done.movements.drop("split"), done.carried)


def applied_events(fold: StockFold) -> DataFrame:
    """Every non-zero movement of an accepted product with the level it led to."""
    accepted = fold.carried.filter(F.col("reason").isNull()).select(
        "product_id", "fold_block", "tenant_id", "before", "dip_before", "start"
    )
    lowest = F.least(F.col("dip_before"), F.col("before") + F.col("low"))
    return (
        fold.movements.filter(F.col("delta") != 0)
        .join(accepted, ["product_id", "fold_block"])
        .withColumn("resulting_level", F.col("before") + F.col("run") + F.greatest("start", -lowest))
        .drop("fold_block", "run", "low", "before", "dip_before", "start")
    )


def product_summary(fold: StockFold) -> DataFrame:
    """Per product: movements seen and applied, final level, or the conflict that kept it out."""
    return (
        fold.carried.groupBy("product_id")
        .agg(
            F.any_value("tenant_id").alias("tenant_id"),
            F.sum("n").alias("events_processed"),
            F.sum("n_applied").alias("events_applied"),
            (F.sum("moved") + F.greatest(F.any_value("start"), -F.min("dip_whole"))).alias("final_level"),
            F.max("last_time").alias("last_updated"),
            F.any_value("reason").alias("reason"),
        )
    )


def final_levels(fold: StockFold) -> DataFrame:
    """The levels table rows that the accepted products end with."""
    return (
        product_summary(fold)
        .filter(F.col("reason").isNull())
        .select("product_id", "tenant_id", F.col("final_level").alias("available"), "last_updated")
    )


def conflicts(fold: StockFold) -> DataFrame:
    """Rejected products with the reason, as reported to the sender."""
    return product_summary(fold).filter(F.col("reason").isNotNull()).select(
        "product_id", "reason", "events_processed"
    )


def batch_summary(fold: StockFold) -> DataFrame:
    """One row: how many products and movements were applied, and whether anything conflicted."""
    ok = F.col("reason").isNull()
    return product_summary(fold).agg(
        F.when(F.count_if(~ok) > 0, "partial_success").otherwise("success").alias("status"),
        F.count_if(ok).alias("applied_products"),
        F.count_if(~ok).alias("conflicts"),
        F.coalesce(F.sum(F.when(ok, F.col("events_applied"))), F.lit(0)).alias("total_events_processed"),
    )


def merge_levels(levels: DataFrame, updates: DataFrame) -> DataFrame:
    """Levels with the updated products replaced and new ones added."""
    return levels.join(updates, "product_id", "left_anti").unionByName(updates.select(levels.columns))


def refresh_levels(
    levels: DataFrame, stock_events: DataFrame, as_of, *, hours: int | None = 1, zero_keeps: bool = False
) -> DataFrame:
    """Levels overwritten by the newest recorded level of each product with recent events.

    With ``zero_keeps`` a recorded level of zero leaves the stored one alone, as a truthiness test
    would; by default zero is a level like any other.
    """
    seen = stock_events
    if hours is not None:
        seen = seen.filter(F.col("event_time") >= before(as_of, hours=hours))
    usable = F.col("resulting_level").isNotNull()
    if zero_keeps:
        usable = usable & (F.col("resulting_level") != 0)
    # One row per product survives map-side, whatever the number of its events.
    newest = Window.partitionBy("product_id").orderBy(
        F.desc(usable), F.desc("event_time"), F.desc("stock_event_id")
    )
    latest = (
        seen.withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") == 1)
        .select(
            "product_id",
            F.col("tenant_id").alias("event_tenant"),
            F.when(usable, F.col("resulting_level")).alias("seen_level"),
            F.col("event_time").alias("seen_at"),
        )
    )
    return levels.join(latest, "product_id", "full").select(
        "product_id",
        F.coalesce("tenant_id", "event_tenant").alias("tenant_id"),
        F.coalesce("seen_level", "available", F.lit(0)).alias("available"),
        F.coalesce("seen_at", "last_updated").alias("last_updated"),
    )
