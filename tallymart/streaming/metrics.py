"""Hourly metrics from arriving orders.

Every micro-batch stores what it adds to the hours it touches, as sums and a customer sketch that can be merged;
reading merges them. No order is too late, and the result does not depend on how the input was cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.dates import hour_key
from tallymart.functions.money import amount, mean
from tallymart.operators.metrics import SKETCH_LG_K
from tallymart.operators.reports import status_count


def partials(orders: DataFrame) -> DataFrame:
    """What some orders add to each tenant and hour."""
    hour = F.date_trunc("hour", F.col("order_date").cast("timestamp"))
    return orders.groupBy("tenant_id", hour.alias("hour")).agg(
        F.sum("total_amount").alias("revenue"),
        F.count("*").alias("num_orders"),
        F.hll_sketch_agg("customer_id", SKETCH_LG_K).alias("customers"),
        status_count("delivered").alias("delivered_orders"),
        status_count("cancelled").alias("cancelled_orders"),
    )


def hourly(added: DataFrame) -> DataFrame:
    """Rows of the pre-aggregate table per tenant and hour; customers are counted with a sketch."""
    merged = added.groupBy("tenant_id", "hour").agg(
        *(F.sum(c).alias(c) for c in ("revenue", "num_orders", "delivered_orders", "cancelled_orders")),
        F.hll_union_agg("customers").alias("customers"),
    )
    return merged.select(
        "tenant_id",
        F.concat(F.lit("hour:"), hour_key(F.col("hour"))).alias("group_key"),
        F.to_date("hour").alias("period_start"),
        F.to_date("hour").alias("period_end"),
        amount(F.col("revenue")).alias("sum_sales"),
        "num_orders",
        F.hll_sketch_estimate("customers").alias("unique_customers_est"),
        mean(F.col("revenue"), F.col("num_orders")).alias("avg_order_value"),
        "delivered_orders",
        "cancelled_orders",
        (F.col("hour") + F.expr("interval 1 hour")).alias("last_updated"),
    )


def add_to(folder: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler that stores the batch's share; a repeated batch replaces its own."""

    def apply(orders: DataFrame, batch: int) -> None:
        partials(orders).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return apply


def read(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark.read.parquet(folder))
