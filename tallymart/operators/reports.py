"""Fixed analytic reports over orders, items, products, stock levels and price events.

Every report serves all tenants in one pass and carries ``tenant_id``; pass the result of
``scoped`` to run it for one tenant. Facts are aggregated before they meet a dimension, so a
hot customer, product or tenant is folded map-side and never travels as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymart.functions.dates import before, whole_days_between
from tallymart.functions.money import amount, mean
from tallymart.schemas import FULFILLED
from tallymart.session import drop_folder, folders, stored


def scoped(df: DataFrame, tenant_id=None) -> DataFrame:
    """Tenant isolation; the predicate reaches the scan."""
    return df if tenant_id is None else df.filter(F.col("tenant_id") == F.lit(tenant_id))


def recent(df: DataFrame, column: str, as_of, days: int | None) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; everything when ``days`` is None."""
    return df if days is None else df.filter(F.col(column) >= before(as_of, days=days))


def status_count(status: str) -> Column:
    return F.count_if(F.col("order_status") == status)


def order_summary(orders: DataFrame, *keys: Column) -> DataFrame:
    """Counts, exact revenue, average, distinct customers and status counts per key."""
    return (
        orders.groupBy(*keys)
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("total_amount").alias("revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
            status_count("delivered").alias("delivered_orders"),
            status_count("cancelled").alias("cancelled_orders"),
        )
        .withColumn("avg_order_value", mean(F.col("revenue"), F.col("total_orders")))
    )


def daily_order_analytics(orders: DataFrame, as_of, days: int | None = 30) -> DataFrame:
    """Per tenant and day, newest day first."""
    day = F.to_date("order_date").alias("order_day")
    summary = order_summary(recent(orders, "order_date", as_of, days), F.col("tenant_id"), day)
    return summary.withColumn("revenue", amount(F.col("revenue"))).withColumnRenamed(
        "revenue", "daily_revenue"
    ).orderBy(F.desc("order_day"), "tenant_id")


def daily_trend(orders: DataFrame, as_of, days: int | None = 30) -> DataFrame:
    """Orders per day without the cancelled ones, oldest day first."""
    return (
        recent(orders, "order_date", as_of, days)
        .filter(F.col("order_status") != "cancelled")
        .groupBy(F.to_date("order_date").alias("order_day"))
        .agg(F.count("*").alias("order_count"), F.sum("total_amount").alias("revenue"))
        .select(
            "order_day",
            "order_count",
            amount(F.col("revenue")).alias("daily_revenue"),
            mean(F.col("revenue"), F.col("order_count")).alias("avg_order_value"),
        )
        .orderBy("order_day")
    )


def tenant_daily_metrics(orders: DataFrame) -> DataFrame:
    """Fulfilled orders per tenant and day, for a table refreshed by partition overwrite."""
    return (
        orders.filter(F.col("order_status").isin(FULFILLED))
        .groupBy("tenant_id", F.to_date("order_date").alias("metric_date"))
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_amount").alias("revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
        .select(
            "tenant_id",
            "metric_date",
            "order_count",
            amount(F.col("revenue")).alias("total_revenue"),
            mean(F.col("revenue"), F.col("order_count")).alias("avg_order_value"),
            "unique_customers",
        )
    )


def refresh_daily(orders: DataFrame, changed: DataFrame, folder: str, layout: str = "day") -> list[str]:
    """Bring a stored ``tenant_daily_metrics`` up to date after a load; the periods (days, or months) that were written anew.

    ``changed`` holds the orders that the load touched, as they were and as they are, since an order may have moved to another day.
    Only their periods are computed and only these periods' files replaced; a period that has no order left goes. ``layout`` is
    fixed for a folder: days suit a table that is refreshed daily, months one that takes late rows over years.
    """
    spark = orders.sparkSession
    period = F.to_date(F.date_trunc(layout, "order_date"))
    found = changed.select(period.alias("period")).distinct().collect()  # calendar periods
    touched = {r["period"] for r in found if r["period"] is not None}
    if not touched:
        return []
    some = spark.createDataFrame([(d,) for d in touched], "period date")
    mine = orders.withColumn("period", period).join(some, "period", "left_semi").drop("period")
    fresh = stored(tenant_daily_metrics(mine).withColumn("period", F.to_date(F.date_trunc(layout, "metric_date"))), "daily")
    filled = {f"period={r['period']}" for r in fresh.select("period").distinct().collect()}
    before = {f for f in folders(spark, folder) if f.removeprefix("period=") in {str(d) for d in touched}}
    writer = fresh.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(folder)
    for gone in sorted(before - filled):
        drop_folder(spark, f"{folder}/{gone}")
    return sorted(str(d) for d in touched)


def stored_daily(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("period")


def tenant_rollup(tenants: DataFrame, orders: DataFrame, as_of, days: int | None = 30) -> DataFrame:
    """One row per tenant, tenants without orders included."""
    totals = (
        recent(orders, "order_date", as_of, days)
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("total_amount").alias("revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )
    return (
        tenants.join(totals, "tenant_id", "left")
        .select(
            "tenant_id",
            F.col("name").alias("tenant_name"),
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            amount(F.col("revenue")).alias("total_revenue"),
            mean(F.col("revenue"), F.col("total_orders")).alias("avg_order_value"),
            F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), "tenant_id")
    )


def product_sales(items: DataFrame, orders: DataFrame, as_of, days: int | None) -> DataFrame:
    """Fulfilled sales per product id. The join is on the order, the fold on the product.

    An order counts with its first item of a product, found by a sort, so that no task holds sums for each order and product.
    """
    sold_in = recent(orders, "order_date", as_of, days).filter(F.col("order_status").isin(FULFILLED))
    same = Window.partitionBy("order_id", "product_id").orderBy("order_id")
    return (
        items.join(sold_in.select("order_id"), "order_id")
        .withColumn("nth", F.row_number().over(same))
        .groupBy("product_id")
        .agg(
            F.count("*").alias("times_ordered"),
            F.sum("quantity").alias("total_sold"),
            F.sum("line_total").alias("revenue"),
            F.sum("unit_price").alias("price_sum"),
            F.count_if(F.col("nth") == 1).alias("order_count"),
        )
    )


def top_products(
    products: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    as_of,
    days: int | None = 90,
    limit: int = 20,
    per_tenant: bool = True,
) -> DataFrame:
    """Best sellers by revenue: top ``limit`` of each tenant, or of the whole table."""
    report = (
        product_sales(items, orders, as_of, days)
        .drop("order_count")
        .join(products.select("product_id", "tenant_id", "sku", "name", "price"), "product_id")
    )
    best_first = [F.desc("revenue"), F.asc("product_id")]
    if per_tenant:
        place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*best_first))
        report = report.withColumn("place", place).filter(F.col("place") <= limit)
        report = report.orderBy("tenant_id", "place").drop("place")
    else:
        report = report.orderBy(*best_first).limit(limit)
    return report.select(
        "tenant_id",
        "product_id",
        "sku",
        "name",
        amount(F.col("price")).alias("price"),
        "times_ordered",
        F.col("total_sold").alias("total_quantity_sold"),
        amount(F.col("revenue")).alias("total_revenue"),
        mean(F.col("price_sum"), F.col("times_ordered")).alias("avg_selling_price"),
    )


def low_stock(products: DataFrame, levels: DataFrame, as_of, threshold: int = 10) -> DataFrame:
    """Active products at or below the threshold, emptiest first."""
    short = levels.filter(F.col("available") <= threshold).select("product_id", "available", "last_updated")
    return (
        products.filter("active")
        .join(short, "product_id")
        .select(
            "tenant_id",
            "product_id",
            "sku",
            "name",
            "available",
            "last_updated",
            F.when(F.col("available") == 0, "Out of Stock")
            .when(F.col("available") <= threshold, "Low Stock")
            .otherwise("In Stock")
            .alias("stock_status"),
            whole_days_between(as_of, F.col("last_updated")).alias("days_since_update"),
        )
        .orderBy("available", "name", "product_id")
    )


def inventory_turnover(
    products: DataFrame, items: DataFrame, orders: DataFrame, levels: DataFrame, as_of, days: int | None = 90
) -> DataFrame:
    """Units sold against units on hand, with a speed class."""
    ratio = F.when(F.col("available") > 0, F.col("total_sold").cast("double") / F.col("available"))
    return (
        product_sales(items, orders, as_of, days)
        .join(products.select("product_id", "tenant_id", "sku", "name"), "product_id")
        .join(levels.select("product_id", "available"), "product_id", "left")
        .withColumn("turnover_ratio", ratio)
        .select(
            "tenant_id",
            "product_id",
            "sku",
            "name",
            "total_sold",
            amount(F.col("revenue")).alias("total_revenue"),
            "order_count",
            "available",
            "turnover_ratio",
            F.when(F.col("turnover_ratio") > 2.0, "High Turnover")
            .when(F.col("turnover_ratio") > 1.0, "Medium Turnover")
            .when(F.col("turnover_ratio") > 0.5, "Low Turnover")
            .otherwise("Slow Moving")
            .alias("turnover_category"),
        )
        .orderBy(F.desc_nulls_last("turnover_ratio"), "product_id")
    )


def price_change_analysis(
    price_events: DataFrame,
    products: DataFrame,
    as_of,
    days: int | None = 30,
    min_abs_pct: float | None = None,
) -> DataFrame:
    """Stored price changes with their product, largest change first."""
    changes = recent(price_events, "received_at", as_of, days)
    if min_abs_pct is not None:
        changes = changes.filter(F.abs("pct_change") > min_abs_pct)
    return (
        changes.join(products.select("product_id", "sku", "name"), "product_id")
        .select(
            "event_id",
            "tenant_id",
            "product_id",
            "sku",
            "name",
            amount(F.col("old_price")).alias("old_price"),
            amount(F.col("new_price")).alias("new_price"),
            F.col("pct_change").cast("double").alias("pct_change"),
            "anomaly_flag",
            "received_at",
            whole_days_between(as_of, F.col("received_at")).alias("days_since_change"),
        )
        .orderBy(F.desc(F.abs("pct_change")), "event_id")
    )


def customer_segments(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer value classes; a customer whose orders are all cancelled drops out.

    Orders are folded per customer first. An order without a status counts, as it would in a
    left join followed by ``status <> cancelled OR status IS NULL``.
    """
    counted = F.col("order_status").isNull() | (F.col("order_status") != "cancelled")
    spend = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count_if(counted).alias("total_orders"),
            F.sum(F.when(counted, F.col("total_amount"))).alias("spent"),
            F.max(F.when(counted, F.col("order_date"))).alias("last_order_date"),
        )
    )
    return (
        customers.select("customer_id", "tenant_id", "name", "email")
        .join(spend, "customer_id", "left")
        .filter(F.col("total_orders").isNull() | (F.col("total_orders") > 0))
        .select(
            "customer_id",
            "tenant_id",
            "name",
            "email",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            amount(F.col("spent")).alias("total_spent"),
            mean(F.col("spent"), F.col("total_orders")).alias("avg_order_value"),
            "last_order_date",
            F.when(F.col("spent") >= 1000, "High Value")
            .when(F.col("spent") >= 500, "Medium Value")
            .otherwise("Low Value")
            .alias("customer_segment"),
        )
        .orderBy(F.desc_nulls_last("total_spent"), "customer_id")
    )


def order_totals(items: DataFrame) -> DataFrame:
    """Order value from its items: empty or zero line totals fall back to quantity times price."""
    line = F.coalesce(
        F.nullif(F.col("line_total"), F.lit(0).cast("decimal(12,2)")),
        (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)"),
    )
    return items.groupBy("order_id").agg(
        F.count("*").alias("items"),
        amount(F.sum(F.col("quantity") * F.col("unit_price"))).alias("computed_total"),
        amount(F.sum(line)).alias("line_total"),
    )


def with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Each order with its customer's current name and e-mail, NULL when there is none."""
    found = customers.select(
        "customer_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email")
    )
    return orders.join(found, "customer_id", "left")


def with_product(items: DataFrame, products: DataFrame) -> DataFrame:
    """Each item with its product's current name and price, NULL when there is none."""
    found = products.select(
        "product_id", F.col("name").alias("product_name"), F.col("price").alias("product_price")
    )
    return items.join(found, "product_id", "left")
