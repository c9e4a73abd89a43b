"""Sales metrics: pre-aggregated, exact and sketch-based."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.dates import at, before, day_key, hour_key
from tallymart.functions.money import amount
from tallymart.operators.reports import order_summary
from tallymart.operators.upsert import upsert
from tallymart.schemas import NATURAL_KEY

# The answer labels clients look for.
METHOD_PREAGG = "approx-preagg"
METHOD_EXACT = "exact-scan"
METHOD_SKETCH = "approx-stream"
BOUND_PREAGG = "~2-3% relative error (HLL-like)"
BOUND_SKETCH = "~5-10% relative error (streaming sketch)"
GROUPINGS = ["day", "hour", "product", "category"]

SKETCH_LG_K = 12  # 2^12 registers: about 1.6 % standard error


def between(orders: DataFrame, since=None, until=None) -> DataFrame:
    """Orders in the half-open window ``[since, until)``."""
    if since is not None:
        orders = orders.filter(F.col("order_date") >= at(since))
    if until is not None:
        orders = orders.filter(F.col("order_date") < at(until))
    return orders


def inside(orders: DataFrame, start=None, end=None) -> DataFrame:
    """Orders in the closed window ``[start, end]`` of a metrics request."""
    if start is not None:
        orders = orders.filter(F.col("order_date") >= at(start))
    if end is not None:
        orders = orders.filter(F.col("order_date") <= at(end))
    return orders


def hourly_metrics(orders: DataFrame, since=None, until=None) -> DataFrame:
    """Order summary per tenant and hour, newest hour first."""
    hour = F.date_trunc("hour", "order_date").cast("timestamp_ntz").alias("order_hour")
    summary = order_summary(between(orders, since, until), F.col("tenant_id"), hour)
    return summary.withColumn("revenue", amount(F.col("revenue"))).withColumnRenamed(
        "revenue", "hourly_revenue"
    ).orderBy(F.desc("order_hour"), "tenant_id")


def preaggregate(orders: DataFrame, grain: str, as_of, *, since=None, until=None) -> DataFrame:
    """Rows of the pre-aggregate table for one grain, ``day`` or ``hour``, all tenants at once."""
    if grain == "day":
        bucket = F.to_date("order_date")
        label = F.concat(F.lit("day:"), F.date_format("bucket", "yyyy-MM-dd"))
    else:
        bucket = F.date_trunc("hour", "order_date").cast("timestamp_ntz")
        label = F.concat(F.lit("hour:"), hour_key(F.col("bucket")))
    summary = order_summary(between(orders, since, until), F.col("tenant_id"), bucket.alias("bucket"))
    return summary.filter(F.col("bucket").isNotNull()).select(
        "tenant_id",
        label.alias("group_key"),
        F.to_date("bucket").alias("period_start"),
        F.to_date("bucket").alias("period_end"),
        amount(F.col("revenue")).alias("sum_sales"),
        F.col("total_orders").alias("num_orders"),
        F.col("unique_customers").alias("unique_customers_est"),
        "avg_order_value",
        "delivered_orders",
        "cancelled_orders",
        at(as_of).alias("last_updated"),
    )


def window_of(grain: str, as_of, aligned: bool = False) -> tuple[Column, Column]:
    """The timer's window: the last day or hour before ``as_of``, cut to whole periods if aligned."""
    end = F.date_trunc(grain, at(as_of)).cast("timestamp_ntz") if aligned else at(as_of)
    return before(end, days=1 if grain == "day" else 0, hours=1 if grain == "hour" else 0), end


def refresh_preaggregates(
    preagg: DataFrame, orders: DataFrame, grain: str, as_of, aligned: bool = False
) -> DataFrame:
    """The pre-aggregate table after one timer run.

    The default window slides, so it overwrites two partial periods, as the hourly and daily timers
    always did; ``aligned`` recomputes the last whole period instead. The daily timer has no upper bound.
    """
    since, until = window_of(grain, as_of, aligned)
    fresh = preaggregate(
        orders, grain, as_of, since=since, until=until if aligned or grain == "hour" else None
    )
    return upsert_metrics(preagg, fresh)


def upsert_metrics(preagg: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(preagg, fresh, NATURAL_KEY["metrics_preagg"])


def metrics_json(preagg: DataFrame) -> DataFrame:
    """The pre-aggregate table in its exchange form: one JSON text per row."""
    body = [
        "sum_sales",
        "num_orders",
        "unique_customers_est",
        "avg_order_value",
        "delivered_orders",
        "cancelled_orders",
    ]
    return preagg.select(
        "tenant_id",
        "group_key",
        "period_start",
        "period_end",
        F.to_json(F.struct(*body)).alias("metrics"),
        "last_updated",
    )


def preagg_sales(preagg: DataFrame, start=None, end=None, granularity: str | None = None) -> DataFrame:
    """Stored metrics added up per group key for periods that overlap the request.

    Day and hour keys come back together unless ``granularity`` picks one.
    """
    if start is not None:
        preagg = preagg.filter(F.col("period_end") >= F.to_date(at(start)))
    if end is not None:
        preagg = preagg.filter(F.col("period_start") <= F.to_date(at(end)))
    if granularity is not None:
        preagg = preagg.filter(F.col("group_key").startswith(f"{granularity}:"))
    return preagg.groupBy("tenant_id", "group_key").agg(
        F.sum(F.coalesce("sum_sales", F.lit(0.0))).alias("sum_sales"),
        F.sum(F.coalesce("num_orders", F.lit(0))).alias("num_orders"),
        F.sum(F.coalesce("unique_customers_est", F.lit(0))).alias("unique_customers_est"),
    )


def _has_null(column: str) -> Column:
    return F.max(F.when(F.col(column).isNull(), 1).otherwise(0)).cast("bigint")


def _sales(rows: DataFrame, value: str, *keys: Column, sketch: bool = False) -> DataFrame:
    """Sum, row count and customers per key. Orders without a customer count as one customer.

    A sketch lists the customers of a small group and takes its registers only for a large one, so that many groups stay small.
    """
    if sketch:
        customers = F.hll_sketch_estimate(F.hll_sketch_agg("customer_id", SKETCH_LG_K))
    else:
        customers = F.countDistinct("customer_id")
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum(value).alias("total"),
            F.count("*").alias("num_orders"),
            (customers + _has_null("customer_id")).alias("unique_customers_est"),
        )
        .withColumn("sum_sales", amount(F.col("total")))
        .drop("total")
    )


def period_key(grain: str) -> Column:
    key = hour_key(F.col("order_date")) if grain == "hour" else day_key(F.col("order_date"))
    return F.coalesce(key, F.lit("unknown"))


def sales_by_period(orders: DataFrame, grain: str, start=None, end=None, sketch: bool = False) -> DataFrame:
    """Sales per tenant and day or hour."""
    return _sales(
        inside(orders, start, end),
        "total_amount",
        F.col("tenant_id"),
        period_key(grain).alias("group_key"),
        sketch=sketch,
    )


def _sold(orders: DataFrame, items: DataFrame, start, end, basis: str) -> DataFrame:
    if basis not in ("order_total", "line_total"):
        raise ValueError(f"unknown basis: {basis}")
    placed = inside(orders, start, end).select("order_id", "tenant_id", "customer_id", "total_amount")
    on = ["order_id", "tenant_id"] if "tenant_id" in items.columns else ["order_id"]
    return items.join(placed, on).withColumn(
        "sold", F.col("total_amount") if basis == "order_total" else F.col("line_total")
    )


def sales_by_product(
    orders: DataFrame, items: DataFrame, start=None, end=None, *, basis: str = "order_total", sketch=False
) -> DataFrame:
    """Sales per tenant and product, one count per item row.

    The default basis adds the whole order total for every item of it; ``line_total`` adds the
    item's own value.
    """
    rows = _sold(orders, items, start, end, basis)
    key = F.col("product_id").cast("string").alias("group_key")
    return _sales(rows, "sold", F.col("tenant_id"), key, sketch=sketch)


def sales_by_category(
    orders: DataFrame, items: DataFrame, products: DataFrame, start=None, end=None, *, basis="order_total", sketch=False
) -> DataFrame:
    """As ``sales_by_product`` by the product's category; items without one are left out."""
    category = products.filter(F.col("category_id").isNotNull()).select("product_id", "category_id")
    rows = _sold(orders, items.join(category, "product_id"), start, end, basis)
    key = F.col("category_id").cast("string").alias("group_key")
    return _sales(rows, "sold", F.col("tenant_id"), key, sketch=sketch)


def customer_sketches(orders: DataFrame, grain: str = "day") -> DataFrame:
    """Mergeable distinct-customer sketches per tenant and period, next to exact sums."""
    return orders.groupBy("tenant_id", period_key(grain).alias("group_key")).agg(
        F.sum("total_amount").alias("total"),
        F.count("*").alias("num_orders"),
        F.hll_sketch_agg("customer_id", SKETCH_LG_K).alias("customers"),
        _has_null("customer_id").alias("has_unknown"),
    )


def merge_sketches(sketches: DataFrame, *keys: Column) -> DataFrame:
    """Coarser metrics from stored sketches: distinct customers merge instead of adding up."""
    return (
        sketches.groupBy(*keys)
        .agg(
            F.sum("total").alias("total"),
            F.sum("num_orders").alias("num_orders"),
            F.hll_union_agg("customers").alias("customers"),
            F.max("has_unknown").alias("has_unknown"),
        )
        .withColumn("sum_sales", amount(F.col("total")))
        .withColumn(
            "unique_customers_est", F.hll_sketch_estimate("customers") + F.col("has_unknown")
        )
        .drop("total", "customers", "has_unknown")
    )


def parse_moment(text: str | None) -> dt.datetime | None:
    """A request parameter as a moment: ISO datetime, ISO date or day-first date, else None."""
    if not text:
        return None
    for read in (dt.datetime.fromisoformat, lambda t: dt.datetime.strptime(t, "%d-%m-%Y")):
        try:
            return read(text).replace(tzinfo=None)
        except ValueError:
            continue
    return None


@dataclass(frozen=True)
class SalesAnswer:
    """A metrics answer: the data and how it was obtained."""

    data: DataFrame
    method: str
    error_bounds: str | None

    def labelled(self) -> DataFrame:
        return self.data.withColumn("method", F.lit(self.method)).withColumn(
            "error_bounds", F.lit(self.error_bounds).cast("string")
        )


def sales_metrics(
    group_by: str = "day",
    precision: str = "approx",
    start_date: str | None = None,
    end_date: str | None = None,
    *,
    orders: DataFrame,
    items: DataFrame | None = None,
    products: DataFrame | None = None,
    preagg: DataFrame | None = None,
) -> SalesAnswer:
    """Answer a metrics request from the pre-aggregates, an exact scan, or a sketching scan."""
    group_by, precision = (group_by or "day").lower(), (precision or "approx").lower()
    if group_by not in GROUPINGS:
        raise ValueError("invalid group_by")
    start, end = parse_moment(start_date), parse_moment(end_date)
    if group_by in ("day", "hour") and precision == "approx":
        return SalesAnswer(preagg_sales(preagg, start, end), METHOD_PREAGG, BOUND_PREAGG)

    sketch = precision == "approx"
    if group_by == "product":
        data = sales_by_product(orders, items, start, end, sketch=sketch)
    elif group_by == "category":
        data = sales_by_category(orders, items, products, start, end, sketch=sketch)
    else:
        data = sales_by_period(orders, group_by, start, end)
    method = METHOD_EXACT if precision == "exact" else METHOD_SKETCH
    return SalesAnswer(data, method, BOUND_SKETCH if sketch else None)
