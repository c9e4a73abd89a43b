"""Sales metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.operators import metrics
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.plans.demo import AS_OF_ORDERS

_SUMMARY = """count(*) as total_orders, cast(sum(total_amount) as double) as {revenue},
       cast(sum(total_amount) as double) / count(*) as avg_order_value,
       count(distinct customer_id) as unique_customers,
       count(*) filter (where order_status = 'delivered') as delivered_orders,
       count(*) filter (where order_status = 'cancelled') as cancelled_orders"""


@query(
    "hourly_metrics",
    "d_orders",
    f"""select tenant_id, date_trunc('hour', order_date) as order_hour, {_SUMMARY.format(revenue="hourly_revenue")}
        from d_orders group by 1, 2""",
)
def _(spark, sf):
    """Backfill of every hour; the timer passes the last hour instead."""
    return metrics.hourly_metrics(demo.orders(spark, sf))


_SALES = """cast(sum({value}) as double) as sum_sales, count(*) as num_orders,
       count(distinct customer_id) + max(case when customer_id is null then 1 else 0 end) as unique_customers_est"""


def _by_period(fmt: str) -> str:
    return f"""select tenant_id, coalesce(strftime(order_date, '{fmt}'), 'unknown') as group_key,
                      {_SALES.format(value="total_amount")}
               from d_orders group by 1, 2"""


@query("sales_by_day", "d_orders", _by_period("%Y-%m-%d"))
def _(spark, sf):
    return metrics.sales_by_period(demo.orders(spark, sf), "day")


@query("sales_by_hour", "d_orders", _by_period("%Y-%m-%dT%H:00:00"))
def _(spark, sf):
    return metrics.sales_by_period(demo.orders(spark, sf), "hour")


def _by_product(value: str) -> str:
    return f"""select o.tenant_id, cast(i.product_id as varchar) as group_key, {_SALES.format(value=value)}
               from d_order_items i join d_orders o on i.order_id = o.order_id group by 1, 2"""


_BY_CATEGORY = f"""
select o.tenant_id, p.category_id as group_key, {_SALES.format(value="o.total_amount")}
from d_order_items i join d_orders o on i.order_id = o.order_id join d_products p on i.product_id = p.product_id
where p.category_id is not null group by 1, 2"""


@query("sales_by_product", "d_orders d_order_items", _by_product("o.total_amount"))
def _(spark, sf):
    return metrics.sales_by_product(demo.orders(spark, sf), demo.order_items(spark, sf))


@query("sales_by_product_line_total", "d_orders d_order_items", _by_product("i.line_total"))
def _(spark, sf):
    return metrics.sales_by_product(demo.orders(spark, sf), demo.order_items(spark, sf), basis="line_total")


@query("sales_by_category", "d_orders d_order_items d_products", _BY_CATEGORY)
def _(spark, sf):
    return metrics.sales_by_category(
        demo.orders(spark, sf), demo.order_items(spark, sf), demo.products(spark, sf)
    )


@query(
    "sales_router_exact",
    "d_orders d_order_items d_products",
    f"""select *, 'exact-scan' as method, cast(null as varchar) as error_bounds from (
        select o.tenant_id, p.category_id as group_key, {_SALES.format(value="o.total_amount")}
        from d_order_items i join d_orders o on i.order_id = o.order_id
        join d_products p on i.product_id = p.product_id
        where p.category_id is not null and order_date >= timestamp '1996-02-01 00:00:00'
          and order_date <= timestamp '2000-12-31 00:00:00' group by 1, 2) t""",
)
def _(spark, sf):
    return metrics.sales_metrics(
        "category",
        "exact",
        "01-02-1996",
        "2000-12-31",
        orders=demo.orders(spark, sf),
        items=demo.order_items(spark, sf),
        products=demo.products(spark, sf),
    ).labelled()


def _within(estimated, exact):
    """Whether an estimate is within four standard errors of a sketch of 2^12 registers, or off by one at most."""
    return F.abs(estimated - exact) <= F.greatest(F.lit(1.0), exact * F.lit(4 * 1.04 / 64))


@query(
    "sales_router_sketch",
    "d_orders d_order_items",
    f"""select tenant_id, group_key, sum_sales, num_orders, true as within_bound from ({_by_product("o.total_amount")}) t""",
)
def _(spark, sf):
    """Sums are exact; distinct customers are estimated, and held against the exact count."""
    given = {"orders": demo.orders(spark, sf), "items": demo.order_items(spark, sf)}
    rough = metrics.sales_metrics("product", "approx", **given).labelled()
    exact = metrics.sales_metrics("product", "exact", **given).data.select("tenant_id", "group_key", F.col("unique_customers_est").alias("exact"))
    return rough.join(exact, ["tenant_id", "group_key"]).select("tenant_id", "group_key", "sum_sales", "num_orders", _within(F.col("unique_customers_est"), F.col("exact")).alias("within_bound"))


_SKETCHED = """select tenant_id, {key}, cast(sum(total_amount) as double) as sum_sales, count(*) as num_orders, true as within_bound
               from d_orders group by 1, 2"""


def _held(spark, sf, key, name: str):
    """Merged day sketches with their exact columns, and whether the estimate is within the bound."""
    orders = demo.orders(spark, sf)
    sketches = metrics.customer_sketches(orders)
    rough = metrics.merge_sketches(sketches, F.col("tenant_id"), key.alias(name))
    day = F.date_format("order_date", "yyyy-MM-dd").alias("group_key")
    counted = orders.select("tenant_id", day, "customer_id").withColumn(name, key)
    unknown = F.max(F.col("customer_id").isNull().cast("int"))
    exact = counted.groupBy("tenant_id", name).agg((F.countDistinct("customer_id") + unknown).alias("exact"))
    held = rough.join(exact, ["tenant_id", name])
    return held.select("tenant_id", name, "sum_sales", "num_orders", _within(F.col("unique_customers_est"), F.col("exact")).alias("within_bound"))


@query("sales_by_day_hll", "d_orders", _SKETCHED.format(key="strftime(order_date, '%Y-%m-%d') as group_key"))
def _(spark, sf):
    return _held(spark, sf, F.col("group_key"), "group_key")


@query("sales_by_month_hll", "d_orders", _SKETCHED.format(key="strftime(order_date, '%Y-%m') as month"))
def _(spark, sf):
    """Months from the stored day sketches, without going back to the orders."""
    return _held(spark, sf, F.substring("group_key", 1, 7), "month")


def _preagg(grain: str, since: str | None, as_of: str, where: str = "") -> str:
    bucket, label = {
        "day": ("cast(order_date as date)", "concat('day:', strftime(b, '%Y-%m-%d'))"),
        "hour": ("date_trunc('hour', order_date)", "concat('hour:', strftime(b, '%Y-%m-%dT%H:00:00'))"),
    }[grain]
    since_sql = f"where order_date >= timestamp '{since}'" if since else ""
    return f"""select tenant_id, {label} as group_key, cast(b as date) as period_start, cast(b as date) as period_end,
                      hourly_revenue as sum_sales, total_orders as num_orders,
                      unique_customers as unique_customers_est, avg_order_value, delivered_orders, cancelled_orders,
                      timestamp '{as_of}' as last_updated
               from (select tenant_id, {bucket} as b, {_SUMMARY.format(revenue="hourly_revenue")}
                     from d_orders {since_sql} group by 1, 2) t"""


@query("daily_metrics", "d_orders", _preagg("day", None, AS_OF_ORDERS))
def _(spark, sf):
    """Backfill of the daily timer over all days."""
    return metrics.preaggregate(demo.orders(spark, sf), "day", AS_OF_ORDERS)


_FIRST_RUN = "2001-07-31 12:00:00"
_SLIDING = "2001-08-01 00:00:00"  # AS_OF_ORDERS less one day


@query(
    "metrics_upsert",
    "d_orders",
    f"""select * from ({_preagg("day", None, _FIRST_RUN)}) old
        where not exists (select 1 from ({_preagg("day", _SLIDING, AS_OF_ORDERS)}) new
                          where new.tenant_id = old.tenant_id and new.group_key = old.group_key)
        union all {_preagg("day", _SLIDING, AS_OF_ORDERS)}""",
)
def _(spark, sf):
    orders = demo.orders(spark, sf)
    stored = metrics.preaggregate(orders, "day", _FIRST_RUN)
    return metrics.refresh_preaggregates(stored, orders, "day", AS_OF_ORDERS)


@query(
    "metrics_preagg_read",
    "d_orders",
    f"""select tenant_id, group_key, sum(sum_sales) as sum_sales, cast(sum(num_orders) as bigint) as num_orders,
               cast(sum(unique_customers_est) as bigint) as unique_customers_est
        from ({_preagg("day", None, AS_OF_ORDERS)} union all {_preagg("hour", None, AS_OF_ORDERS)}) t
        where period_end >= date '1996-01-01' and period_start <= date '2000-12-31' group by 1, 2""",
)
def _(spark, sf):
    orders = demo.orders(spark, sf)
    stored = metrics.preaggregate(orders, "day", AS_OF_ORDERS).unionByName(
        metrics.preaggregate(orders, "hour", AS_OF_ORDERS)
    )
    return metrics.sales_metrics(
        "day", "approx", "1996-01-01", "2000-12-31T23:59:59", orders=orders, preagg=stored
    ).data
