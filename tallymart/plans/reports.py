"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.operators import quality, reports
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.plans.demo import AS_OF_EVENTS, AS_OF_ORDERS
from tallymart.session import fresh_dir

_DAILY = """
select tenant_id, cast(order_date as date) as order_day, count(*) as total_orders,
       cast(sum(total_amount) as double) as daily_revenue,
       cast(sum(total_amount) as double) / count(*) as avg_order_value,
       count(distinct customer_id) as unique_customers,
       count(*) filter (where order_status = 'delivered') as delivered_orders,
       count(*) filter (where order_status = 'cancelled') as cancelled_orders
from d_orders {where} group by 1, 2 order by order_day desc, tenant_id"""

_SINCE_30 = f"order_date >= timestamp '{AS_OF_ORDERS}' - interval 30 day"
_SINCE_90 = f"order_date >= timestamp '{AS_OF_ORDERS}' - interval 90 day"


@query("daily_order_analytics", "d_orders", _DAILY.format(where=f"where {_SINCE_30}"))
def _(spark, sf):
    return reports.daily_order_analytics(demo.orders(spark, sf), AS_OF_ORDERS)


@query("daily_order_analytics_history", "d_orders", _DAILY.format(where=""))
def _(spark, sf):
    return reports.daily_order_analytics(demo.orders(spark, sf), AS_OF_ORDERS, days=None)


@query(
    "daily_trend",
    "d_orders",
    f"""select cast(order_date as date) as order_day, count(*) as order_count,
               cast(sum(total_amount) as double) as daily_revenue,
               cast(sum(total_amount) as double) / count(*) as avg_order_value
        from d_orders where {_SINCE_30} and order_status <> 'cancelled' group by 1 order by 1""",
)
def _(spark, sf):
    return reports.daily_trend(demo.orders(spark, sf), AS_OF_ORDERS)


@query(
    "tenant_daily_metrics",
    "d_orders",
    """select tenant_id, cast(order_date as date) as metric_date, count(*) as order_count,
              cast(sum(total_amount) as double) as total_revenue,
              cast(sum(total_amount) as double) / count(*) as avg_order_value,
              count(distinct customer_id) as unique_customers
       from d_orders where order_status in ('delivered', 'shipped') group by 1, 2""",
)
def _(spark, sf):
    return reports.tenant_daily_metrics(demo.orders(spark, sf))


@query(
    "tenant_daily_refresh",
    "d_orders",
    """select tenant_id, cast(order_date as date) as metric_date, count(*) as order_count,
              cast(sum(total_amount) as double) as total_revenue,
              cast(sum(total_amount) as double) / count(*) as avg_order_value,
              count(distinct customer_id) as unique_customers
       from d_orders where order_status in ('delivered', 'shipped') and order_id % 11 <> 0 group by 1, 2""",
)
def _(spark, sf):
    """The stored table after two loads: late orders come in, and some that were delivered are cancelled."""
    folder = fresh_dir(spark, "daily")
    orders = demo.orders(spark, sf)
    first = orders.filter(F.col("order_id") % 5 != 0)
    reports.refresh_daily(first, first, folder, "month")
    status = F.when(F.col("order_id") % 11 == 0, "cancelled").otherwise(F.col("order_status"))
    now = orders.withColumn("order_status", status)
    changed = orders.filter((F.col("order_id") % 5 == 0) | (F.col("order_id") % 11 == 0))
    reports.refresh_daily(now, changed, folder, "month")
    return reports.stored_daily(spark, folder)


@query(
    "tenant_rollup",
    "d_tenants d_orders",
    f"""select t.tenant_id, t.name as tenant_name, count(o.order_id) as total_orders,
               cast(sum(o.total_amount) as double) as total_revenue,
               cast(sum(o.total_amount) as double) / nullif(count(o.order_id), 0) as avg_order_value,
               count(distinct o.customer_id) as unique_customers
        from d_tenants t left join d_orders o on t.tenant_id = o.tenant_id and {_SINCE_30}
        group by t.tenant_id, t.name""",
)
def _(spark, sf):
    return reports.tenant_rollup(demo.tenants(spark, sf), demo.orders(spark, sf), AS_OF_ORDERS)


_SOLD = """select product_id, count(*) as times, sum(quantity) as units, sum(line_total) as revenue, sum(unit_price) as prices,
       count(distinct order_id) as orders
    from d_order_items
    where order_id in (select o.order_id from d_orders o where o.order_status in ('delivered', 'shipped') {window})
    group by product_id"""

_TOP = f"""
sold as ({_SOLD}), ranked as (
    select tenant_id, product_id, sku, name, cast(price as double) as price, times as times_ordered,
           cast(units as bigint) as total_quantity_sold, cast(revenue as double) as total_revenue,
           cast(prices as double) / times as avg_selling_price
    from sold join d_products using (product_id))
select * from ranked {{pick}}"""

_PER_TENANT = "qualify row_number() over (partition by tenant_id order by total_revenue desc, product_id) <= 20"


def _top(window: str, pick: str) -> str:
    views = ", ".join(f"{n} as ({demo.VIEWS[n]})" for n in ("d_products", "d_order_items", "d_orders"))
    return f"with {views}, " + _TOP.format(window=window, pick=pick)


def _sales(spark, sf):
    return demo.products(spark, sf), demo.order_items(spark, sf), demo.orders(spark, sf)


@query("top_products", sql=_top(f"and {_SINCE_90}", _PER_TENANT))
def _(spark, sf):
    return reports.top_products(*_sales(spark, sf), AS_OF_ORDERS)


@query("top_products_history", sql=_top("", _PER_TENANT))
def _(spark, sf):
    return reports.top_products(*_sales(spark, sf), AS_OF_ORDERS, days=None)


@query("top_products_global", sql=_top(f"and {_SINCE_90}", "order by total_revenue desc, product_id limit 20"))
def _(spark, sf):
    return reports.top_products(*_sales(spark, sf), AS_OF_ORDERS, per_tenant=False)


@query(
    "low_stock",
    "d_products d_stock_levels",
    f"""select tenant_id, product_id, sku, name, available, last_updated,
               if(available = 0, 'Out of Stock', 'Low Stock') as stock_status,
               cast(floor(epoch(timestamp '{AS_OF_EVENTS}' - last_updated) / 86400) as int) as days_since_update
        from (select product_id, available, last_updated from d_stock_levels where available between 0 and 10) scarce
        join d_products using (product_id) where active""",
)
def _(spark, sf):
    return reports.low_stock(demo.products(spark, sf), demo.stock_levels(spark, sf), AS_OF_EVENTS)


_TURNOVER = f"""
select tenant_id, product_id, sku, name, cast(units as bigint) as total_sold, cast(revenue as double) as total_revenue,
       orders as order_count, available, ratio as turnover_ratio,
       case when coalesce(ratio, 0) <= 0.5 then 'Slow Moving' when ratio <= 1 then 'Low Turnover'
            when ratio <= 2 then 'Medium Turnover' else 'High Turnover' end as turnover_category
from (select *, cast(units as double) / nullif(greatest(available, 0), 0) as ratio
      from ({_SOLD}) sold join d_products using (product_id) left join d_stock_levels using (product_id)) t"""


@query(
    "inventory_turnover",
    "d_products d_order_items d_orders d_stock_levels",
    _TURNOVER.format(window=f"and {_SINCE_90}"),
)
def _(spark, sf):
    return reports.inventory_turnover(*_sales(spark, sf), demo.stock_levels(spark, sf), AS_OF_ORDERS)


@query(
    "inventory_turnover_history",
    "d_products d_order_items d_orders d_stock_levels",
    _TURNOVER.format(window=""),
)
def _(spark, sf):
    return reports.inventory_turnover(*_sales(spark, sf), demo.stock_levels(spark, sf), AS_OF_ORDERS, days=None)


@query(
    "customer_segments",
    "d_customers d_orders",
    """select c.customer_id, c.tenant_id, c.name, c.email, coalesce(n, 0) as total_orders, cast(paid as double) as total_spent,
              cast(paid as double) / n as avg_order_value, latest as last_order_date,
              case when coalesce(paid, 0) < 500 then 'Low Value' when paid < 1000 then 'Medium Value' else 'High Value' end
                  as customer_segment
       from d_customers c
       left join (select customer_id, count(*) as n, sum(total_amount) as paid, max(order_date) as latest from d_orders
                  where order_status is distinct from 'cancelled' group by 1) spent using (customer_id)
       where n is not null or not exists (select 1 from d_orders any_order where any_order.customer_id = c.customer_id)""",
)
def _(spark, sf):
    return reports.customer_segments(demo.customers(spark, sf), demo.orders(spark, sf))


@query(
    "order_totals",
    "d_order_items",
    """select order_id, count(*) as items, cast(sum(quantity * unit_price) as double) as computed_total,
              cast(sum(coalesce(nullif(line_total, 0), cast(quantity * unit_price as decimal(12,2)))) as double)
                  as line_total
       from d_order_items group by order_id""",
)
def _(spark, sf):
    return reports.order_totals(demo.order_items(spark, sf))


@query(
    "order_customer_lookup",
    "d_orders d_customers",
    """select o.order_id, o.tenant_id, o.customer_id, c.name as customer_name, c.email as customer_email
       from d_orders o left join d_customers c on o.customer_id = c.customer_id""",
)
def _(spark, sf):
    orders = demo.orders(spark, sf).select("order_id", "tenant_id", "customer_id")
    return reports.with_customer(orders, demo.customers(spark, sf))


@query(
    "item_product_lookup",
    "d_order_items d_products",
    """select i.order_id, i.product_id, i.quantity, p.name as product_name,
              cast(p.price as double) as product_price
       from d_order_items i left join d_products p on i.product_id = p.product_id""",
)
def _(spark, sf):
    items = demo.order_items(spark, sf).select("order_id", "product_id", "quantity")
    found = reports.with_product(items, demo.products(spark, sf))
    return found.withColumn("product_price", found.product_price.cast("double"))


@query(
    "dq_missing_customer",
    "d_orders",
    """select order_id, external_order_id, customer_id, customer_name_snapshot, customer_email_snapshot, order_date
       from d_orders
       where customer_name_snapshot is null or customer_email_snapshot is null""",
)
def _(spark, sf):
    return quality.missing_customer(demo.orders(spark, sf))
