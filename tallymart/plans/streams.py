"""Streams run over all available input; the results equal those of the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.plans import demo, ingestion
from tallymart.plans.catalog import query
from tallymart.session import fresh_dir
from tallymart.sources.export import write_chunks
from tallymart.sources.store import TableStore
from tallymart.streaming import ingest, metrics, prices, run, stock


def _arriving(spark, sf, name, size=64 << 30):
    """A test table as a stream of its files, be it one file or a folder."""
    path = f"{sf}/{name}.parquet"
    return run.arriving(spark, f"{path}*", spark.read.parquet(path).schema, size=size)


@query(
    "price_dedup_stream",
    "d_price_outcomes",
    """select tenant_id, idempotency_key, event_id, answered_by, status, error, received_at from d_price_outcomes""",
)
def _(spark, sf):
    """Requests answered as they arrive, against the keys and admissions of earlier micro-batches."""
    folder = fresh_dir(spark, "requests")
    requests = demo.price_requests(_arriving(spark, sf, "events"))
    run.each_batch(requests, prices.intake_into(folder, demo.products(spark, sf)), fresh_dir(spark, "checkpoint"))
    columns = ["tenant_id", "idempotency_key", "event_id", "answered_by", "status", "error", "received_at"]
    return prices.outcomes(spark, folder).select(columns)


@query(
    "anomaly_stream",
    "d_price_stored d_products",
    """select event_id, e.tenant_id, e.product_id, p.name as product_name, old_price, new_price, pct_change, anomaly_reason, source,
              replace(metadata, ' ', '') as metadata, received_at
       from d_price_stored e left join d_products p on p.tenant_id = e.tenant_id and p.product_id = e.product_id
       where anomaly_flag""",
)
def _(spark, sf):
    """Stored price events as a stream of files, joined to the products, written as JSON lines and read back."""
    folder, lines = fresh_dir(spark, "price_events"), fresh_dir(spark, "feed")
    stored = demo.stored_price_events(spark, sf)
    stored.write.parquet(folder)
    feed = prices.anomaly_feed(run.arriving(spark, folder, stored.schema), demo.products(spark, sf))
    run.to_table(prices.feed_lines(feed), lines, fresh_dir(spark, "checkpoint"), "text")
    return spark.read.schema(feed.schema).json(lines)


def _folded(spark, sf) -> TableStore:
    store = TableStore(spark, fresh_dir(spark, "stock"))
    movements = demo.stock_movements(_arriving(spark, sf, "events"))
    products = demo.products(spark, sf).select("product_id", "tenant_id")
    run.each_batch(movements, stock.apply_to(store, products, demo.stock_blocks), fresh_dir(spark, "checkpoint"))
    return store


@query(
    "stock_stream",
    "d_stock_fold d_products",
    """select cast(f.seq as varchar) as stock_event_id, cast(f.product_id as varchar) as product_id,
              cast(p.tenant_id as varchar) as tenant_id, f.delta, f.level as resulting_level, f.event_time,
              'system' as source, '{}' as meta
       from d_stock_fold f join d_products p on f.product_id = p.product_id where f.delta <> 0""",
)
def _(spark, sf):
    return _folded(spark, sf).log("stock_events")


@query(
    "stock_stream_levels",
    "d_stock_levels",
    "select cast(product_id as varchar) as product_id, available, last_updated from d_stock_levels",
)
def _(spark, sf):
    return _folded(spark, sf).read("stock_levels").drop("tenant_id")


@query(
    "hourly_stream",
    "d_orders",
    """select cast(tenant_id as varchar) as tenant_id, concat('hour:', strftime(h, '%Y-%m-%dT%H:00:00')) as group_key,
              cast(h as date) as period_start, cast(total as double) as sum_sales, num_orders,
              cast(total as double) / num_orders as avg_order_value, delivered_orders, cancelled_orders
       from (select tenant_id, date_trunc('hour', order_date) as h, sum(total_amount) as total,
                    count(*) as num_orders, count(*) filter (where order_status = 'delivered') as delivered_orders,
                    count(*) filter (where order_status = 'cancelled') as cancelled_orders
             from d_orders group by 1, 2) t""",
)
def _(spark, sf):
    """Shares of micro-batches, merged. The distinct-customer sketch is left out of the comparison."""
    folder = fresh_dir(spark, "metrics")
    orders = demo.placed_orders(_arriving(spark, sf, "orders"), demo.table(spark, sf, "customer"))
    run.each_batch(orders, metrics.add_to(folder), fresh_dir(spark, "checkpoint"))
    stored = metrics.read(spark, folder).withColumn("tenant_id", F.col("tenant_id").cast("string"))
    return stored.drop("unique_customers_est", "period_end", "last_updated")


@query(
    "ingest_stream",
    "d_orders d_customers d_products",
    " union all ".join([ingestion._CUSTOMER_CONTENT, ingestion._PRODUCT_CONTENT, ingestion._ORDER_CONTENT]),
)
def _(spark, sf):
    """Uploads of three types, one of them CSV, as they arrive; all rows of the tables."""
    folder = fresh_dir(spark, "arrivals")
    lines = ingestion.order_lines(demo.orders(spark, sf).orderBy("order_id")).select("value")
    write_chunks(lines, f"{folder}/orders_{ingestion.TENANT}.ndjson")
    lines = ingestion.customer_lines(demo.customers(spark, sf)).select("value")
    write_chunks(lines, f"{folder}/customers_{ingestion.TENANT}.ndjson")
    rows = ingestion.product_records(demo.products(spark, sf)).drop("line_key")
    write_chunks(rows, f"{folder}/products_{ingestion.TENANT}.csv", "csv", compress=True)
    store = TableStore(spark, fresh_dir(spark, "store"))
    handler = ingest.apply_to(store, ingestion.TENANT, ingestion.AS_OF)
    run.each_batch(ingest.arriving_lines(spark, folder), handler, fresh_dir(spark, "checkpoint"))
    return ingestion.content(store, "customers", "products", "orders")
