"""Search and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.operators import search
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.session import fresh_dir
from tallymart.sources import export

_SHOWN = """order_id, external_order_id, customer_id, customer_name_snapshot, customer_email_snapshot,
    cast(total_amount as double) as total_amount, currency, order_status, order_date"""
_NEWEST = "order by order_date desc, order_id desc"
PAGE = 100


def _shown(rows):
    return rows.select(search.DEFAULT_FIELDS).withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "search_text",
    "d_orders",
    f"""select {_SHOWN} from d_orders where contains(lower(customer_name_snapshot), 'r#00000001')
        or contains(lower(customer_email_snapshot), 'r#00000001')""",
)
def _(spark, sf):
    return _shown(search.find(demo.orders(spark, sf), q="R#00000001"))


@query(
    "search_text_literal",
    "d_orders",
    f"""select {_SHOWN} from d_orders where contains(lower(customer_name_snapshot), 'r.00000001')
        or contains(lower(customer_email_snapshot), 'r.00000001')""",
)
def _(spark, sf):
    """Punctuation is text, not a pattern: the dot finds e-mails but no names."""
    return _shown(search.find(demo.orders(spark, sf), q="R.00000001"))


@query(
    "search_filters",
    "d_orders",
    f"""select {_SHOWN} from d_orders
        where order_status in ('shipped', 'pending') and total_amount >= 50000.5 and total_amount <= 300000
          and order_date >= timestamp '1996-03-01 00:00:00' and order_date <= timestamp '2000-05-05 12:00:00'""",
)
def _(spark, sf):
    return _shown(
        search.find(
            demo.orders(spark, sf),
            statuses=" shipped, pending,",
            min_price="50000.5",
            max_price=300000,
            start_date="1996-03-01",
            end_date="2000-05-05T12:00:00",
        )
    )


@query(
    "search_by_products",
    "d_orders d_order_items",
    f"""select {_SHOWN} from d_orders
        where order_id in (select order_id from d_order_items where product_id in (1, 5, 8, 13, 21))""",
)
def _(spark, sf):
    return _shown(
        search.find(demo.orders(spark, sf), product_ids=[1, 5, 8, 13, 21], items=demo.order_items(spark, sf))
    )


@query(
    "search_projection",
    "d_orders",
    f"select currency, external_order_id from (select * from d_orders {_NEWEST} limit {search.DEFAULT_LIMIT}) t",
)
def _(spark, sf):
    """The default page, reduced to the asked fields."""
    return search.page(search.find(demo.orders(spark, sf)), fields=["currency", "external_order_id"])


@query("search_page1", "d_orders", f"select {_SHOWN} from d_orders where tenant_id = 7 {_NEWEST} limit {PAGE}")
def _(spark, sf):
    return _shown(search.page(search.find(demo.orders(spark, sf), tenant_id=7), limit=PAGE))


@query(
    "search_page2",
    "d_orders",
    f"select {_SHOWN} from d_orders where tenant_id = 7 {_NEWEST} limit {PAGE} offset {PAGE}",
)
def _(spark, sf):
    found = search.find(demo.orders(spark, sf), tenant_id=7)
    token = search.next_cursor(search.page(found, limit=PAGE, fields=["order_date", "order_id"]), PAGE)
    return _shown(search.page(found, limit=PAGE if token else 0, cursor=token))


_EXPORT = """select cast(order_id as varchar) as order_id, coalesce(cast(customer_id as varchar), 'None') as customer,
                    cast(total_amount as varchar) as total_amount,
                    strftime(order_date, '%Y-%m-%dT%H:%M:%S') as order_date
             from d_orders"""


@query("export_orders", "d_orders", _EXPORT)
def _(spark, sf):
    return export.export_rows(demo.orders(spark, sf))


def _written(fmt: str):
    def run(spark, sf):
        """Written to files and read back."""
        path = fresh_dir(spark, "export")
        export.export(export.export_rows(demo.orders(spark, sf)), path, fmt)
        return export.read_export(spark, path, fmt)

    return run


for _fmt in export.EXPORT_FORMATS:
    query(f"export_{_fmt}", "d_orders", _EXPORT)(_written(_fmt))


@query("export_resumed", "d_orders", _EXPORT)
def _(spark, sf):
    """Written in waves of ranges, ended early twice, and finished by a third call."""
    path = fresh_dir(spark, "export")
    rows = export.export_rows(demo.orders(spark, sf))
    for waves in (1, 2, None):
        export.export_ranges(rows, path, ranges=12, wave=3, waves=waves)
    return export.read_export(spark, f"{path}/data").drop("range")


@query("export_filtered", "d_orders", f"{_EXPORT} where order_status in ('pending', 'shipped') and tenant_id = 3")
def _(spark, sf):
    return export.export_rows(demo.orders(spark, sf), tenant_id=3, order_status=["pending", "shipped"])


@query(
    "export_manifest",
    "d_orders",
    "select 'completed' as status, 'parquet' as format, count(*) as rows, true as has_bytes from d_orders",
)
def _(spark, sf):
    """Job totals of a Parquet export; sizes depend on the writer, so only their presence is compared."""
    path = fresh_dir(spark, "export")
    rows = export.export(export.export_rows(demo.orders(spark, sf)), path, "parquet")
    return (
        export.manifest(spark, path, "parquet", rows)
        .groupBy("status", "format", "rows")
        .agg((F.sum("bytes") > 0).alias("has_bytes"))
    )


@query(
    "export_ndjson",
    "d_orders",
    """select concat('{"order_id":', cast(order_id as varchar), ',"customer_id":',
                     coalesce(cast(customer_id as varchar), 'null'), ',"currency":"', currency, '"}') as value
       from d_orders
       union all select concat('{"_meta":{"rows":', cast(count(*) as varchar), '}}') from d_orders""",
)
def _(spark, sf):
    rows = demo.orders(spark, sf).select("order_id", "customer_id", "currency")
    return export.ndjson(rows).unionByName(export.meta_line(rows.agg(F.count("*").alias("rows"))))
