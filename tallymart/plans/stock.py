"""Stock queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.operators import stock
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.session import fresh_dir
from tallymart.sources import files
from tallymart.sources.export import write_chunks

_SUMMARY = """
select e.product_id, p.tenant_id, e.events_processed, e.events_applied, l.available as final_level,
       e.last_updated,
       case when p.product_id is null then 'product not found'
            when e.bad then 'processing error: delta is not an integer' end as reason
from (select product_id, count(*) as events_processed,
             count(*) filter (where delta <> 0 and not bad_delta) as events_applied,
             max(event_time) as last_updated, bool_or(bad_delta) as bad
      from d_stock_events group by product_id) e
left join d_products p on e.product_id = p.product_id
left join d_stock_levels l on e.product_id = l.product_id"""


def _fold(spark, sf):
    return stock.fold(demo.stock_events(spark, sf), demo.products(spark, sf), block=demo.stock_blocks())


@query(
    "stock_fold",
    "d_stock_fold d_products",
    """select f.seq, f.product_id, p.tenant_id, f.delta, f.level as resulting_level, f.event_time
       from d_stock_fold f join d_products p on f.product_id = p.product_id where f.delta <> 0""",
)
def _(spark, sf):
    return stock.applied_events(_fold(spark, sf))


@query(
    "stock_batch_summary",
    "d_stock_events d_products d_stock_levels",
    f"select product_id, tenant_id, events_processed, events_applied, final_level from ({_SUMMARY}) s "
    "where reason is null",
)
def _(spark, sf):
    per_product = stock.product_summary(_fold(spark, sf)).filter(F.col("reason").isNull())
    return per_product.drop("reason", "last_updated")


@query(
    "stock_batch_total",
    "d_stock_events d_products d_stock_levels",
    f"""select case when count(*) filter (where reason is not null) > 0 then 'partial_success' else 'success' end
                 as status,
               count(*) filter (where reason is null) as applied_products,
               count(*) filter (where reason is not null) as conflicts,
               cast(sum(events_applied) filter (where reason is null) as bigint) as total_events_processed
        from ({_SUMMARY}) s""",
)
def _(spark, sf):
    return stock.batch_summary(_fold(spark, sf))


@query(
    "stock_conflicts",
    "d_stock_events d_products d_stock_levels",
    f"select product_id, reason, events_processed from ({_SUMMARY}) s where reason is not null",
)
def _(spark, sf):
    return stock.conflicts(_fold(spark, sf))


_INITIAL = "select product_id, tenant_id, cast(product_id % 300 as bigint) as available, timestamp '2024-01-01' as last_updated from d_products"


@query(
    "stock_levels_after",
    "d_stock_sums d_products",
    f"""with_start as (
            select s.product_id, i.tenant_id, s.seq, s.event_time,
                   s.s + greatest(i.available, -min(s.s) over (partition by s.product_id order by s.seq)) as level
            from d_stock_sums s join ({_INITIAL}) i on s.product_id = i.product_id)
        select product_id, tenant_id, cast(arg_max(level, seq) as bigint) as available,
               max(event_time) as last_updated
        from with_start group by product_id, tenant_id
        union all
        select product_id, tenant_id, available, last_updated from ({_INITIAL}) i
        where product_id not in (select product_id from with_start)""".replace("with_start as", ", with_start as", 1),
)
def _(spark, sf):
    """The whole levels table after the batch, from a stocked start."""
    products = demo.products(spark, sf)
    start = products.select(
        "product_id",
        F.col("tenant_id"),
        (F.col("product_id") % 300).alias("available"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_updated"),
    )
    fold = stock.fold(demo.stock_events(spark, sf), products, block=demo.stock_blocks(), levels=start)
    return stock.merge_levels(start, stock.final_levels(fold))


_RECORDED = """
    select seq as stock_event_id, product_id, event_time,
           case when seq % 5 = 0 then null else level end as resulting_level
    from d_stock_fold where delta <> 0"""


def _refresh(zero_keeps: bool) -> str:
    usable = "resulting_level is not null" + (" and resulting_level <> 0" if zero_keeps else "")
    return f"""
    , seen as (select * from ({_RECORDED}) r where event_time >= timestamp '2024-01-20 00:00:00'),
      best as (select product_id, arg_max(resulting_level, (event_time, stock_event_id)) as lvl,
                      max(event_time) as at
               from seen where {usable} group by product_id),
      newest as (select s.product_id, b.lvl, coalesce(b.at, max(s.event_time)) as at
                 from seen s left join best b on s.product_id = b.product_id group by s.product_id, b.lvl, b.at),
      held as (select * from ({_INITIAL}) i where product_id % 3 <> 0)
    select coalesce(h.product_id, n.product_id) as product_id,
           coalesce(h.tenant_id, n.product_id % 10) as tenant_id,
           cast(coalesce(n.lvl, h.available, 0) as bigint) as available,
           coalesce(n.at, h.last_updated) as last_updated
    from held h full outer join newest n on h.product_id = n.product_id"""


def _refresh_inputs(spark, sf):
    products = demo.products(spark, sf)
    recorded = stock.applied_events(_fold(spark, sf)).select(
        F.col("seq").alias("stock_event_id"),
        "tenant_id",
        "product_id",
        "event_time",
        F.when(F.col("seq") % 5 != 0, F.col("resulting_level")).alias("resulting_level"),
    )
    held = products.filter(F.col("product_id") % 3 != 0).select(
        "product_id",
        "tenant_id",
        (F.col("product_id") % 300).alias("available"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_updated"),
    )
    return held, recorded


@query("stock_refresh", "d_stock_fold d_products", _refresh(False))
def _(spark, sf):
    held, recorded = _refresh_inputs(spark, sf)
    return stock.refresh_levels(held, recorded, "2024-01-31 00:00:00", hours=11 * 24)


@query("stock_refresh_zero_keeps", "d_stock_fold d_products", _refresh(True))
def _(spark, sf):
    held, recorded = _refresh_inputs(spark, sf)
    return stock.refresh_levels(held, recorded, "2024-01-31 00:00:00", hours=11 * 24, zero_keeps=True)


def movement_lines(events):
    """Stock movements as upload lines; some are cut short, some name no product, some carry a bad delta."""
    seq, delta = F.col("seq"), F.col("delta")
    body = F.concat(
        F.lit('{"product_id":'),
        F.when(seq % 31 == 0, F.lit('""')).otherwise(F.concat(F.lit('"'), F.col("product_id").cast("string"), F.lit('"'))),
        F.when(delta.isNull(), F.lit(',"delta":"x"'))
        .when(delta == 0, F.lit(""))
        .when(seq % 7 == 0, F.concat(F.lit(',"delta":"'), delta.cast("string"), F.lit('"')))
        .when(seq % 7 == 1, F.concat(F.lit(',"delta":'), delta.cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit(',"delta":'), delta.cast("string"))),
        F.concat(F.lit(',"event_time":"'), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"}')),
    )
    return events.select(F.when(seq % 37 == 0, F.substring(body, 1, 12)).otherwise(body).alias("value"))


@query(
    "stock_file_fold",
    "d_stock_events d_products",
    """, e as (select *, delta as d from d_stock_events where seq % 31 <> 0 and seq % 37 <> 0),
       a as (select e.*, p.tenant_id from e join d_products p on p.product_id = e.product_id
             where not exists (select 1 from e b where b.product_id = e.product_id and b.bad_delta)),
       s as (select *, sum(d) over (partition by product_id order by seq) as s from a)
       select * from (
           select cast(product_id as varchar) as product_id, tenant_id, d as delta, event_time, 'system' as source,
                  '{}' as meta,
                  cast(s + greatest(0, -min(s) over (partition by product_id order by seq)) as bigint)
                      as resulting_level
           from s) t where delta <> 0""",
)
def _(spark, sf):
    """The same movements by way of upload files, folded in file order."""
    folder = fresh_dir(spark, "movements")
    # File order is the sequence, so the lines are written sorted.
    events = demo.stock_events(spark, sf).orderBy("seq")
    write_chunks(movement_lines(events), f"{folder}/stock.ndjson")
    lines = files.records(files.scan_lines(spark, f"{folder}/stock.ndjson"))
    products = demo.products(spark, sf).withColumn("product_id", F.col("product_id").cast("string"))
    fold = stock.fold_lines(stock.from_lines(lines, demo.AS_OF_EVENTS), products)
    return stock.applied_events(fold).drop("file", "pos", "block")
