"""Price event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.operators import prices, reports
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.plans.demo import AS_OF_PRICES


def _outcomes(spark, sf):
    return prices.intake(demo.price_events(spark, sf), demo.products(spark, sf))


@query(
    "price_idempotent",
    "d_price_outcomes",
    """select event_id, tenant_id, idempotency_key, answered_by, status from d_price_outcomes where status <> 'rejected'""",
)
def _(spark, sf):
    """Stored requests and the replays that they answer."""
    answered = _outcomes(spark, sf).filter(F.col("status") != prices.REJECTED)
    return answered.select("event_id", "tenant_id", "idempotency_key", "answered_by", "status")


@query(
    "admit_tumbling",
    "d_price_events",
    """select event_id, tenant_id, product_id, received_at from (
           select * from d_price_events
           qualify row_number() over (partition by product_id, date_trunc('minute', received_at)
                                      order by received_at, event_id) <= 10) t
       qualify row_number() over (partition by tenant_id, date_trunc('minute', received_at)
                                  order by received_at, event_id) <= 100""",
)
def _(spark, sf):
    events = demo.price_events(spark, sf).select("event_id", "tenant_id", "product_id", "received_at")
    return prices.admit_per_minute(events)


@query(
    "price_events",
    "d_price_outcomes",
    """select event_id, tenant_id, product_id, received_at, status, error, answered_by,
              case when status = 'processed' then pct end as pct_change,
              status = 'processed' and class is not null as anomaly_flag,
              case when status = 'processed' and class is not null then reason end as anomaly_reason
       from d_price_outcomes""",
)
def _(spark, sf):
    kept = _outcomes(spark, sf).drop("idempotency_key", "old_price", "new_price", "source", "metadata")
    return kept.withColumn("pct_change", F.col("pct_change").cast("double"))


@query(
    "price_idempotency_records",
    "d_price_outcomes",
    """select tenant_id, idempotency_key, event_id, 'completed' as status, received_at as created_at,
              received_at + interval 24 hour as expires_at,
              concat('{"event_id":', event_id, ',"anomaly_flag":', class is not null,
                     case when class is null then '' else ',"anomaly_reason":"' || reason || '"' end,
                     ',"status":"processed"}') as response_summary,
              sha256(concat('{', coalesce('"metadata":' || replace(metadata, ' ', '') || ',', ''),
                            '"new_price":', cast(cast(new_cents / 100 as decimal(10,2)) as varchar),
                            ',"old_price":', cast(cast(old_cents / 100 as decimal(10,2)) as varchar),
                            coalesce(',"source":"' || source || '"', ''), '}')) as request_hash
       from d_price_outcomes where status = 'processed'""",
)
def _(spark, sf):
    return prices.idempotency_records(_outcomes(spark, sf))


_CHANGES = f"""
select e.event_id, e.tenant_id, e.product_id, p.sku, p.name, e.old_price, e.new_price, e.pct_change,
       e.anomaly_flag, e.received_at,
       cast(floor((epoch_us(timestamp '{AS_OF_PRICES}') - epoch_us(e.received_at)) / 86400000000) as int)
           as days_since_change
from d_price_stored e join d_products p on e.product_id = p.product_id
where e.received_at >= timestamp '{AS_OF_PRICES}' - interval {{days}} day {{extra}}"""


@query("price_change_analysis", "d_price_stored d_products", _CHANGES.format(days=30, extra=""))
def _(spark, sf):
    return reports.price_change_analysis(
        demo.stored_price_events(spark, sf), demo.products(spark, sf), AS_OF_PRICES
    )


@query(
    "significant_price_changes",
    "d_price_stored d_products",
    _CHANGES.format(days=7, extra="and abs(e.pct_change) > 10"),
)
def _(spark, sf):
    return reports.price_change_analysis(
        demo.stored_price_events(spark, sf), demo.products(spark, sf), AS_OF_PRICES, days=7, min_abs_pct=10
    )


_WINDOW = f"anomaly_flag and received_at >= timestamp '{AS_OF_PRICES}' - interval 24 hour"


@query(
    "recent_anomalies",
    "d_price_stored d_products",
    f"""select event_id, e.tenant_id, e.product_id, p.name as product_name, old_price, new_price, pct_change, anomaly_reason,
               source, replace(metadata, ' ', '') as metadata, received_at
        from d_price_stored e left join d_products p on p.tenant_id = e.tenant_id and p.product_id = e.product_id
        where {_WINDOW}
        qualify row_number() over (partition by e.product_id order by received_at desc, event_id desc) <= 5""",
)
def _(spark, sf):
    return prices.recent_anomalies(demo.stored_price_events(spark, sf), demo.products(spark, sf), AS_OF_PRICES, limit=5)


@query(
    "anomaly_summary",
    "d_price_stored",
    f"""select tenant_id, product_id, count(*) as total_anomalies, cast(24 as int) as time_range_hours
        from d_price_stored where {_WINDOW} group by 1, 2""",
)
def _(spark, sf):
    return prices.anomaly_summary(demo.stored_price_events(spark, sf), AS_OF_PRICES)
