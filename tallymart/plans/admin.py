"""Maintenance, tenant and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymart.functions import dates, ids, money
from tallymart.operators import loading, maintenance, prices, quality, tenants
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.plans.demo import AS_OF_EVENTS, AS_OF_ORDERS, table
from tallymart.plans.ingestion import sql_uuid, uuid_of
from tallymart.session import fresh_dir
from tallymart.sources.export import write_chunks
from tallymart.sources.store import TableStore

CLEANUP_AT = "1998-01-01 00:00:00"


def _keys(spark, sf):
    """Idempotency keys recorded with each order, valid for a day."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(24))).alias("expires_at"),
    )


def _logs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at")
    )


@query(
    "retention_keys",
    sql=f"""select o_orderkey as id, o_orderdate as created_at, o_orderdate + interval 24 hour as expires_at
            from orders where o_orderdate + interval 24 hour >= timestamp '{CLEANUP_AT}'""",
)
def _(spark, sf):
    return maintenance.live_keys(_keys(spark, sf), CLEANUP_AT)


@query(
    "retention_logs",
    sql=f"""select event_id as id, event_type as action, ts as created_at from events
            where ts >= timestamp '{AS_OF_EVENTS}' - interval 10 day""",
)
def _(spark, sf):
    return maintenance.live_rows(_logs(spark, sf), "created_at", AS_OF_EVENTS, days=10)


@query(
    "retention_report",
    sql=f"""select (select count(*) from orders where o_orderdate + interval 24 hour < timestamp '{CLEANUP_AT}')
                       as expired_idempotency_keys,
                   (select count(*) from lineitem where l_shipdate < timestamp '{CLEANUP_AT}' - interval 90 day)
                       as expired_audit_logs""",
)
def _(spark, sf):
    logs = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("created_at"))
    return maintenance.cleanup_report(_keys(spark, sf), logs, CLEANUP_AT)


@query(
    "retention_staging",
    sql="""select event_id, ts from events where cast(ts as date) >= date '2024-01-20'""",
)
def _(spark, sf):
    """Staged rows by day of loading; days that ended over a day ago go as whole folders."""
    store = TableStore(spark, fresh_dir(spark, "store"))
    events = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("loaded"))
    events.repartition("loaded").write.partitionBy("loaded").parquet(f"{store.root}/_staging/kind=events")
    loading.drop_staging(store, "2024-01-21 06:00:00")
    return spark.read.parquet(f"{store.root}/_staging/kind=events").drop("loaded")


@query(
    "integrity_checks",
    sql="""with i as (select case when l_partkey % 97 = 0 then -l_partkey - 1 else l_partkey end as product_id,
                             case when l_orderkey % 89 = 0 then -l_orderkey - 1 else l_orderkey end as order_id
                      from lineitem)
           select 'orders_without_customer' as check_name, count(*) as dangling_rows,
                  count(distinct o_custkey) as dangling_values
           from orders where not exists (select 1 from customer where c_custkey = o_custkey)
           union all select 'items_without_product', count(*), count(distinct product_id) from i
           where not exists (select 1 from part where p_partkey = product_id)
           union all select 'items_without_order', count(*), count(distinct order_id) from i
           where not exists (select 1 from orders where o_orderkey = order_id)""",
)
def _(spark, sf):
    """Some references are broken on purpose."""
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    items = table(spark, sf, "lineitem").select(
        F.when(part % 97 == 0, -part - 1).otherwise(part).alias("product_id"),
        F.when(order % 89 == 0, -order - 1).otherwise(order).alias("order_id"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")
    )
    return quality.integrity_checks(orders, demo.customers(spark, sf), items, demo.products(spark, sf))


_COUNTED = ["nation", "customer", "part", "orders", "lineitem", "events"]


@query(
    "table_counts",
    sql=" union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in _COUNTED),
)
def _(spark, sf):
    return quality.table_counts({t: table(spark, sf, t) for t in _COUNTED})


_MONTHS = """select strftime(order_date, '%Y-%m') as order_month, count(*) as n,
                    cast(sum(total_amount) as double) as total
             from d_orders where strftime(order_date, '%Y-%m') between '1997-03' and '1999-08' group by 1"""


@query("orders_by_month", "d_orders", _MONTHS)
def _(spark, sf):
    """Written by month, then read with a filter that prunes to the asked months."""
    path = fresh_dir(spark, "by_month")
    maintenance.write_by_month(demo.orders(spark, sf).select("order_id", "order_date", "total_amount"), path)
    stored = spark.read.schema(
        "order_id bigint, order_date timestamp_ntz, total_amount decimal(12,2), order_month string"
    ).parquet(path)
    return (
        stored.filter(F.col("order_month").between("1997-03", "1999-08"))
        .groupBy("order_month")
        .agg(F.count("*").alias("n"), money.amount(F.sum("total_amount")).alias("total"))
    )


@query(
    "products_by_tenant_bucket",
    "d_products",
    "select tenant_id, count(*) as n, cast(sum(price) as double) as total from d_products where tenant_id = 4 group by 1",
)
def _(spark, sf):
    path = fresh_dir(spark, "by_tenant")
    maintenance.write_by_tenant(demo.products(spark, sf), path)
    wanted = F.lit(4).cast("bigint")
    stored = spark.read.parquet(path)
    return (
        stored.filter(F.col("tenant_bucket") == maintenance.tenant_bucket(wanted))
        .filter(F.col("tenant_id") == wanted)
        .groupBy("tenant_id")
        .agg(F.count("*").alias("n"), money.amount(F.sum("price")).alias("total"))
    )


@query(
    "orders_union_quarters",
    "d_orders",
    """select order_id, tenant_id, order_date from d_orders where order_date < timestamp '1997-01-01 00:00:00'
       union all select order_id, tenant_id, order_date from d_orders
       where order_date >= timestamp '1997-01-01 00:00:00'""",
)
def _(spark, sf):
    orders = demo.orders(spark, sf).select("order_id", "tenant_id", "order_date")
    cut = dates.at("1997-01-01 00:00:00")
    return maintenance.union_periods([orders.filter(orders.order_date < cut), orders.filter(orders.order_date >= cut)])


@query(
    "orders_by_source",
    "d_orders",
    """select regexp_extract(raw_payload, '"source":"([a-z]+)"', 1) as source, count(*) as n,
              cast(sum(total_amount) as double) as total from d_orders group by 1""",
)
def _(spark, sf):
    return (
        maintenance.with_source(demo.orders(spark, sf))
        .groupBy("source")
        .agg(F.count("*").alias("n"), money.amount(F.sum("total_amount")).alias("total"))
    )


def _tenant_files(spark, sf):
    """Suppliers as tenants: those of even nations are known, all of them are in the file."""
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("tenant_id"),
        F.col("s_name").alias("name"),
        ids.api_key_digest(F.concat(F.lit("api_key_"), F.col("s_suppkey").cast("string"))).alias("api_key_hash"),
        "s_nationkey",
    )
    known = rows.filter(F.col("s_nationkey") % 2 == 0).drop("s_nationkey")
    return known.withColumn("name", F.upper("name")), rows.drop("s_nationkey")


_FILE = """select cast(s_suppkey as varchar) as tenant_id, s_name as name,
                  sha256(concat('api_key_', cast(s_suppkey as varchar))) as api_key_hash, s_nationkey from supplier"""


@query(
    "tenant_load_plan",
    sql=f"""select tenant_id, name, api_key_hash,
                   case when s_nationkey % 2 = 0 then 'updated' else 'created' end as action from ({_FILE}) f""",
)
def _(spark, sf):
    return tenants.load_plan(*_tenant_files(spark, sf), overwrite=True)


@query(
    "tenant_load",
    sql=f"""select tenant_id, case when s_nationkey % 2 = 0 then upper(name) else name end as name, api_key_hash
            from ({_FILE}) f""",
)
def _(spark, sf):
    known, incoming = _tenant_files(spark, sf)
    return tenants.apply_plan(known, tenants.load_plan(known, incoming))


@query(
    "tenant_file_load",
    """d_customers""",
    f"""select pass, given_id, reason, case when reason is not null then 'error' when pass = 2 then 'updated'
               when known or nth > 1 then 'skipped' else 'created' end as outcome
        from (select *, row_number() over (partition by pass, given_id, reason is null order by customer_id) as nth from (
            select customer_id, tenant_id % 2 = 0 as known,
                   case when customer_id % 10 = 7 then 'no uuid' else {sql_uuid("tenant_id")} end as given_id,
                   case when customer_id % 10 = 7 then 'Invalid tenant_id format: no uuid'
                        when customer_id % 10 = 8 then 'Invalid created_at format: soon' end as reason
            from d_customers) f, (select unnest([1, 2])::bigint as pass) p) t""",
)
def _(spark, sf):
    """A file that names tenants again and again, some rows unreadable: first without, then with overwriting."""
    key = F.col("customer_id")
    rows = demo.customers(spark, sf).orderBy("customer_id").select(
        F.when(key % 10 == 7, "no uuid").otherwise(uuid_of(F.col("tenant_id"))).alias("tenant_id"),
        "name",
        ids.api_key_digest(F.col("name")).alias("api_key_hash"),
        F.when(key % 10 == 8, "soon").otherwise("2024-01-01T10:00:00").alias("created_at"),
    )
    folder = fresh_dir(spark, "tenants")
    write_chunks(rows.coalesce(1), f"{folder}/tenants.csv", "csv", records=0)
    known = demo.tenants(spark, sf).filter("tenant_id % 2 = 0").select(
        uuid_of(F.col("tenant_id")).alias("tenant_id"),
        "name",
        ids.api_key_digest(F.col("name")).alias("api_key_hash"),
        dates.at("2020-01-01 00:00:00").alias("created_at"),
    )
    found = tenants.read_file(spark, f"{folder}/tenants.csv")
    first, table_now = tenants.load_file(known, found)
    second, _ = tenants.load_file(table_now, found, overwrite=True)
    columns = ["given_id", "reason", "outcome"]
    return first.select(F.lit(1).cast("bigint").alias("pass"), *columns).unionByName(second.select(F.lit(2).cast("bigint").alias("pass"), *columns))


@query(
    "resolve_tenant",
    sql="""with t as (select n_nationkey as tenant_id, sha256(concat('api_key_', cast(n_nationkey as varchar))) as h
                      from nation),
                r as (select c_custkey as request_id,
                             case when c_custkey % 5 = 3 then (c_nationkey + 1) % 25 else c_nationkey end as tenant_id,
                             case c_custkey % 5 when 0 then concat('api_key_', cast(c_nationkey as varchar))
                                  when 1 then sha256(concat('api_key_', cast(c_nationkey as varchar)))
                                  when 2 then 'wrong' when 3 then concat('api_key_', cast(c_nationkey as varchar))
                                  else null end as api_key from customer)
           select r.request_id, r.tenant_id, r.api_key, t.tenant_id as key_tenant,
                  case when api_key is null then 'X-API-Key header required'
                       when t.tenant_id is null then 'Invalid API key'
                       when t.tenant_id <> r.tenant_id then 'Tenant ID mismatch' else 'ok' end as outcome
           from r left join t on t.h = r.api_key or t.h = sha256(r.api_key)""",
)
def _(spark, sf):
    """Customers as requests: raw keys, hashed keys, wrong keys, foreign tenants, no key."""
    key, home = F.col("c_custkey") % 5, F.col("c_nationkey")
    raw = F.concat(F.lit("api_key_"), home.cast("string"))
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(key == 3, (home + 1) % 25).otherwise(home).alias("tenant_id"),
        F.when(key.isin(0, 3), raw).when(key == 1, ids.api_key_digest(raw)).when(key == 2, "wrong").alias("api_key"),
    )
    held = demo.tenants(spark, sf).withColumn(
        "api_key_hash", ids.api_key_digest(F.concat(F.lit("api_key_"), F.col("tenant_id").cast("string")))
    )
    return tenants.resolve(requests, held)


@query(
    "scalar_dates",
    "d_orders",
    f""", t as (select order_id, order_date,
                          case order_id % 4 when 0 then strftime(order_date, '%Y-%m-%d')
                               when 1 then strftime(order_date, '%d-%m-%Y')
                               when 2 then strftime(order_date, '%Y-%m-%dT%H:%M:%S') else 'soon' end as text
                   from d_orders)
        select order_id, cast(order_date as date) as day, date_trunc('hour', order_date) as hour,
               strftime(order_date, '%Y-%m-%d') as day_key, strftime(order_date, '%Y-%m-%dT%H:00:00') as hour_key,
               cast(floor((epoch_us(timestamp '{AS_OF_ORDERS}') - epoch_us(order_date)) / 86400000000) as int) as age,
               timestamp '{AS_OF_ORDERS}' - interval 90 day as cutoff,
               case order_id % 4 when 2 then order_date when 3 then null
                    else cast(cast(order_date as date) as timestamp) end as parsed
        from t""",
)
def _(spark, sf):
    key, ts = F.col("order_id") % 4, F.col("order_date")
    text = (
        F.when(key == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(key == 1, F.date_format(ts, "dd-MM-yyyy"))
        .when(key == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("soon")
    )
    return demo.orders(spark, sf).select(
        "order_id",
        F.to_date(ts).alias("day"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"),
        dates.day_key(ts).alias("day_key"),
        dates.hour_key(ts).alias("hour_key"),
        dates.whole_days_between(AS_OF_ORDERS, ts).alias("age"),
        dates.before(AS_OF_ORDERS, days=90).alias("cutoff"),
        dates.parse_flexible(text).alias("parsed"),
    )


@query(
    "scalar_numeric",
    "d_price_classes d_price_events",
    """select e.event_id, case when c.e4 < 100000000 then c.pct end as pct_change,
              case when c.class is null then 'none' else trim(c.class, ': ') end as class,
              greatest(0, e.new_cents - e.old_cents) as raised_by
       from d_price_events e left join d_price_classes c on c.event_id = e.event_id""",
)
def _(spark, sf):
    events = prices.with_change(demo.price_events(spark, sf))
    raised = ((F.col("new_price") - F.col("old_price")) * 100).cast("bigint")
    return events.select(
        "event_id",
        F.col("pct_change").cast("double").alias("pct_change"),
        F.coalesce(F.substring_index("anomaly_reason", ":", 1), F.lit("none")).alias("class"),
        F.greatest(F.lit(0), raised).alias("raised_by"),
    )


@query(
    "scalar_text_ids",
    sql=r"""with t as (select c_custkey, lpad(lower(to_hex(c_custkey)), 32, '0') as h, c_name from customer)
            select c_custkey,
                   case when c_custkey % 5 = 4 then null
                        else regexp_replace(h, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') end as id,
                   sha256(c_name) as digest, cast(length(c_name) as int) as n_chars,
                   coalesce(nullif(case when c_custkey % 2 = 0 then '' else 'file' end, ''), 'system') as source
            from t""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    digits = F.lpad(F.lower(F.hex(key)), 32, "0")
    spelled = (
        F.when(key % 5 == 0, digits)
        .when(key % 5 == 1, F.concat(F.lit("{"), F.upper(ids.hex_to_uuid(digits)), F.lit("}")))
        .when(key % 5 == 2, F.concat(F.lit("urn:uuid:"), ids.hex_to_uuid(digits)))
        .when(key % 5 == 3, ids.hex_to_uuid(digits))
        .otherwise(F.concat(digits, F.lit("0")))
    )
    return table(spark, sf, "customer").select(
        key,
        ids.canonical_uuid(spelled).alias("id"),
        F.sha2("c_name", 256).alias("digest"),
        F.char_length("c_name").alias("n_chars"),
        F.coalesce(F.nullif(F.when(key % 2 == 0, "").otherwise("file"), F.lit("")), F.lit("system")).alias("source"),
    )


@query(
    "scalar_json",
    sql="""select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, true as has_k, false as has_z,
                  0 as z from events""",
)
def _(spark, sf):
    doc = F.try_parse_json("props")
    return table(spark, sf, "events").select(
        "event_id",
        F.try_variant_get(doc, "$.k", "bigint").alias("k"),
        F.array_contains(F.json_object_keys("props"), "k").alias("has_k"),
        F.array_contains(F.json_object_keys("props"), "z").alias("has_z"),
        F.coalesce(F.try_variant_get(doc, "$.z", "int"), F.lit(0)).alias("z"),
    )
