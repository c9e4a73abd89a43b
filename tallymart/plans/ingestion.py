"""Ingestion queries: upload lines are written out of the test tables, faults by key remainder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.ids import hex_to_uuid
from tallymart.operators import loading, uploads, upsert, validate
from tallymart.operators.prefix import number_rows
from tallymart.plans import demo
from tallymart.plans.catalog import query
from tallymart.schemas import LOAD_ORDER
from tallymart.session import fingerprint, fresh_dir
from tallymart.sources import csv, files
from tallymart.sources.export import RECORDS_PER_CHUNK, write_chunks
from tallymart.sources.store import TableStore

AS_OF = "2001-08-02 00:00:00"
TENANT = "00000000-0000-0000-0000-00000000002a"


def uuid_of(key: Column) -> Column:
    return hex_to_uuid(F.lpad(F.lower(F.hex(key)), 32, "0"))


def sql_uuid(key: str) -> str:
    return (
        f"regexp_replace(lpad(lower(to_hex(cast({key} as bigint))), 32, '0'), "
        r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
    )


_RECEIVED: dict[tuple[str, ...], str] = {}


def received(spark, sf: str, name: str, make: Callable[[], DataFrame], *tables: str) -> DataFrame:
    """The lines as a written table, so that making them up is no part of the job that reads them.

    They are written once per session, and again when a file that they are made of has changed.
    """
    inputs = [fingerprint(spark, f"{sf}/{t}.parquet") for t in tables]
    at = (spark.sparkContext.applicationId, name, *inputs)
    if at not in _RECEIVED:
        folder = fresh_dir(spark, name)
        make().write.option("maxRecordsPerFile", RECORDS_PER_CHUNK).parquet(folder)
        _RECEIVED[at] = folder
    return spark.read.parquet(_RECEIVED[at])


def member(name: str, value: Column, quoted: bool = True) -> Column:
    """One JSON member, NULL (and so left out) for a NULL value."""
    mark = '"' if quoted else ""
    return F.concat(F.lit(f'"{name}":{mark}'), value.cast("string"), F.lit(mark))


def line(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def order_lines(orders: DataFrame) -> DataFrame:
    """One NDJSON line per order; remainders 0 to 19 of the key carry a fault or an odd form."""
    key = F.col("order_id")
    case = key % 100
    plain_id = uuid_of(key)
    amount = F.col("total_amount").cast("string")
    text = line(
        member("order_id", F.when(case == 1, "not-a-uuid")
               .when(case == 11, F.concat(F.lit("{"), F.upper(plain_id), F.lit("}"))).otherwise(plain_id)),
        F.when(case == 19, F.lit('"external_order_id":null')).otherwise(
            member("external_order_id", F.concat(F.lit("EXT"), F.when(case == 16, key - 1).otherwise(key).cast("string")))
        ),
        member("customer_id", F.when(case == 10, "").otherwise(uuid_of(F.col("customer_id")))),
        F.when(case == 17, F.lit('"customer_name_snapshot":null')).otherwise(
            member("customer_name_snapshot", F.when(case == 5, F.repeat(F.lit("x"), 300))
                   .when(case == 14, None).otherwise(F.col("customer_name_snapshot")))
        ),
        member("customer_email_snapshot", F.when(case != 14, F.col("customer_email_snapshot"))),
        F.when(case == 8, F.lit('"total_amount":"abc"'))
        .when(case == 13, F.lit('"total_amount":"NaN"'))
        .when(case == 2, F.lit('"total_amount":-1'))
        .when(case == 18, F.lit('"total_amount":12345678901.5'))
        .otherwise(member("total_amount", amount, quoted=False)),
        member("currency", F.when(case == 0, None).when(case == 3, "JPY").otherwise(F.col("currency"))),
        member("order_status", F.when(case == 4, "unknown").otherwise(F.col("order_status"))),
        member("order_date", F.when(case == 12, "not-a-date").otherwise(
            F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss"))),
        F.when(case == 9, F.lit('"raw_payload":"plain"')).otherwise(
            member("raw_payload", F.col("raw_payload"), quoted=False)),
    )
    cut = F.when(case == 7, 0).when(case == 6, 40).otherwise(F.lit(100_000))
    return orders.select(key.alias("line_key"), F.left(text, cut).alias("value"))


_ORDER_REASON = """
    case order_id % 100 when 0 then 'Missing required field: currency'
        when 1 then 'Invalid order_id format: not-a-uuid' when 2 then 'total_amount must be non-negative'
        when 3 then 'Invalid currency: JPY' when 4 then 'Invalid order_status: unknown'
        when 5 then concat('Customer name too long: ', repeat('x', 300)) when 6 then 'invalid JSON'
        when 8 then 'could not convert string to float: ''abc'''
        when 12 then 'Invalid order_date format: not-a-date'
        when 13 then 'total_amount must be a finite number' when 17 then 'object of type ''NoneType'' has no len()'
        when 18 then 'total_amount out of range' when 19 then 'Missing required field: external_order_id' end"""

_CHECKED_ORDERS = f"""
    select order_id as line_key, {_ORDER_REASON} as reason, {sql_uuid("order_id")} as order_id,
           concat('EXT', cast(case when order_id % 100 = 16 then order_id - 1 else order_id end as varchar))
               as external_order_id,
           case when order_id % 100 <> 10 then {sql_uuid("customer_id")} end as customer_id,
           case when order_id % 100 = 14 then '' else coalesce(customer_name_snapshot, '') end
               as customer_name_snapshot,
           case when order_id % 100 = 14 then '' else coalesce(customer_email_snapshot, '') end
               as customer_email_snapshot,
           cast(total_amount as double) as total_amount, currency, order_status, order_date,
           case when order_id % 100 = 9 then '{{"value":"plain"}}' else raw_payload end as raw_payload
    from d_orders where order_id % 100 <> 7"""


def _checked_orders(spark, sf) -> DataFrame:
    lines = files.records(received(spark, sf, "order-lines", lambda: order_lines(demo.orders(spark, sf)), "orders", "customer"))
    return validate.validate(validate.from_json(lines, "orders"), "orders", TENANT, AS_OF).drop("value")


@query(
    "validate_orders",
    "d_orders",
    f"select * from ({_CHECKED_ORDERS}) t where reason is null",
)
def _(spark, sf):
    checked = validate.valid(_checked_orders(spark, sf)).drop("tenant_id", "created_at")
    return checked.withColumns(
        {"total_amount": F.col("total_amount").cast("double"), "reason": F.lit(None).cast("string")}
    )


@query(
    "validate_orders_rejects",
    "d_orders",
    f"select line_key, reason from ({_CHECKED_ORDERS}) t where reason is not null",
)
def _(spark, sf):
    return validate.rejects(_checked_orders(spark, sf), "line_key")


@query(
    "ingest_ndjson_scan",
    "d_orders",
    f"""select coalesce(reason, 'ok') as outcome, count(*) as n from ({_CHECKED_ORDERS}) t group by 1""",
)
def _(spark, sf):
    """Lines go out to files and come back through the tolerant scan."""
    folder = fresh_dir(spark, "ndjson")
    write_chunks(order_lines(demo.orders(spark, sf)).select("value"), f"{folder}/orders_{TENANT}.ndjson")
    lines = files.records(files.scan_lines(spark, f"{folder}/orders_*"))
    checked = validate.validate(validate.from_json(lines, "orders"), "orders", TENANT, AS_OF)
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def customer_lines(customers: DataFrame) -> DataFrame:
    key = F.col("customer_id")
    case = key % 50
    text = line(
        member("customer_id", F.when(case == 1, "x").when(case == 2, F.concat(F.lit("urn:uuid:"), uuid_of(key)))
               .otherwise(uuid_of(key))),
        F.when(case == 3, F.lit('"name":null')).otherwise(
            member("name", F.when(case == 4, F.repeat(F.lit("n"), 256)).otherwise(F.col("name")))),
        member("email", F.when(case != 5, F.col("email"))),
        F.when(case == 6, F.lit('"metadata":null'))
        .when(case == 7, F.lit('"metadata":7'))
        .when(case == 8, F.lit('"metadata":"{\\"tier\\":\\"gold\\"}"'))
        .when(case == 9, F.lit('"metadata":true'))
        .when(case == 10, None)
        .otherwise(F.lit('"metadata":{"tier":"silver"}')),
        F.when(case == 11, F.lit('"created_at":"2001-02-03T04:05:06+07:00"')),
    )
    return customers.select(key.alias("line_key"), text.alias("value"))


_CUSTOMERS = f"""
    select customer_id as line_key,
           case customer_id % 50 when 1 then 'Invalid customer_id format: x' when 3 then 'Missing required field: name'
               when 4 then concat('Customer name too long: ', repeat('n', 256))
               when 5 then 'Missing required field: email' end as reason,
           {sql_uuid("customer_id")} as customer_id, name, email,
           case customer_id % 50 when 6 then '{{}}' when 7 then '{{"value":"7"}}' when 8 then '{{"tier":"gold"}}'
               when 9 then '{{"value":"True"}}' when 10 then '{{}}' else '{{"tier":"silver"}}' end as metadata,
           case customer_id % 50 when 11 then timestamp '2001-02-03 04:05:06' else timestamp '{AS_OF}' end
               as created_at
    from d_customers"""


def _whole_or_reason(checked: DataFrame, *columns: str) -> DataFrame:
    """Valid rows in full; rejected rows with their key and reason only."""
    ok = F.col("reason").isNull()
    return checked.select("line_key", "reason", *(F.when(ok, F.col(c)).alias(c) for c in columns))


def _sql_whole_or_reason(inner: str, *columns: str) -> str:
    shown = ", ".join(f"case when reason is null then {c} end as {c}" for c in columns)
    return f"select line_key, reason, {shown} from ({inner}) t"


_CUSTOMER_COLUMNS = ["customer_id", "name", "email", "metadata", "created_at"]


@query("validate_customers", "d_customers", _sql_whole_or_reason(_CUSTOMERS, *_CUSTOMER_COLUMNS))
def _(spark, sf):
    lines = received(spark, sf, "customer-lines", lambda: customer_lines(demo.customers(spark, sf)), "customer")
    fields = validate.from_json(lines, "customers")
    return _whole_or_reason(validate.validate(fields, "customers", TENANT, AS_OF), *_CUSTOMER_COLUMNS)


def product_records(products: DataFrame) -> DataFrame:
    """Products as text columns, the form of a CSV upload."""
    key = F.col("product_id")
    case = key % 40
    return products.select(
        key.cast("string").alias("line_key"),
        F.when(case == 1, F.upper(uuid_of(key))).when(case == 2, "123").otherwise(uuid_of(key)).alias("product_id"),
        F.when(case == 3, F.repeat(F.lit("s"), 101)).otherwise(F.col("sku")).alias("sku"),
        F.when(case == 4, F.concat(F.lit('say "hi", '), "name")).otherwise(F.col("name")).alias("name"),
        F.when(case == 5, "abc").when(case == 6, "-0.01").when(case == 7, "inf").when(case == 8, "123456789.5")
        .when(case == 9, " 12.5 ").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(case == 10, "cat").when(case == 11, uuid_of(key)).otherwise("").alias("category_id"),
        F.when(case == 12, "maybe").when(F.col("active"), "True").otherwise("False").alias("active"),
    )


_PRODUCTS = f"""
    select cast(product_id as varchar) as line_key,
           case product_id % 40 when 2 then 'Invalid product_id format: 123'
               when 3 then concat('SKU too long: ', repeat('s', 101))
               when 5 then 'could not convert string to float: ''abc''' when 6 then 'price must be non-negative'
               when 7 then 'price must be a finite number' when 8 then 'price out of range'
               when 10 then 'Invalid category_id format: cat' when 12 then 'Invalid active format: maybe' end as reason,
           {sql_uuid("product_id")} as product_id, sku,
           case when product_id % 40 = 4 then concat('say "hi", ', name) else name end as name,
           case when product_id % 40 = 9 then 12.5 else cast(price as double) end as price,
           case when product_id % 40 = 11 then {sql_uuid("product_id")} end as category_id, active
    from d_products"""
_PRODUCT_COLUMNS = ["product_id", "sku", "name", "price", "category_id", "active"]


def _typed_products(checked: DataFrame) -> DataFrame:
    return _whole_or_reason(checked.withColumn("price", F.col("price").cast("double")), *_PRODUCT_COLUMNS)


@query("validate_products", "d_products", _sql_whole_or_reason(_PRODUCTS, *_PRODUCT_COLUMNS))
def _(spark, sf):
    rows = received(spark, sf, "product-rows", lambda: product_records(demo.products(spark, sf)), "part")
    fields = validate.from_csv(rows, "products")
    return _typed_products(validate.validate(fields, "products", TENANT, AS_OF))


@query("ingest_csv_scan", "d_products", _sql_whole_or_reason(_PRODUCTS, *_PRODUCT_COLUMNS))
def _(spark, sf):
    """The same records by way of gzipped CSV files."""
    folder = fresh_dir(spark, "csv")
    rows = product_records(demo.products(spark, sf))
    write_chunks(rows, f"{folder}/products_{TENANT}.csv", "csv", compress=True)
    found = csv.scan(spark, f"{folder}/products_*")
    key = F.element_at("cells", F.array_position("header", "line_key").cast("int")).alias("line_key")
    fields = validate.from_cells(found.select(key, "header", "cells"), "products")
    return _typed_products(validate.validate(fields, "products", TENANT, AS_OF))


def item_lines(lineitem: DataFrame) -> DataFrame:
    """One NDJSON line per item; an item's id is its order and line number, which repeat."""
    case = F.col("l_partkey") % 60
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    price = F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)") / 100
    text = line(
        member("order_item_id", F.when(case == 1, "none").otherwise(uuid_of(key))),
        member("order_id", uuid_of(F.col("l_orderkey"))),
        member("product_id", F.when(case == 2, "").otherwise(uuid_of(F.col("l_partkey")))),
        F.when(case == 3, F.lit('"quantity":0'))
        .when(case == 4, F.lit('"quantity":"5.7"'))
        .when(case == 5, F.lit('"quantity":5.7'))
        .when(case == 6, F.lit('"quantity":null'))
        .otherwise(member("quantity", F.col("l_quantity").cast("int"))),
        F.when(case == 7, F.lit('"unit_price":-2')).when(case == 8, None).otherwise(
            member("unit_price", price.cast("decimal(10,2)"), quoted=False)),
        F.when(case == 9, F.lit('"line_total":null')).otherwise(
            member("line_total", F.col("l_extendedprice").cast("decimal(12,2)"), quoted=False)),
    )
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", text.alias("value")
    )


_ITEMS = f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
           case l_partkey % 60 when 1 then 'Invalid UUID format: badly formed hexadecimal UUID string'
               when 2 then 'Invalid UUID format: badly formed hexadecimal UUID string'
               when 3 then 'quantity must be at least 1'
               when 4 then 'invalid literal for int() with base 10: ''5.7'''
               when 6 then 'int() argument must be a string, a bytes-like object or a real number, not ''NoneType'''
               when 7 then 'unit_price must be non-negative' when 8 then 'Missing required field: unit_price'
               when 9 then 'float() argument must be a string or a real number, not ''NoneType''' end as reason,
           {sql_uuid("l_orderkey * 8 + l_linenumber")} as order_item_id, {sql_uuid("l_partkey")} as product_id,
           case when l_partkey % 60 = 5 then 5 else cast(l_quantity as int) end as quantity,
           (cast(round(l_extendedprice * 100) as bigint) // cast(l_quantity as bigint)) / 100 as unit_price,
           l_extendedprice as line_total
    from lineitem"""


def _checked_items(spark, sf) -> DataFrame:
    lines = received(spark, sf, "item-lines", lambda: item_lines(demo.table(spark, sf, "lineitem")), "lineitem")
    fields = validate.from_json(lines, "order_items")
    return validate.validate(fields, "order_items", TENANT, AS_OF).drop("value")


@query(
    "validate_order_items",
    sql=f"""select l_orderkey, l_linenumber, l_partkey, reason,
                   case when reason is null then order_item_id end as order_item_id,
                   case when reason is null then product_id end as product_id,
                   case when reason is null then quantity end as quantity,
                   case when reason is null then unit_price end as unit_price,
                   case when reason is null then line_total end as line_total
            from ({_ITEMS}) t""",
)
def _(spark, sf):
    ok = F.col("reason").isNull()
    return _checked_items(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "reason",
        *(F.when(ok, F.col(c)).alias(c) for c in ("order_item_id", "product_id", "quantity")),
        *(F.when(ok, F.col(c).cast("double")).alias(c) for c in ("unit_price", "line_total")),
    )


_WRITE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "upsert_last_wins",
    sql=f"""select order_item_id, product_id, quantity, unit_price, line_total from ({_ITEMS}) t
            where reason is null
            qualify row_number() over (partition by order_item_id
                order by {", ".join(f"{c} desc" for c in _WRITE_ORDER)}) = 1""",
)
def _(spark, sf):
    latest = upsert.last_per_key(validate.valid(_checked_items(spark, sf)), ["order_item_id"], *_WRITE_ORDER)
    return latest.select(
        "order_item_id",
        "product_id",
        "quantity",
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("line_total").cast("double").alias("line_total"),
    )


_STORED = """select order_id, tenant_id, external_order_id, 'pending' as order_status,
                    cast(total_amount as double) as total_amount
             from d_orders where order_date < timestamp '2000-01-01 00:00:00'"""
_SENT = """select case when order_id % 90 = 0 then order_id + 1 else order_id end as order_id, tenant_id,
                  external_order_id, order_status, cast(total_amount as double) as total_amount,
                  order_id as line_key
           from d_orders where order_status <> 'pending'"""


def _stored_and_sent(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A table as first received, and later sendings; every 90th key claims its neighbour's primary id."""
    orders = demo.orders(spark, sf).withColumn("total_amount", F.col("total_amount").cast("double"))
    columns = ["order_id", "tenant_id", "external_order_id", "order_status", "total_amount"]
    stored = (
        orders.filter(F.col("order_date") < F.lit("2000-01-01").cast("timestamp_ntz"))
        .withColumn("order_status", F.lit("pending"))
        .select(columns)
    )
    claimed = F.when(F.col("order_id") % 90 == 0, F.col("order_id") + 1).otherwise(F.col("order_id"))
    sent = orders.filter(F.col("order_status") != "pending").select(
        claimed.alias("order_id"), *columns[1:], F.col("order_id").alias("line_key")
    )
    return stored, sent


def _promotion(spark, sf) -> upsert.Promotion:
    return upsert.promote(
        *_stored_and_sent(spark, sf), ["tenant_id", "external_order_id"], "order_id", ["line_key"]
    )


_CLASH = f"""
    select s.*, exists (select 1 from ({_STORED}) t where t.order_id = s.order_id
                        and t.external_order_id <> s.external_order_id)
             or exists (select 1 from ({_SENT}) o where o.order_id = s.order_id and o.line_key > s.line_key) as clash
    from ({_SENT}) s"""


@query(
    "promote_orders",
    "d_orders",
    f""", judged as ({_CLASH})
    select order_id, tenant_id, external_order_id, order_status, total_amount from judged where not clash
    union all
    select * from ({_STORED}) t
    where not exists (select 1 from judged j where not j.clash and j.tenant_id = t.tenant_id
                      and j.external_order_id = t.external_order_id)""",
)
def _(spark, sf):
    return _promotion(spark, sf).merged


@query(
    "promote_orders_rejects",
    "d_orders",
    f"select line_key, order_id, 'duplicate primary id' as reason from ({_CLASH}) j where clash",
)
def _(spark, sf):
    return _promotion(spark, sf).rejected.select("line_key", "order_id", "reason")


_KEEP_OLD = f"""
    select * from ({_STORED}) t union all
    select order_id, tenant_id, external_order_id, order_status, total_amount from ({_SENT}) s
    where not exists (select 1 from ({_STORED}) t where {{same}})"""


@query(
    "promote_ignore_conflicts",
    "d_orders",
    _KEEP_OLD.format(same="t.tenant_id = s.tenant_id and t.external_order_id = s.external_order_id"),
)
def _(spark, sf):
    stored, sent = _stored_and_sent(spark, sf)
    return upsert.insert_new(stored, sent, ["tenant_id", "external_order_id"])


@query("reload_ignore_conflicts", "d_orders", _KEEP_OLD.format(same="t.order_id = s.order_id"))
def _(spark, sf):
    """Reload of a table dump (JSON lines) on the primary key."""
    stored, sent = _stored_and_sent(spark, sf)
    dump = fresh_dir(spark, "dump")
    sent.write.json(dump)
    reloaded = spark.read.schema(sent.schema).json(dump)
    return upsert.insert_new(stored, reloaded, ["order_id"])


@query(
    "error_samples",
    "d_orders",
    f"""select chunk, line_key, reason, place from (
            select line_key // 1000 as chunk, line_key, reason,
                   row_number() over (partition by line_key // 1000 order by line_key) as place
            from ({_CHECKED_ORDERS}) t where reason is not null) r where place <= 5""",
)
def _(spark, sf):
    rejected = validate.rejects(_checked_orders(spark, sf), "line_key")
    rejected = rejected.withColumn("chunk", F.floor(F.col("line_key") / 1000))
    return uploads.error_samples(rejected, "chunk", "line_key", limit=uploads.SAMPLE_PER_CHUNK)


_CHUNKS = """
    select o_orderkey as chunk_id, o_custkey as upload_id, o_orderkey as chunk_index,
           case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'completed_with_errors' end
               as status,
           cast(floor(o_totalprice / 1000) as int) as rows, o_orderkey % 6 as n_errors
    from orders"""


def chunks(spark, sf) -> DataFrame:
    status = F.col("o_orderstatus")
    return demo.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("chunk_id"),
        F.col("o_custkey").alias("upload_id"),
        F.col("o_orderkey").alias("chunk_index"),
        F.when(status == "F", "completed").when(status == "O", "failed").otherwise("completed_with_errors")
        .alias("status"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("rows"),
        (F.col("o_orderkey") % 6).alias("n_errors"),
    )


@query(
    "upload_status",
    sql=f"""select upload_id, count(*) as total_chunks,
                   count(*) filter (where status = 'completed') as completed_chunks,
                   count(*) filter (where status = 'completed_with_errors') as chunks_with_errors,
                   count(*) filter (where status = 'failed') as failed_chunks,
                   cast(sum(rows) as bigint) as total_rows, cast(sum(n_errors) as bigint) as total_errors
            from ({_CHUNKS}) c group by 1""",
)
def _(spark, sf):
    return uploads.upload_status(chunks(spark, sf))


@query(
    "upload_verdict",
    sql=f"""select upload_id,
                   case when count(*) filter (where status = 'failed') = 0 then 'completed'
                        when count(*) filter (where status = 'failed') = count(*) then 'failed'
                        else 'completed_with_errors' end as status,
                   cast(sum(rows) as bigint) as rows_received
            from ({_CHUNKS}) c group by 1""",
)
def _(spark, sf):
    return uploads.upload_verdict(chunks(spark, sf))


@query(
    "resume_plan",
    sql=f"select upload_id, chunk_index, 'pending' as status from ({_CHUNKS}) c where status = 'failed'",
)
def _(spark, sf):
    plan = uploads.to_do(uploads.resume(chunks(spark, sf)))
    return plan.select("upload_id", "chunk_index", "status")


@query(
    "resume_queued",
    sql=f"""select upload_id, count(*) filter (where status = 'failed') as chunks_queued
            from ({_CHUNKS}) c group by 1""",
)
def _(spark, sf):
    return uploads.queued(uploads.resume(chunks(spark, sf)))


@query(
    "chunk_manifest",
    sql="""with f as (select o_custkey as upload_id, o_orderkey as file_no,
                             sha256(concat(cast(o_custkey as varchar), o_orderpriority)) as checksum,
                             o_orderdate < timestamp '1996-01-01 00:00:00' as old from orders),
                ex as (select upload_id, checksum,
                              row_number() over (partition by upload_id order by file_no) - 1 as chunk_index
                       from f where old),
                new as (select upload_id, checksum, min(file_no) as file_no from f
                        where not old and not exists (select 1 from ex where ex.upload_id = f.upload_id
                                                      and ex.checksum = f.checksum) group by 1, 2)
           select n.upload_id, n.checksum, n.file_no, 'pending' as status,
                  coalesce((select max(chunk_index) from ex where ex.upload_id = n.upload_id), -1)
                      + row_number() over (partition by n.upload_id order by n.file_no) as chunk_index
           from new n""",
)
def _(spark, sf):
    """Files of an upload are told apart by checksum; orders of early years are already registered."""
    named = demo.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("upload_id"),
        F.col("o_orderkey").alias("file_no"),
        F.sha2(F.concat(F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("checksum"),
        (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("old"),
    )
    block = F.expr("file_no div 1000000")
    existing = number_rows(named.filter("old"), ["upload_id"], block, ["file_no"], "chunk_index")
    return uploads.chunk_manifest(
        named.filter("not old").drop("old"),
        existing.select("upload_id", "checksum", "chunk_index"),
        block=block,
        order="file_no",
    )


@query(
    "file_checksums",
    sql="""select cast(o_orderkey % 8 as int) as chunk, cast(sum(strlen(line) + 1) as bigint) as bytes,
                  sha256(string_agg(line || chr(10), '' order by o_orderkey)) as checksum
           from (select o_orderkey, concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority) as line from orders) t group by 1""",
)
def _(spark, sf):
    """Checksums of plain text files, one for each chunk of the orders."""
    folder = fresh_dir(spark, "chunks")
    text = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("value")
    lines = demo.table(spark, sf, "orders").select((F.col("o_orderkey") % 8).cast("int").alias("chunk"), "o_orderkey", text)
    dealt = lines.repartition("chunk").sortWithinPartitions("chunk", "o_orderkey").drop("o_orderkey")
    dealt.write.partitionBy("chunk").text(folder)
    number = F.regexp_extract("file", r"/chunk=(\d+)/", 1).cast("int").alias("chunk")
    return files.checksums(spark, folder).select(number, "bytes", "checksum")


@query(
    "ingest_route",
    sql="""with p as (select o_orderkey, case o_orderkey % 6 when 0 then 'customers_' when 1 then 'products_'
                          when 2 then 'orders_' when 3 then 'order_items_' when 4 then 'order_' else 'events_' end as pre,
                          case when o_orderstatus = 'F' then '.csv.gz' else '.ndjson' end as suf from orders)
           select concat('/in/', pre, cast(o_orderkey as varchar), suf) as file,
                  case when pre in ('order_', 'events_') then null else rtrim(pre, '_') end as data_type,
                  suf = '.csv.gz' as is_csv from p""",
)
def _(spark, sf):
    case, status = F.col("o_orderkey") % 6, F.col("o_orderstatus")
    prefix = (
        F.when(case == 0, "customers_").when(case == 1, "products_").when(case == 2, "orders_")
        .when(case == 3, "order_items_").when(case == 4, "order_").otherwise("events_")
    )
    name = F.concat(
        F.lit("/in/"), prefix, F.col("o_orderkey").cast("string"),
        F.when(status == "F", ".csv.gz").otherwise(".ndjson"),
    )
    named = demo.table(spark, sf, "orders").select(name.alias("file"))
    return named.select(
        "file", files.route(F.col("file")).alias("data_type"), files.is_csv(F.col("file")).alias("is_csv")
    )


_CONTENT = {
    "customers": ["customer_id", "name", "email", "metadata", "created_at"],
    "products": ["product_id", "sku", "name", "price", "category_id", "active"],
    "orders": [
        "order_id", "external_order_id", "customer_id", "customer_name_snapshot", "customer_email_snapshot", "total_amount",
        "currency", "order_status", "order_date", "raw_payload",
    ],
    "order_items": ["order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total"],
}


def content(store: TableStore, *kinds: str) -> DataFrame:
    """All rows of some tables as (table_name, row_text)."""
    parts = []
    for kind in kinds:
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in _CONTENT[kind]]
        parts.append(store.read(kind).select(F.lit(kind).alias("table_name"), F.concat_ws("|", *texts).alias("row_text")))
    return reduce(DataFrame.unionByName, parts)


def _sql_content(kind: str, rows: str) -> str:
    money = {"price": "10,2", "unit_price": "10,2", "total_amount": "12,2", "line_total": "12,2"}
    texts = [f"cast({c} as decimal({money[c]}))" if c in money else c for c in _CONTENT[kind]]
    shown = ", ".join(f"coalesce(cast({t} as varchar), '~')" for t in texts)
    return f"select '{kind}' as table_name, concat_ws('|', {shown}) as row_text from ({rows}) t where reason is null"


_CUSTOMER_CONTENT = _sql_content("customers", _CUSTOMERS)
_PRODUCT_CONTENT = _sql_content("products", _PRODUCTS)
_ORDER_CONTENT = _sql_content(
    "orders",
    f"""select * from ({_CHECKED_ORDERS}) c where reason is null
        qualify row_number() over (partition by external_order_id order by line_key desc) = 1""",
)
_ITEM_CONTENT = _sql_content(
    "order_items",
    f"""select *, {sql_uuid("l_orderkey")} as order_id from ({_ITEMS}) i where reason is null
        qualify row_number() over (partition by order_item_id order by {", ".join(f"{c} desc" for c in _WRITE_ORDER)}) = 1""",
)


@query("ingest_all", "d_orders d_customers d_products", " union all ".join([_CUSTOMER_CONTENT, _PRODUCT_CONTENT, _ORDER_CONTENT, _ITEM_CONTENT]))
def _(spark, sf):
    """A whole upload folder, NDJSON and CSV, partly gzipped, loaded parents first; all rows of all tables."""
    folder = fresh_dir(spark, "upload")
    items = item_lines(demo.table(spark, sf, "lineitem").orderBy(_WRITE_ORDER))
    write_chunks(customer_lines(demo.customers(spark, sf)).select("value"), f"{folder}/customers_{TENANT}.ndjson")
    write_chunks(product_records(demo.products(spark, sf)).drop("line_key"), f"{folder}/products_{TENANT}.csv", "csv", compress=True)
    write_chunks(order_lines(demo.orders(spark, sf).orderBy("order_id")).select("value"), f"{folder}/orders_{TENANT}.ndjson", compress=True)
    write_chunks(items.select("value"), f"{folder}/order_items_{TENANT}.ndjson", compress=True)
    store = TableStore(spark, fresh_dir(spark, "store"))
    loading.load_all(store, folder, TENANT, AS_OF, batch=1)
    return content(store, *LOAD_ORDER)


@query(
    "ingest_progress",
    "d_orders d_products",
    f"""select 'orders' as kind, cast(1 + line_key % 4 // 2 as bigint) as batch, 'chunk ' || line_key % 4 as upload,
               count(*) as rows_received, count(*) filter (where reason is null) as rows_inserted,
               count(*) filter (where reason is not null) as rows_failed
        from ({_CHECKED_ORDERS}) t group by all
        union all
        select 'products', cast(1 + cast(line_key as bigint) % 4 // 2 as bigint), 'chunk ' || cast(line_key as bigint) % 4, count(*),
               count(*) filter (where reason is null), count(*) filter (where reason is not null)
        from ({_PRODUCTS}) t group by all""",
)
def _(spark, sf):
    """Two loads of two uploads of each type; what became of the rows of each upload."""
    store = TableStore(spark, fresh_dir(spark, "store"))
    orders, products = order_lines(demo.orders(spark, sf)), product_records(demo.products(spark, sf))
    for batch in (1, 2):
        folder = fresh_dir(spark, "upload")
        for chunk in (2 * batch - 2, 2 * batch - 1):
            write_chunks(orders.filter(F.col("line_key") % 4 == chunk).select("value"), f"{folder}/orders_{TENANT}_chunk_{chunk}.ndjson")
            mine = products.filter(F.col("line_key").cast("bigint") % 4 == chunk).drop("line_key")
            write_chunks(mine, f"{folder}/products_{TENANT}_chunk_{chunk}.csv", "csv")
        loading.load_all(store, folder, TENANT, AS_OF, batch=batch)
    counts = [F.sum(c).alias(c) for c in ("rows_received", "rows_inserted", "rows_failed")]
    upload = F.concat(F.lit("chunk "), F.regexp_extract("file", r"_chunk_(\d+)\.", 1)).alias("upload")
    return loading.progress(store).groupBy("kind", F.col("batch").cast("bigint").alias("batch"), upload).agg(*counts)


@query(
    "promotion_marks",
    "d_customers",
    f"""select coalesce(case when reason is null then email end, '') as email, reason,
               case when reason is null and not (line_key % 50 = 12 and exists (
                        select 1 from d_customers n where n.customer_id = c.line_key + 1)) then timestamp '{AS_OF}' end as processed_at
        from ({_CUSTOMERS}) c""",
)
def _(spark, sf):
    """Rejected customers, and those that claim their neighbour's id, stay without a time of processing."""
    folder = fresh_dir(spark, "upload")
    key = F.col("customer_id")
    customers = demo.customers(spark, sf).orderBy("customer_id")
    claimed = customer_lines(customers.withColumn("customer_id", F.when(key % 50 == 12, key + 1).otherwise(key)))
    write_chunks(claimed.select("value"), f"{folder}/customers_{TENANT}.ndjson")
    store = TableStore(spark, fresh_dir(spark, "store"))
    loading.load_all(store, folder, TENANT, AS_OF, batch=1)
    staged = loading.staging(store, "customers", AS_OF, 1, loading.source_of(folder, TENANT))
    email = F.when(F.col("reason").isNull(), F.col("email"))
    return staged.select(F.coalesce(email, F.lit("")).alias("email"), "reason", "processed_at")


@query(
    "csv_headers",
    "d_products",
    f"""select sku, name, cast(price as varchar) as price from (
            select product_id, sku, case when product_id % 7 = 0 then concat('two', chr(10), 'lines, "', name, '"') else name end as name,
                   case when product_id % 3 < 2 then price end as price
            from d_products) t""",
)
def _(spark, sf):
    """Uploads of three header orders, one without prices, with line breaks in quotes, read in one scan."""
    folder = fresh_dir(spark, "csv")
    name = F.when(F.col("product_id") % 7 == 0, F.concat(F.lit("two\nlines, \""), "name", F.lit('"'))).otherwise(F.col("name"))
    rows = demo.products(spark, sf).select("product_id", "sku", name.alias("name"), F.col("price").cast("string").alias("price"))
    for k, columns in enumerate((["sku", "name", "price"], ["price", "name", "sku"], ["name", "sku"])):
        mine = rows.filter(F.col("product_id") % 3 == k).select(columns)
        write_chunks(mine, f"{folder}/products_{TENANT}_chunk_{k}.csv", "csv")
    found = csv.scan(spark, f"{folder}/products_*")

    def cell(column):
        place = F.array_position("header", column).cast("int")
        return F.try_element_at("cells", F.when(place > 0, place)).alias(column)

    return found.select(cell("sku"), cell("name"), cell("price"))
