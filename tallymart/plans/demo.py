"""The domain tables, as projections of the star-schema test tables.

Tenants are nations, products are parts, stock and price events come from the event table.
Every view has its SQL twin in ``VIEWS``, which the oracle queries use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators import prices, stock

AS_OF_ORDERS = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_PRICES = "2024-01-01 00:05:00"
PRICE_EPOCH = 1704067200000000  # 2024-01-01 in microseconds

VIEWS = {
    "d_tenants": "select n_nationkey as tenant_id, n_name as name from nation",
    "d_customers": """
        select c_custkey as customer_id, c_nationkey as tenant_id, c_name as name,
               concat(lower(replace(c_name, '#', '.')), '@example.com') as email
        from customer""",
    "d_products": """
        select p_partkey as product_id, p_partkey % 10 as tenant_id,
               concat(p_brand, '-', cast(p_partkey as varchar)) as sku, p_name as name,
               cast(p_retailprice as decimal(10,2)) as price,
               case when p_size <= 5 then null else p_type end as category_id,
               p_partkey % 20 <> 0 as active
        from part""",
    "d_orders": """
        select o_orderkey as order_id, c_nationkey as tenant_id,
               concat('EXT', cast(o_orderkey as varchar)) as external_order_id,
               case when o_orderkey % 50 = 0 then null else o_custkey end as customer_id,
               case when o_orderkey % 70 = 0 then null else c_name end as customer_name_snapshot,
               case when o_orderkey % 35 = 0 then null
                    else concat(lower(replace(c_name, '#', '.')), '@example.com') end as customer_email_snapshot,
               cast(o_totalprice as decimal(12,2)) as total_amount,
               case o_orderpriority when '1-URGENT' then 'USD' when '2-HIGH' then 'EUR'
                    when '3-MEDIUM' then 'GBP' else 'CAD' end as currency,
               case when o_orderstatus = 'F' then 'delivered' when o_orderstatus = 'O' then 'shipped'
                    when o_orderpriority = '5-LOW' then 'cancelled' else 'pending' end as order_status,
               o_orderdate + to_seconds(o_orderkey % 86400) as order_date,
               concat('{"source":"', case o_orderkey % 3 when 0 then 'web' when 1 then 'mobile' else 'api' end,
                      '"}') as raw_payload
        from orders join customer on o_custkey = c_custkey""",
    "d_order_items": """
        select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
               cast((cast(round(l_extendedprice * 100) as bigint) // cast(l_quantity as bigint)) / 100 as decimal(10,2)) as unit_price,
               cast(case when l_returnflag = 'R' then 0 else l_extendedprice end as decimal(12,2)) as line_total
        from lineitem""",
    "d_stock_events": """
        select event_id as seq, case when event_type = 'error' and value > 150 then -user_id - 1 else user_id end
                 as product_id,
               cast(case when event_type in ('signup', 'error') then 1 when event_type = 'view' then 0 else -1 end
                    * floor(value) as bigint) as delta,
               user_id % 50 = 7 and event_type = 'error' as bad_delta,
               ts as event_time
        from events""",
    # Old price is the event value; the new one scales it by the number in the event's properties.
    "d_price_events": f"""
        with e as (
            select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
                   cast(round(value * 100) as bigint) as cents
            from events)
        select event_id, user_id % 10 as tenant_id,
               case when k >= 95 then -user_id - 1 else user_id end as product_id,
               make_timestamp({PRICE_EPOCH} + (epoch_us(ts) - {PRICE_EPOCH}) // 10000) as received_at,
               concat(event_type, '-', cast(user_id as varchar), '-', strftime(ts, '%Y-%m-%d')) as idempotency_key,
               cents as old_cents,
               case when event_type = 'error' then cents * 2 * (k + 1)
                    when event_type = 'view' and k = 0 then 0
                    else cents * (50 + k) // 100 end as new_cents,
               event_type as source, case when k % 3 > 0 then props end as metadata
        from e""",
}

# Clamped running level, closed form: the running sum lifted by its lowest point so far.
VIEWS["d_stock_applied"] = """
    select * from d_stock_events e
    where exists (select 1 from part where p_partkey = e.product_id)
      and not exists (select 1 from d_stock_events b where b.product_id = e.product_id and b.bad_delta)"""
VIEWS["d_stock_sums"] = """
    select *, sum(delta) over (partition by product_id order by seq) as s from d_stock_applied"""
VIEWS["d_stock_fold"] = """
    select seq, product_id, delta, event_time,
           cast(s + greatest(0, -min(s) over (partition by product_id order by seq)) as bigint) as level
    from d_stock_sums"""
# Price intake one rule at a time; percentages in integer arithmetic, ties to even.
VIEWS["d_price_found"] = """
    select e.*, p.product_id is not null as listed
    from d_price_events e
    left join d_products p on p.product_id = e.product_id and p.tenant_id = e.tenant_id"""
VIEWS["d_price_pct"] = """
    select event_id, sign(new_cents - old_cents) as dir, abs(new_cents - old_cents) as gap, old_cents,
           gap * 1000000 // old_cents as q4, gap * 1000000 % old_cents as r4,
           gap * 1000 // old_cents as q1, gap * 1000 % old_cents as r1
    from d_price_events where old_cents > 0"""
VIEWS["d_price_sizes"] = """
    select *, q4 + case when 2 * r4 > old_cents or (2 * r4 = old_cents and q4 % 2 = 1) then 1 else 0 end as e4,
           q1 + case when 2 * r1 > old_cents or (2 * r1 = old_cents and q1 % 2 = 1) then 1 else 0 end as tenths
    from d_price_pct"""
VIEWS["d_price_classes"] = """
    select event_id, e4, dir * e4 / 10000 as pct,
           concat(case when dir < 0 then '-' else '' end, cast(tenths // 10 as varchar), '.',
                  cast(tenths % 10 as varchar), '%') as shown,
           case when gap * 2 >= old_cents then 'Extreme price change: '
                when gap * 4 >= old_cents then 'Significant price change: '
                when gap * 10 >= old_cents and old_cents > 10000
                then 'Notable price change for high-value item: ' end as class
    from d_price_sizes"""
VIEWS["d_price_checked"] = """
    select f.*, date_trunc('minute', received_at) as minute, {'t': received_at, 'e': f.event_id} as place,
           case when f.old_cents <= 0 or f.new_cents <= 0 then 'Prices must be positive'
                when c.e4 >= 100000000 then 'pct_change out of range' end as fault,
           c.pct, concat(c.class, c.shown) as reason, c.class
    from d_price_found f left join d_price_classes c on c.event_id = f.event_id"""
# One rule after the other, again and again: who attempts (nobody behind the first stored request of the key),
# who is within the product's and then the tenant's limit, and which request of a key is stored first.
_ADMITTED = """
    select * from (
        select * from ({attempts})
        qualify row_number() over (partition by product_id, minute order by received_at, event_id) <= 10)
    qualify row_number() over (partition by tenant_id, minute order by received_at, event_id) <= 100"""
VIEWS["d_price_rounds"] = f"""
    select 0 as round, tenant_id, idempotency_key, min(place) as winner from d_price_checked
    where listed and fault is null group by all
    union all
    select * from (
        select round, tenant_id, idempotency_key, min(place) as winner from ({_ADMITTED.format(attempts="""
            select r.*, n.round + 1 as round
            from d_price_checked r cross join (select max(round) as round from d_price_rounds) n
            left join d_price_rounds w using (tenant_id, idempotency_key)
            where r.listed and (w.winner is null or r.place <= w.winner)""")})
        where fault is null group by all)
    where round <= 15"""
VIEWS["d_price_winners"] = """
    select tenant_id, idempotency_key, winner from d_price_rounds where round = (select max(round) from d_price_rounds)"""
VIEWS["d_price_attempts"] = """
    select r.* from d_price_checked r left join d_price_winners w using (tenant_id, idempotency_key)
    where r.listed and (w.winner is null or r.place <= w.winner)"""
VIEWS["d_price_admitted"] = _ADMITTED.format(attempts="select * from d_price_attempts")
VIEWS["d_price_outcomes"] = """
    select f.*, case when not f.listed then 'rejected' when t.event_id is null then 'already_processed'
                     when a.event_id is null or f.fault is not null then 'rejected' else 'processed' end as status,
           case when not f.listed then 'Product not found' when t.event_id is null then null
                when a.event_id is null then 'Rate limit exceeded' else f.fault end as error,
           case when not f.listed then null when t.event_id is null or (a.event_id is not null and f.fault is null)
                then w.winner.e end as answered_by
    from d_price_checked f left join d_price_attempts t on t.event_id = f.event_id
    left join d_price_admitted a on a.event_id = f.event_id
    left join d_price_winners w on w.tenant_id = f.tenant_id and w.idempotency_key = f.idempotency_key"""
VIEWS["d_price_stored"] = """
    select event_id, tenant_id, product_id, old_cents / 100 as old_price, new_cents / 100 as new_price,
           pct as pct_change, class is not null as anomaly_flag, case when class is not null then reason end
           as anomaly_reason, source, metadata, received_at
    from d_price_outcomes where status = 'processed'"""
VIEWS["d_stock_levels"] = """
    select product_id, arg_max(level, seq) as available, max(event_time) as last_updated
    from d_stock_fold group by product_id"""

_NEEDS = {
    "d_price_found": ["d_price_events", "d_products"],
    "d_price_pct": ["d_price_events"],
    "d_price_sizes": ["d_price_pct"],
    "d_price_classes": ["d_price_sizes"],
    "d_price_checked": ["d_price_found", "d_price_classes"],
    "d_price_rounds": ["d_price_checked"],
    "d_price_winners": ["d_price_rounds"],
    "d_price_attempts": ["d_price_winners"],
    "d_price_admitted": ["d_price_attempts"],
    "d_price_outcomes": ["d_price_admitted"],
    "d_price_stored": ["d_price_outcomes"],
    "d_stock_applied": ["d_stock_events"],
    "d_stock_sums": ["d_stock_applied"],
    "d_stock_fold": ["d_stock_sums"],
    "d_stock_levels": ["d_stock_fold"],
}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views, and what they need, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name")
    )


def _email(name: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(name, "#", ".")), F.lit("@example.com"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("tenant_id"),
        F.col("c_name").alias("name"),
        _email(F.col("c_name")).alias("email"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        (F.col("p_partkey") % 10).alias("tenant_id"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.when(F.col("p_size") > 5, F.col("p_type")).alias("category_id"),
        (F.col("p_partkey") % 20 != 0).alias("active"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's tenant."""
    return placed_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def placed_orders(placed: DataFrame, buyers: DataFrame) -> DataFrame:
    """Orders from a batch or stream, with their customer's tenant."""
    key = F.col("o_orderkey")
    buyer = buyers.select("c_custkey", "c_name", "c_nationkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    seconds = (key % 86400).cast("decimal(18,6)")
    return placed.join(buyer, placed.o_custkey == buyer.c_custkey).select(
        key.alias("order_id"),
        F.col("c_nationkey").alias("tenant_id"),
        F.concat(F.lit("EXT"), key.cast("string")).alias("external_order_id"),
        F.when(key % 50 != 0, F.col("o_custkey")).alias("customer_id"),
        F.when(key % 70 != 0, F.col("c_name")).alias("customer_name_snapshot"),
        F.when(key % 35 != 0, _email(F.col("c_name"))).alias("customer_email_snapshot"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        F.when(priority == "1-URGENT", "USD")
        .when(priority == "2-HIGH", "EUR")
        .when(priority == "3-MEDIUM", "GBP")
        .otherwise("CAD")
        .alias("currency"),
        F.when(status == "F", "delivered")
        .when(status == "O", "shipped")
        .when(priority == "5-LOW", "cancelled")
        .otherwise("pending")
        .alias("order_status"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("order_date"),
        F.concat(
            F.lit('{"source":"'),
            F.when(key % 3 == 0, "web").when(key % 3 == 1, "mobile").otherwise("api"),
            F.lit('"}'),
        ).alias("raw_payload"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items; their tenant is that of the order they belong to."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.expr("cast((cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)) / 100 as decimal(10,2))").alias(
            "unit_price"
        ),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(price).cast("decimal(12,2)").alias("line_total"),
    )


def stock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock movements in file order ``seq``; some name unknown products, some carry a bad delta."""
    return stock_movements(table(spark, sf_dir, "events"))


def stock_movements(events: DataFrame) -> DataFrame:
    """Stock movements from a batch or stream of events."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    sign = F.when(kind.isin("signup", "error"), 1).when(kind == "view", 0).otherwise(-1)
    bad = (user % 50 == 7) & (kind == "error")
    return events.select(
        F.col("event_id").alias("seq"),
        F.when((kind == "error") & (value > 150), -user - 1).otherwise(user).alias("product_id"),
        F.when(~bad, (sign * F.floor(value)).cast("bigint")).alias("delta"),
        F.col("ts").alias("event_time"),
    )


def stock_blocks() -> Column:
    """Sequence blocks of the stock events: no group of the fold is larger than one block."""
    return F.expr(f"seq div {stock.EVENTS_PER_BLOCK}")


def stock_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels after all events, starting from empty shelves."""
    fold = stock.fold(stock_events(spark, sf_dir), products(spark, sf_dir), block=stock_blocks())
    return stock.final_levels(fold)


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price change requests as they arrive, before any check."""
    return price_requests(table(spark, sf_dir, "events"))


def price_requests(events: DataFrame) -> DataFrame:
    """Price change requests from a batch or stream of events."""
    k, cents, kind = F.col("k"), F.col("cents"), F.col("event_type")
    read = events.withColumns(
        {
            "k": F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"),
            "cents": F.round(F.col("value") * 100).cast("bigint"),
        }
    )
    scaled = (
        F.when(kind == "error", cents * 2 * (k + 1))
        .when((kind == "view") & (k == 0), 0)
        .otherwise(F.expr("cents * (50 + k) div 100"))
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - PRICE_EPOCH
    arrival = F.timestamp_micros(F.floor(micros / 10000) + PRICE_EPOCH)
    return read.select(
        "event_id",
        (F.col("user_id") % 10).alias("tenant_id"),
        F.when(k >= 95, -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("product_id"),
        arrival.cast("timestamp_ntz").alias("received_at"),
        F.concat_ws("-", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias(
            "idempotency_key"
        ),
        (cents / 100).cast("decimal(10,2)").alias("old_price"),
        (scaled / 100).cast("decimal(10,2)").alias("new_price"),
        kind.alias("source"),
        F.when(k % 3 > 0, F.col("props")).alias("metadata"),
    )


def stored_price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price event table after all requests went through intake."""
    return prices.stored_events(prices.intake(price_events(spark, sf_dir), products(spark, sf_dir)))
