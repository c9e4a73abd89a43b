"""One key with a third of all rows: groups stay bounded and results whole."""

import re

from pyspark.sql import functions as F

from tallymart.operators import metrics, prices, reports, stock, upsert
from tallymart.operators.prefix import number_rows

N = 120_000


def hot_rows(spark):
    """Key 0 holds a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1)
    return spark.range(0, N, 1, 8).select(F.col("id").alias("seq"), key.cast("string").alias("product_id"))


def test_fold_groups_are_bounded_by_the_block(spark):
    at = F.timestamp_seconds(F.col("seq")).cast("timestamp_ntz")
    events = hot_rows(spark).withColumns({"delta": (F.col("seq") * 7919 % 41 - 20), "event_time": at})
    products = events.select("product_id", F.lit("t").alias("tenant_id")).distinct()
    fold = stock.fold(events, products, block=F.expr("seq div 3000"))
    assert fold.carried.agg(F.max("n")).first()[0] == 1000
    folded = {(r.seq): r.resulting_level for r in stock.applied_events(fold).filter("product_id = '0'").collect()}
    level, want = 0, {}
    for seq in range(0, N, 3):
        delta = seq * 7919 % 41 - 20
        if delta:
            level = max(0, level + delta)
            want[seq] = level
    assert folded == want


def test_numbering_is_whole(spark):
    numbered = number_rows(hot_rows(spark), ["product_id"], F.expr("seq div 2500"), ["seq"], "n")
    hot = numbered.filter("product_id = '0'").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert tuple(hot.first()) == (N // 3, N // 3 - 1, N // 3)


def test_a_claimed_id_leaves_every_other_row_rejected(spark):
    rows = hot_rows(spark).select(F.col("product_id").alias("id"), F.col("seq").cast("string").alias("key"), F.col("seq").alias("pos"))
    existing = spark.createDataFrame([("1", "none")], "id string, key string")
    done = upsert.promote(existing, rows.withColumn("id", F.when(F.col("id") == "0", "0").otherwise(F.col("key"))), ["key"], "id", ["pos"])
    assert done.rejected.count() + done.accepted.count() == N
    assert done.accepted.filter("id = '0'").first().pos == N - 3
    # Row 1 wants the id that the table holds under another key.
    assert done.rejected.filter("key = '1'").count() == 1


def test_limits_hold_for_a_hot_tenant(spark):
    events = hot_rows(spark).select(
        F.col("seq").alias("event_id"), F.lit("t").alias("tenant_id"), "product_id",
        F.timestamp_micros(F.col("seq") * 10_000 + 1704067200000000).cast("timestamp_ntz").alias("received_at"),
    )
    per_minute = prices.admit_per_minute(events).groupBy(F.date_trunc("minute", "received_at").alias("m"))
    counts = [r["count"] for r in per_minute.count().collect()]
    assert counts == [100] * 20


def test_replays_of_a_hot_key_are_spread(spark):
    requests = hot_rows(spark).select(
        F.col("seq").alias("event_id"), F.lit("t").alias("tenant_id"), F.lit("p").alias("product_id"),
        F.col("product_id").alias("idempotency_key"), F.lit(True).alias("good"),
        F.timestamp_seconds((N - F.col("seq")) * 60).cast("timestamp_ntz").alias("received_at"),
    )
    answers = prices.settle(requests)
    hot = answers.filter("idempotency_key = '0'").groupBy("admitted", "answered_by").count().collect()
    assert {(r.admitted, r.answered_by, r["count"]) for r in hot} == {(True, None, 1), (None, N - 3, N // 3 - 1)}
    assert answers.count() == N


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_small_groups_have_small_sketches(spark):
    """An empty set of registers takes as much as a full one, so groups of a few customers list them instead."""
    orders = spark.range(0, 3000).select(
        F.col("id").alias("order_id"),
        F.lit(1).alias("tenant_id"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 30).alias("customer_id"),
        F.lit(2).cast("decimal(12,2)").alias("total_amount"),
        F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("order_date"),
    )
    items = orders.select("order_id", (F.col("order_id") % 7).alias("product_id"))
    rough = metrics.sales_by_product(orders, items, sketch=True)
    assert "approx_count_distinct" not in executed(rough) and "hll_sketch_agg" in executed(rough)
    exact = metrics.sales_by_product(orders, items)
    assert rough.count() == 7 and rough.exceptAll(exact.select(rough.columns)).count() == 0


def test_sums_are_not_held_for_each_order_and_product(spark):
    orders = spark.createDataFrame([(1, "delivered"), (2, "shipped"), (3, "pending"), (None, "shipped")], "order_id long, order_status string")
    rows = [(1, 7), (1, 7), (1, 8), (2, 7), (2, None), (2, None), (3, 7), (None, 7)]
    items = spark.createDataFrame(rows, "order_id long, product_id long").withColumns(
        {"quantity": F.lit(1), "line_total": F.lit(3).cast("decimal(12,2)"), "unit_price": F.lit(3).cast("decimal(10,2)")}
    )
    sales = reports.product_sales(items, orders, None, None)
    assert not re.search(r"Aggregate\(keys=\[[^\]]*order_id", executed(sales))
    assert {(r.product_id, r.times_ordered, r.order_count) for r in sales.collect()} == {(7, 3, 2), (8, 1, 1), (None, 2, 1)}
