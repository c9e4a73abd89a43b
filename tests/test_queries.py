import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart.operators import metrics, quality, reports, search, tenants
from tallymart.operators.prefix import number_rows
from tallymart.session import fresh_dir
from tallymart.sources import export

ORDER = (
    "order_id bigint, tenant_id int, customer_id string, total_amount decimal(12,2), order_status string, "
    "order_date timestamp_ntz"
)


def orders_of(spark, *rows):
    """Rows of (customer, amount, status, date)."""
    full = [(i, 1, c, Decimal(a), s, dt.datetime.fromisoformat(d)) for i, (c, a, s, d) in enumerate(rows)]
    return spark.createDataFrame(full, ORDER)


def test_missing_customers_count_once_in_metrics_and_never_in_reports(spark):
    day = "2024-01-01T10:00:00"
    orders = orders_of(spark, ("a", 1, "delivered", day), ("a", 2, "cancelled", day), (None, 4, "pending", day), (None, 8, "pending", day))
    assert reports.daily_order_analytics(orders, "2024-01-02 00:00:00").first().unique_customers == 1
    exact = metrics.sales_by_period(orders, "day").first()
    assert (exact.unique_customers_est, exact.num_orders, exact.sum_sales) == (2, 4, 15.0)
    sketch = metrics.merge_sketches(metrics.customer_sketches(orders), F.col("tenant_id")).first()
    assert sketch.unique_customers_est == 2


def test_product_sales_add_the_order_total_per_item(spark):
    orders = orders_of(spark, ("a", 100, "delivered", "2024-01-01T10:00:00"))
    items = spark.createDataFrame([(0, "p", Decimal(5))] * 3, "order_id bigint, product_id string, line_total decimal(12,2)")
    row = metrics.sales_by_product(orders, items).first()
    assert (row.sum_sales, row.num_orders, row.unique_customers_est) == (300.0, 3, 1)
    assert metrics.sales_by_product(orders, items, basis="line_total").first().sum_sales == 15.0
    products = spark.createDataFrame([("p", None)], "product_id string, category_id string")
    assert metrics.sales_by_category(orders, items, products).count() == 0


def test_preaggregates_of_both_grains_answer_together(spark):
    orders = orders_of(spark, ("a", 1, "pending", "2024-01-01T05:30:00"))
    stored = metrics.preaggregate(orders, "day", "2024-01-02").unionByName(metrics.preaggregate(orders, "hour", "2024-01-02"))
    answer = metrics.sales_metrics("day", "approx", "2024-01-01", None, orders=orders, preagg=stored)
    assert {r.group_key for r in answer.data.collect()} == {"day:2024-01-01", "hour:2024-01-01T05:00:00"}
    assert (answer.method, answer.error_bounds) == (metrics.METHOD_PREAGG, metrics.BOUND_PREAGG)
    assert metrics.preagg_sales(stored, granularity="day").count() == 1
    assert metrics.preagg_sales(stored, start="2024-01-02 00:00:00").count() == 0


def test_timer_window_slides_or_aligns(spark):
    orders = orders_of(
        spark, ("a", 1, "pending", "2024-01-01T09:50:00"), ("a", 2, "pending", "2024-01-01T10:10:00"), ("a", 4, "pending", "2024-01-01T09:10:00")
    )
    empty = metrics.preaggregate(orders.limit(0), "hour", "2024-01-01")

    def sums(**options):
        rows = metrics.refresh_preaggregates(empty, orders, "hour", "2024-01-01 10:30:00", **options).collect()
        return {r.group_key[-8:]: r.sum_sales for r in rows}

    assert sums() == {"09:00:00": 1.0, "10:00:00": 2.0}
    assert sums(aligned=True) == {"09:00:00": 5.0}


def test_router_methods_and_bounds(spark):
    orders = orders_of(spark, ("a", 1, "pending", "2024-01-01T05:30:00"))
    items = spark.createDataFrame([(0, "p", Decimal(1))], "order_id bigint, product_id string, line_total decimal(12,2)")
    exact = metrics.sales_metrics("product", "exact", orders=orders, items=items)
    assert (exact.method, exact.error_bounds) == (metrics.METHOD_EXACT, None)
    rough = metrics.sales_metrics("product", "approx", orders=orders, items=items)
    assert (rough.method, rough.error_bounds) == (metrics.METHOD_SKETCH, metrics.BOUND_SKETCH)
    with pytest.raises(ValueError):
        metrics.sales_metrics("week", orders=orders)


def test_sketches_stay_within_their_error_and_merge(spark):
    orders = (
        spark.range(60_000)
        .select(
            F.col("id").alias("order_id"),
            F.lit(1).alias("tenant_id"),
            (F.col("id") % 20_000).cast("string").alias("customer_id"),
            F.lit(1).cast("decimal(12,2)").alias("total_amount"),
            F.timestamp_seconds(F.col("id") * 3 + 1704067200).cast("timestamp_ntz").alias("order_date"),
        )
    )
    merged = metrics.merge_sketches(metrics.customer_sketches(orders), F.col("tenant_id")).first()
    assert abs(merged.unique_customers_est - 20_000) < 20_000 * 0.05
    rough = metrics._sales(orders, "total_amount", F.col("tenant_id"), sketch=True).first()
    assert abs(rough.unique_customers_est - 20_000) < 20_000 * 0.08


@pytest.mark.parametrize(
    "text, moment",
    [
        ("2024-01-15T10:30:00", dt.datetime(2024, 1, 15, 10, 30)),
        ("2024-01-15", dt.datetime(2024, 1, 15)),
        ("15-01-2024", dt.datetime(2024, 1, 15)),
        ("15/01/2024", None),
        ("", None),
        (None, None),
    ],
)
def test_flexible_dates(text, moment):
    assert metrics.parse_moment(text) == moment


def test_segments_drop_customers_with_only_cancelled_orders(spark):
    day = "2024-01-01T10:00:00"
    orders = orders_of(spark, ("gone", 9, "cancelled", day), ("mid", 600, "pending", day), ("mid", 7, "cancelled", day))
    customers = spark.createDataFrame(
        [(c, 1, c, c) for c in ("gone", "mid", "none")], "customer_id string, tenant_id int, name string, email string"
    )
    rows = {r.customer_id: r for r in reports.customer_segments(customers, orders).collect()}
    assert set(rows) == {"mid", "none"}
    assert (rows["mid"].total_orders, rows["mid"].customer_segment) == (1, "Medium Value")
    assert (rows["none"].total_orders, rows["none"].total_spent, rows["none"].customer_segment) == (0, None, "Low Value")


def test_integrity_on_broken_references(spark):
    orders = orders_of(spark, ("a", 1, "pending", "2024-01-01"), ("b", 1, "pending", "2024-01-01"), (None, 1, "pending", "2024-01-01"))
    customers = spark.createDataFrame([("a",)], "customer_id string")
    row = quality.dangling(orders, "customer_id", customers, "customer_id", "c").first()
    assert (row.dangling_rows, row.dangling_values) == (1, 1)


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_numbering_in_blocks(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["hot", "hot", "b", "c"]), i) for i in range(300)]
    numbered = number_rows(spark.createDataFrame(rows, "k string, i int"), ["k"], F.floor(F.col("i") / size), ["i"], "n")
    seen = {}
    want = {}
    for k, i in rows:
        want[k, i] = seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1
    assert {(r.k, r.i): r.n for r in numbered.collect()} == want


def search_orders(spark, n=57):
    """Many orders share a date, so page borders fall inside a date."""
    return spark.range(n).select(
        F.col("id").alias("order_id"),
        F.lit(1).alias("tenant_id"),
        F.timestamp_seconds(F.floor(F.col("id") / 10) * 60).cast("timestamp_ntz").alias("order_date"),
        F.concat(F.lit("50%_"), F.col("id")).alias("customer_name_snapshot"),
        F.lit(None).cast("string").alias("customer_email_snapshot"),
    )


def test_pages_cover_everything_once(spark):
    found, seen, token = search.find(search_orders(spark), tenant_id=1), [], None
    while True:
        page = search.page(found, limit=8, cursor=token, fields=["order_id", "order_date"])
        seen += [r.order_id for r in page.collect()]
        token = search.next_cursor(page, 8)
        if token is None:
            break
    whole = search_orders(spark).orderBy(F.desc("order_date"), F.desc("order_id")).collect()
    assert seen == [r.order_id for r in whole]


def test_bad_cursor_starts_over_and_zero_limit_is_empty(spark):
    found, fields = search_orders(spark), ["order_id"]
    first = [r.order_id for r in search.page(found, limit=3, fields=fields).collect()]
    for token in ("???", "e30=", ""):
        assert [r.order_id for r in search.page(found, limit=3, cursor=token, fields=fields).collect()] == first
    assert search.page(found, limit=0, fields=fields).count() == 0


def test_search_text_has_no_wildcards(spark):
    found = search_orders(spark)
    assert search.find(found, q="50%_1").count() == 11
    assert search.find(found, q="5_%").count() == 0
    assert search.find(found, start_date="nonsense").count() == 57


def test_export_formats_round_trip(spark):
    orders = orders_of(spark, ("a", "1.50", "pending", "2024-01-01T10:00:00.250000"), (None, 2, "shipped", "2024-01-01"))
    rows = export.export_rows(orders)
    want = [("0", "a", "1.50", "2024-01-01T10:00:00.250000"), ("1", "None", "2.00", "2024-01-01T00:00:00")]
    for fmt in export.EXPORT_FORMATS:
        path = fresh_dir(spark, "export")
        assert export.export(rows, path, fmt, ordered=fmt == "json") == 2
        assert sorted(map(tuple, export.read_export(spark, path, fmt).collect())) == want
        listed = export.manifest(spark, path, fmt, 2).collect()
        assert len({r.chunk_index for r in listed}) == len(listed) and {r.rows for r in listed} == {2}
        assert all(r.bytes > 0 for r in listed)
    assert export.export_rows(orders, order_status="shipped").count() == 1
    with pytest.raises(ValueError):
        export.export(rows, fresh_dir(spark, "export"), "xlsx")


def test_chunks_are_bounded(spark):
    path = fresh_dir(spark, "chunks")
    export.write_chunks(spark.range(25).coalesce(1).select(F.col("id").cast("string").alias("value")), path, records=10)
    sizes = spark.read.text(path).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in sizes) == [5, 10, 10]


def test_tenant_files_create_update_or_skip(spark):
    columns = "tenant_id string, name string, api_key_hash string"
    known = spark.createDataFrame([("1", "old", "h1")], columns)
    file = spark.createDataFrame([("1", "new", "h1"), ("2", "two", "h2")], columns)
    kept = tenants.apply_plan(known, tenants.load_plan(known, file))
    assert {(r.tenant_id, r.name) for r in kept.collect()} == {("1", "old"), ("2", "two")}
    written = tenants.apply_plan(known, tenants.load_plan(known, file, overwrite=True))
    assert {(r.tenant_id, r.name) for r in written.collect()} == {("1", "new"), ("2", "two")}
    assert tenants.preview(file).columns == ["tenant_id", "name", "api_key"]


def test_a_page_beyond_the_maximum_is_an_error(spark):
    with pytest.raises(ValueError):
        search.page(spark.createDataFrame([], "order_id string, order_date timestamp_ntz"), limit=search.MAX_LIMIT + 1, fields=["order_id"])
    cursor = search.Cursor(dt.datetime(2024, 1, 2, 3, 4, 5, 6), "a~b")
    assert search.Cursor.decode(cursor.encode()) == cursor


def test_daily_refresh_rewrites_only_touched_days(spark):
    def orders(*rows):
        made = [(i, t, f"c{i}", 10.0 * i, status, f"{day} 10:00:00") for i, t, status, day in rows]
        df = spark.createDataFrame(made, "order_id int, tenant_id string, customer_id string, amount double, order_status string, at string")
        return df.withColumns({"total_amount": F.col("amount").cast("decimal(12,2)"), "order_date": F.col("at").cast("timestamp_ntz")})

    folder = fresh_dir(spark, "daily")
    first = [(k, "t", "shipped", f"2024-01-{1 + k % 5:02d}") for k in range(20)]
    assert len(reports.refresh_daily(orders(*first), orders(*first), folder)) == 5

    def files():
        found = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("f"), "period").distinct().collect()
        return {r.f: str(r.period) for r in found}

    before = files()
    late = [(100, "u", "delivered", "2024-01-02"), (101, "u", "shipped", "2024-01-09")]
    now = [(k, t, "cancelled" if day == "2024-01-03" else s, day) for k, t, s, day in first] + late
    changed = orders(*late, *(r for r in first if r[3] == "2024-01-03"))
    assert reports.refresh_daily(orders(*now), changed, folder) == ["2024-01-02", "2024-01-03", "2024-01-09"]
    after = files()
    assert sorted(set(after.values())) == ["2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05", "2024-01-09"]
    assert {after[f] for f in after.keys() - before.keys()} == {"2024-01-02", "2024-01-09"}
    stored, whole = reports.stored_daily(spark, folder), reports.tenant_daily_metrics(orders(*now))
    assert stored.exceptAll(whole).count() == 0 and stored.count() == whole.count()


def test_an_export_that_was_cut_short_goes_on(spark, monkeypatch):
    path = fresh_dir(spark, "export")
    rows = spark.range(500).select(F.col("id").cast("string").alias("order_id"), F.lit("c").alias("customer"), F.lit("1.00").alias("total_amount"), F.lit("").alias("order_date"))
    assert export.export_ranges(rows, path, ranges=8, wave=2, waves=2) == 4
    kept = {r.f for r in export.read_export(spark, f"{path}/data").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    # The next wave is written, but its manifest is not.
    real = export.read_export
    monkeypatch.setattr(export, "read_export", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        export.export_ranges(rows, path, ranges=8, wave=2)
    monkeypatch.setattr(export, "read_export", real)
    assert export.export_ranges(rows, path, ranges=8, wave=2) == 4 and export.export_ranges(rows, path, ranges=8) == 0
    got = export.read_export(spark, f"{path}/data")
    key = lambda r: (r.order_id, r.customer, r.total_amount, r.order_date or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, rows.collect()))
    assert kept <= {r.f for r in got.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    done = export.ranges_done(spark, path).collect()
    assert sorted(r.range for r in done) == list(range(8)) and sum(r.rows for r in done) == 500
    with pytest.raises(ValueError):
        export.export_ranges(rows, path, ranges=9)


def test_tenant_file_outcomes(spark, tmp_path):
    ids = [f"00000000-0000-0000-0000-00000000000{k}" for k in range(4)]
    lines = ["tenant_id,name,api_key_hash,created_at", f"{ids[0]},new,h,2024-01-01", f'{ids[1].upper()},"two\nlines",h,2024-01-01', f"{ids[0]},again,h,2024-01-02", "nope,x,h,2024-01-01", f"{ids[2]},x,h,never", f"{ids[3]},x"]
    (tmp_path / "tenants.csv").write_text("\n".join(lines) + "\n")
    known = spark.sql(f"select '{ids[1]}' as tenant_id, 'old' as name, 'k' as api_key_hash, timestamp_ntz'2020-01-01 00:00:00' as created_at")
    rows = tenants.read_file(spark, str(tmp_path / "tenants.csv"))
    outcomes, table_now = tenants.load_file(known, rows)
    assert [(r.outcome, r.reason) for r in outcomes.orderBy("pos").collect()] == [
        ("created", None), ("skipped", None), ("skipped", None), ("error", "Invalid tenant_id format: nope"),
        ("error", "Invalid created_at format: never"), ("error", "Missing required field: api_key_hash"),
    ]
    assert {r.tenant_id: r.name for r in table_now.collect()} == {ids[0]: "new", ids[1]: "old"}
    outcomes, table_now = tenants.load_file(known, rows, overwrite=True)
    assert [r.outcome for r in outcomes.orderBy("pos").collect()] == ["created", "updated", "updated", "error", "error", "error"]
    got = {r.tenant_id: (r.name, str(r.created_at)) for r in table_now.collect()}
    assert got == {ids[0]: ("again", "2024-01-02 00:00:00"), ids[1]: ("two\nlines", "2024-01-01 00:00:00")}
