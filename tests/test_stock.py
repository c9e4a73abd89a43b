import random

import pytest
from pyspark.sql import functions as F

from tallymart.operators import stock
from tallymart.session import fresh_dir
from tallymart.sources import files
from tallymart.sources.store import TableStore
from tallymart.streaming import run
from tallymart.streaming import stock as stream

EVENTS = "seq bigint, product_id string, delta bigint, event_time timestamp_ntz"
START = "product_id string, tenant_id string, available bigint, last_updated timestamp_ntz"


def events_of(spark, rows):
    df = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(rows)], "seq bigint, product_id string, delta bigint")
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("seq")).cast("timestamp_ntz")
    return df.withColumn("event_time", moment)


def products_of(spark, *ids):
    return spark.createDataFrame([(p, "t") for p in ids], "product_id string, tenant_id string")


def levels_of(spark, **levels):
    rows = [(p, "t", n) for p, n in levels.items()]
    df = spark.createDataFrame(rows, "product_id string, tenant_id string, available bigint")
    return df.withColumn("last_updated", F.lit("2023-01-01").cast("timestamp_ntz"))


def blocks(size):
    return F.floor(F.col("seq") / size)


def loop(rows, levels):
    """The rule, one movement at a time."""
    out, now = [], dict(levels)
    for seq, (product, delta) in enumerate(rows):
        if delta:
            now[product] = max(0, now.get(product, 0) + delta)
            out.append((seq, product, now[product]))
    return out, now


@pytest.mark.parametrize(
    "start, deltas, levels",
    [
        (200, [50, -30, 25], [250, 220, 245]),
        (0, [-5, 3, -10, 4], [0, 3, 0, 4]),
        (10, [0, -3], [7]),
        (10, [5, -20], [15, 0]),
    ],
)
@pytest.mark.parametrize("size", [1, 2, 100])
def test_golden_levels(spark, start, deltas, levels, size):
    fold = stock.fold(
        events_of(spark, [("p", d) for d in deltas]),
        products_of(spark, "p"),
        block=blocks(size),
        levels=levels_of(spark, p=start),
    )
    rows = stock.applied_events(fold).orderBy("seq").collect()
    assert [r.resulting_level for r in rows] == levels
    summary = stock.product_summary(fold).first()
    assert summary.events_processed == len(deltas)
    assert summary.events_applied == len(levels)
    assert summary.final_level == levels[-1]


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_blocked_fold_equals_loop_with_a_hot_product(spark, size):
    rng = random.Random(size)
    names = ["hot"] * 6 + [f"p{i}" for i in range(12)]
    rows = [(rng.choice(names), rng.randint(-9, 8)) for _ in range(1500)]
    start = {"hot": 5, "p1": 40}
    fold = stock.fold(
        events_of(spark, rows), products_of(spark, *set(names)), block=blocks(size), levels=levels_of(spark, **start)
    )
    got = [(r.seq, r.product_id, r.resulting_level) for r in stock.applied_events(fold).orderBy("seq").collect()]
    want, final = loop(rows, start)
    assert got == want
    assert {r.product_id: r.available for r in stock.final_levels(fold).collect()} == {
        p: final.get(p, 0) for p, _ in rows
    }


def test_conflicts_reject_whole_products(spark):
    rows = [("a", 5), ("b", 5), ("b", None), ("ghost", 1), ("a", -2), (None, 3)]
    fold = stock.fold(events_of(spark, rows), products_of(spark, "a", "b"), block=blocks(2))
    assert {r.product_id: r.reason for r in stock.conflicts(fold).collect()} == {
        "b": stock.BAD_DELTA,
        "ghost": stock.NOT_FOUND,
    }
    assert [r.product_id for r in stock.applied_events(fold).collect()] == ["a", "a"]
    total = stock.batch_summary(fold).first()
    assert total.status == "partial_success" and total.total_events_processed == 2 and total.conflicts == 2


def test_folding_batches_equals_folding_at_once(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", "c"]), rng.randint(-6, 6)) for _ in range(400)]
    whole = events_of(spark, rows)
    folder = fresh_dir(spark, "movements")
    for part in range(4):
        piece = whole.filter(F.floor(F.col("seq") / 100) == part)
        piece.coalesce(1).write.mode("append").parquet(folder)
    store = TableStore(spark, fresh_dir(spark, "levels"))
    handler = stream.apply_to(store, products_of(spark, "a", "b", "c"), lambda: blocks(30))
    arriving = run.arriving(spark, folder, EVENTS, files=1)
    # One file per micro-batch, in the order in which they were written.
    run.each_batch(arriving, handler, fresh_dir(spark, "checkpoint"))
    want, final = loop(rows, {})
    got = store.log("stock_events").select(F.col("stock_event_id").cast("bigint").alias("seq"), "product_id", "resulting_level")
    assert [tuple(r) for r in got.orderBy("seq").collect()] == want
    assert {r.product_id: r.available for r in store.read("stock_levels").collect()} == final


def test_a_repeated_batch_changes_nothing(spark):
    store = TableStore(spark, fresh_dir(spark, "levels"))
    handler = stream.apply_to(store, products_of(spark, "a"), lambda: blocks(10))
    first, second = events_of(spark, [("a", 7)]), events_of(spark, [("a", 0), ("a", -3)])
    handler(first, 0)
    handler(second, 1)
    handler(second, 1)
    assert [r.available for r in store.read("stock_levels").collect()] == [4]


def test_refresh_treats_zero_as_a_level_unless_told_otherwise(spark):
    levels = levels_of(spark, a=9, b=9)
    seen = spark.createDataFrame(
        [("1", "t", "a", 4, "2024-01-01 10:10:00"), ("2", "t", "a", 0, "2024-01-01 10:20:00"),
         ("3", "t", "new", None, "2024-01-01 10:20:00"), ("4", "t", "b", 1, "2024-01-01 08:00:00")],
        "stock_event_id string, tenant_id string, product_id string, resulting_level bigint, at string",
    ).withColumn("event_time", F.col("at").cast("timestamp_ntz"))

    def after(**options):
        rows = stock.refresh_levels(levels, seen, "2024-01-01 11:00:00", **options).collect()
        return {r.product_id: r.available for r in rows}

    assert after() == {"a": 0, "b": 9, "new": 0}
    assert after(zero_keeps=True) == {"a": 4, "b": 9, "new": 0}


def test_upload_lines(spark):
    lines = [
        '{"product_id": "a", "delta": 5, "source": "manual", "meta": {"r": 1}}',
        "not json",
        '{"delta": 3}',
        '{"product_id": "a", "delta": "7", "event_time": "2024-01-01T01:00:00", "source": ""}',
        '{"product_id": "a", "delta": -2.9}',
        '{"product_id": "a"}',
        '{"product_id": "b", "delta": 4}',
        '{"product_id": "b", "delta": "4.0"}',
        '{"product_id": "c", "delta": null}',
        '[{"product_id": "a", "delta": 1}]',
    ]
    path = fresh_dir(spark, "lines")
    spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1).write.text(path)
    read = stock.from_lines(files.records(files.scan_lines(spark, path)), "2024-02-02 00:00:00")
    rows = read.orderBy("pos").collect()
    assert [(r.product_id, r.delta) for r in rows] == [
        ("a", 5), ("a", 7), ("a", -2), ("a", 0), ("b", 4), ("b", None), ("c", None)
    ]
    assert [(r.source, r.meta) for r in rows[:2]] == [("manual", '{"r":1}'), ("system", "{}")]
    assert (rows[0].event_time.month, rows[1].event_time.month) == (2, 1)
    fold = stock.fold_lines(read, products_of(spark, "a", "b", "c"))
    assert [r.resulting_level for r in stock.applied_events(fold).orderBy("pos").collect()] == [5, 12, 10]
    assert {r.product_id for r in stock.conflicts(fold).collect()} == {"b", "c"}


def test_lines_travel_with_the_number_of_their_split(spark):
    """Paths and padded paths would be most of a movement's bytes in every sort; numbers in names count as numbers."""
    rows = [("f/10.json", 0, 1, -1), ("f/9.json", 0, 2, 4), ("f/9.json", 64, 9, 2), ("f/10.json", 0, 3, 5), ("f/9.json", 64, 5, -9)]
    read = spark.createDataFrame(rows, "file string, block long, pos long, delta long").withColumns(
        {"product_id": F.lit("a"), "event_time": F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))}
    )
    fold = stock.fold_lines(read, products_of(spark, "a"))
    assert fold.movements.schema["fold_block"].dataType.simpleString() == "int"
    levels = {(r.file, r.block, r.pos): r.resulting_level for r in stock.applied_events(fold).collect()}
    assert levels == {
        ("f/9.json", 0, 2): 4, ("f/9.json", 64, 5): 0, ("f/9.json", 64, 9): 2, ("f/10.json", 0, 1): 1, ("f/10.json", 0, 3): 6
    }
