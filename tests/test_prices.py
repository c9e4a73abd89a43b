import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart.operators import prices
from tallymart.session import fresh_dir
from tallymart.streaming import prices as stream
from tallymart.streaming import run

REQUEST = (
    "event_id bigint, tenant_id string, product_id string, received_at timestamp_ntz, idempotency_key string, "
    "old_price decimal(10,2), new_price decimal(10,2), source string, metadata string"
)


@pytest.mark.parametrize(
    "old, new, text",
    [
        ("100", "105", None),
        ("100", "150", "Extreme price change: 50.0%"),
        ("100", "125", "Significant price change: 25.0%"),
        ("100", "110", None),
        ("200", "220", "Notable price change for high-value item: 10.0%"),
        ("200", "75.30", "Extreme price change: -62.4%"),
        ("400", "601", "Extreme price change: 50.2%"),
    ],
)
def test_anomaly_texts(spark, old, new, text):
    df = spark.createDataFrame([(Decimal(old), Decimal(new))], "old_price decimal(10,2), new_price decimal(10,2)")
    row = prices.with_change(df).first()
    assert row.anomaly_reason == text and row.anomaly_flag == (text is not None)
    pct = (Decimal(new) - Decimal(old)) / Decimal(old) * 100
    assert row.pct_change == round(pct, 4)


@pytest.mark.parametrize(
    "old, new, error",
    [("0", "5", prices.NOT_POSITIVE), ("5", "-1", prices.NOT_POSITIVE), ("0.01", "10", prices.OUT_OF_RANGE), ("1", "2", None)],
)
def test_price_errors(spark, old, new, error):
    df = spark.createDataFrame([(Decimal(old), Decimal(new))], "old_price decimal(10,2), new_price decimal(10,2)")
    assert prices.with_change(df).select(prices.price_error().alias("e")).first().e == error


def requests_of(spark, rows):
    """Rows of (seconds, tenant, product, key[, old, new])."""
    full = []
    for i, row in enumerate(rows):
        second, tenant, product, key, *pair = row
        old, new = pair or ("10", "11")
        full.append((i, tenant, product, float(second), key, Decimal(old), Decimal(new), "api", '{"b": [1, 2], "a": null}' if i % 2 else None))
    df = spark.createDataFrame(full, REQUEST.replace("received_at timestamp_ntz", "at double"))
    moment = F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint") + 1704067200000000).cast("timestamp_ntz")
    return df.withColumn("received_at", moment).drop("at")


def products_of(spark, rows):
    listed = sorted({(r[1], r[2], f"name of {r[2]}") for r in rows if r[2] != "ghost"})
    return spark.createDataFrame(listed, "tenant_id string, product_id string, name string")


def answers_loop(rows, batch_of=lambda row: 0):
    """Requests answered one at a time: (status, error, answering event). Keys are live for a day, but not looked up by age in their own batch."""
    keys, counts, answers = {}, {}, {}
    for i, row in sorted(enumerate(rows), key=lambda r: (batch_of(r[1]), r[1][0], r[0])):
        second, tenant, product, key, *pair = row
        old, new = (Decimal(x) for x in pair or ("10", "11"))
        minute = int(second // 60)
        if product == "ghost":
            answers[i] = (prices.REJECTED, prices.NO_PRODUCT, None)
        elif key is None:
            answers[i] = (prices.REJECTED, prices.NO_KEY, None)
        elif (tenant, key) in keys and (keys[tenant, key][2] == batch_of(row) or second <= keys[tenant, key][1] + 86400):
            answers[i] = (prices.REPLAYED, None, keys[tenant, key][0])
        elif counts.get((tenant, minute), 0) >= 100 or counts.get((product, minute), 0) >= 10:
            answers[i] = (prices.REJECTED, prices.LIMITED, None)
        else:
            for counter in (tenant, product):
                counts[counter, minute] = counts.get((counter, minute), 0) + 1
            if old <= 0 or new <= 0:
                answers[i] = (prices.REJECTED, prices.NOT_POSITIVE, None)
            else:
                answers[i] = (prices.PROCESSED, None, i)
                keys[tenant, key] = (i, second, batch_of(row))
    return answers


def answers_of(outcomes):
    return {r.event_id: (r.status, r.error, r.answered_by) for r in outcomes.collect()}


def per_minute_loop(rows):
    counts, admitted = {}, []
    for i, (second, tenant, product, *_) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        minute = int(second // 60)
        if counts.get((tenant, minute), 0) >= 100 or counts.get((product, minute), 0) >= 10:
            continue
        for key in (tenant, product):
            counts[key, minute] = counts.get((key, minute), 0) + 1
        admitted.append(i)
    return sorted(admitted)


def test_admission_per_minute_equals_the_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 200), t := rng.choice("TTTU"), f"{t}{rng.randint(0, 14)}", None) for _ in range(1500)]
    admitted = prices.admit_per_minute(requests_of(spark, rows)).select("event_id").collect()
    assert sorted(r.event_id for r in admitted) == per_minute_loop(rows)


def test_admission_keeps_only_bounded_groups(spark):
    """Both limits must be applied before the shuffle, or one hot product would travel whole."""
    events = requests_of(spark, [(0, "T", "P", None)])
    plan = prices.admit_per_minute(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def retries(seed, n=1000, seconds=150):
    """Requests that repeat keys, hit both limits and name bad prices."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        tenant = rng.choice("TTTU")
        product = rng.choice([f"{tenant}{rng.randint(0, 3)}", f"{tenant}{rng.randint(0, 40)}", "ghost"])
        key = rng.choice([None, "hot", f"k{rng.randint(0, 30)}", *[f"k{rng.randint(0, n // 2)}"] * 4])
        rows.append((rng.randint(0, seconds), tenant, product, key, rng.choice(["0", "10"]), rng.choice(["-1", "11", "30"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_retries_equal_the_loop(spark, seed):
    rows = retries(seed)
    want = answers_loop(rows)
    assert answers_of(prices.intake(requests_of(spark, rows), products_of(spark, rows))) == want
    kinds = {a[:2] for a in want.values()}
    assert len(kinds) == 6  # every outcome occurs


def test_a_refused_request_leaves_its_key_free(spark):
    rows = [(0, "T", "P", "a", "0", "5"), (300, "T", "P", "a", "100", "150"), (600, "T", "P", "a", "100", "150")]
    rows += [(1000 + n / 100, "T", "Q", f"q{n}") for n in range(12)] + [(1130, "T", "Q", "q11"), (1131, "T", "Q", "q0")]
    got = answers_of(prices.intake(requests_of(spark, rows), products_of(spark, rows)))
    assert [got[i] for i in range(3)] == [(prices.REJECTED, prices.NOT_POSITIVE, None), (prices.PROCESSED, None, 1), (prices.REPLAYED, None, 1)]
    assert got[14] == (prices.REJECTED, prices.LIMITED, None) and got[15] == (prices.PROCESSED, None, 15) and got[16] == (prices.REPLAYED, None, 3)


def test_a_hot_key_is_no_group_of_a_window(spark):
    """Who attempts and who wins is decided by joins and combined minima; the only windows are those of the limits."""
    plan = prices.settle(spark.createDataFrame([], "event_id long, tenant_id string, product_id string, received_at timestamp_ntz, idempotency_key string, good boolean"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and not any("idempotency_key" in line.split("windowspec")[-1] for line in windows)


def stream_of(spark, requests, cuts, products, tmp_folder):
    """One file, and so one micro-batch, for each cut."""
    folder, kept = fresh_dir(spark, "requests"), fresh_dir(spark, "kept")
    for k, piece in enumerate(cuts):
        requests.filter(piece).coalesce(1).write.mode("append").parquet(folder)
        arriving = run.arriving(spark, folder, requests.schema, files=1)
        run.each_batch(arriving, stream.intake_into(kept, products), tmp_folder)
    return kept


def test_streamed_intake_equals_the_loop(spark):
    """Micro-batches cut through minutes and keys; the third one is answered again after a failure."""
    rows = retries(4, 400, 180)
    requests, products = requests_of(spark, rows), products_of(spark, rows)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    second = F.timestamp_diff("SECOND", start, F.col("received_at"))
    kept = stream_of(spark, requests, [(second >= 45 * k) & (second < 45 * k + 45) for k in range(5)], products, fresh_dir(spark, "checkpoint"))
    assert answers_of(stream.outcomes(spark, kept)) == answers_loop(rows, lambda r: r[0] // 45)
    stream.intake_into(kept, products)(requests.filter((second >= 90) & (second < 135)), 2)
    assert answers_of(stream.outcomes(spark, kept)) == answers_loop(rows, lambda r: r[0] // 45)


def test_a_long_stream_reads_few_folders(spark):
    """A request a day and key over weeks: a batch looks only at folders that can hold its keys, and expired days go whole."""
    day = 86400
    rows = [(d * day + 3600 * h, "T", "P", f"k{(d + h) % 6}") for d in range(20) for h in (0, 20)]
    requests, products = requests_of(spark, rows), products_of(spark, rows)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    days = F.floor(F.timestamp_diff("SECOND", start, F.col("received_at")) / day)
    kept = stream_of(spark, requests, [days == d for d in range(20)], products, fresh_dir(spark, "checkpoint"))
    assert answers_of(stream.outcomes(spark, kept)) == answers_loop(rows, lambda r: r[0] // day)
    last = stream.recorded_keys(spark, kept, requests.filter(days == 19), 19)
    read = {f.split("/keys/")[1].split("/bucket=")[0] for f in last.filter("true").select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert read <= {"expires=2024-01-20", "expires=2024-01-21"}
    assert "expires" in last._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    gone = stream.drop_expired(spark, kept, "2024-01-10")
    assert gone and not any(f >= "keys/expires=2024-01-10" for f in gone if f.startswith("keys/"))
    left = stream.recorded_keys(spark, kept, requests.filter(days == 0), 100)
    assert left.agg(F.min("expires").cast("string")).first()[0] >= "2024-01-10"


def test_metadata_and_product_reach_the_feed(spark):
    rows = [(0, "T", "P", "a", "100", "150"), (1, "T", "P", "b", "100", "160"), (2, "T", "P", "c", "100", "101")]
    products = products_of(spark, rows)
    outcomes = prices.intake(requests_of(spark, rows), products)
    feed = prices.recent_anomalies(prices.stored_events(outcomes), products, "2024-01-01 01:00:00").collect()
    assert [(r.event_id, r.product_name, r.metadata) for r in feed] == [(1, "name of P", '{"a":null,"b":[1,2]}'), (0, "name of P", None)]
    bodies = {
        0: '{"new_price":150.00,"old_price":100.00,"source":"api"}',
        1: '{"metadata":{"a":null,"b":[1,2]},"new_price":160.00,"old_price":100.00,"source":"api"}',
    }
    hashes = {r.event_id: r.request_hash for r in prices.idempotency_records(outcomes).collect()}
    assert all(hashes[i] == hashlib.sha256(body.encode()).hexdigest() for i, body in bodies.items())
    odd = requests_of(spark, rows[:1]).withColumn("metadata", F.lit("not json"))
    stored = prices.stored_events(prices.intake(odd, products))
    assert prices.anomalies(stored, products).first().metadata == '{"value":"not json"}'


def test_the_latest_recorded_expiry_counts(spark):
    rows = [(3600, "T", "P", "a", "10", "12")]
    known = spark.sql(
        """select 'T' as tenant_id, 'a' as idempotency_key, timestamp_ntz'2000-01-01 00:00:00' as expires_at, 70L as event_id
           union all select 'T', 'a', timestamp_ntz'2999-01-01 00:00:00', 71L"""
    )
    out = prices.intake(requests_of(spark, rows), products_of(spark, rows), known).first()
    assert (out.status, out.answered_by) == (prices.REPLAYED, 71)


def test_ten_products_share_the_tenant_limit(spark):
    rows = [(0, "T", f"P{p}", f"k{p}-{n}") for p in range(11) for n in range(10)]
    statuses = prices.intake(requests_of(spark, rows), products_of(spark, rows)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in statuses} == {prices.PROCESSED: 100, prices.REJECTED: 10}


def test_fifteen_requests_on_one_product_admit_ten(spark):
    rows = [(n, "T", "P", f"k{n}") for n in range(15)]
    outcomes = prices.intake(requests_of(spark, rows), products_of(spark, rows))
    assert outcomes.filter(F.col("error") == prices.LIMITED).count() == 5


def test_known_keys_answer_until_they_expire(spark):
    rows = [(10, "T", "P", "old"), (10, "T", "P", "expired"), (10, "T", "P", None), (11, "T", "P", "new"), (12, "T", "P", "new")]
    known = spark.createDataFrame(
        [("T", "old", "2024-01-01 06:00:00", 70), ("T", "expired", "2024-01-01 00:00:05", 71)],
        "tenant_id string, idempotency_key string, at string, event_id long",
    ).withColumn("expires_at", F.col("at").cast("timestamp_ntz"))
    outcomes = prices.intake(requests_of(spark, rows), products_of(spark, rows), known).orderBy("event_id").collect()
    assert [(r.status, r.error) for r in outcomes] == [
        (prices.REPLAYED, None),
        (prices.PROCESSED, None),
        (prices.REJECTED, prices.NO_KEY),
        (prices.PROCESSED, None),
        (prices.REPLAYED, None),
    ]


def test_stored_events_feed_the_anomaly_report(spark):
    rows = [(0, "T", "P", "a", "100", "150"), (1, "T", "P", "b", "100", "101"), (2, "T", "P", "c", "100", "20")]
    products = products_of(spark, rows)
    stored = prices.stored_events(prices.intake(requests_of(spark, rows), products))
    feed = prices.recent_anomalies(stored, products, "2024-01-01 01:00:00").collect()
    assert [r.anomaly_reason for r in feed] == ["Extreme price change: -80.0%", "Extreme price change: 50.0%"]
    assert prices.anomaly_summary(stored, "2024-01-01 01:00:00").first().total_anomalies == 2
    assert prices.recent_anomalies(stored, products, "2024-01-03 01:00:00").count() == 0
