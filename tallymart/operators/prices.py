"""Price change events: intake with idempotency and admission limits, anomaly classes, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.dates import before
from tallymart.functions.money import pct_change, stored_pct
from tallymart.session import stored

# Admission limits, thresholds in percent, and the texts clients see.
TENANT_LIMIT = 100
PRODUCT_LIMIT = 10
EXTREME_PCT = 50
SIGNIFICANT_PCT = 25
NOTABLE_PCT = 10
NOTABLE_ABOVE_PRICE = 100
EXTREME_TEXT = "Extreme price change: "
SIGNIFICANT_TEXT = "Significant price change: "
NOTABLE_TEXT = "Notable price change for high-value item: "
PROCESSED, REPLAYED, REJECTED = "processed", "already_processed", "rejected"
NO_PRODUCT = "Product not found"
NO_KEY = "Idempotency-Key header required"
LIMITED = "Rate limit exceeded"
NOT_POSITIVE = "Prices must be positive"
OUT_OF_RANGE = "pct_change out of range"

KEY_LIFETIME_HOURS = 24
KEYS = ["tenant_id", "idempotency_key"]


def arrival() -> list[Column]:
    """The order in which requests are answered."""
    return [F.asc("received_at"), F.asc("event_id")]


def at_least(old: Column, new: Column, percent: int) -> Column:
    """Whether the change is at least so many percent: exact, and without a division."""
    return F.abs(new - old) * 100 >= old * percent


def is_anomaly(old: Column, new: Column) -> Column:
    notable = at_least(old, new, NOTABLE_PCT) & (old > NOTABLE_ABOVE_PRICE)
    return F.coalesce((old > 0) & (at_least(old, new, SIGNIFICANT_PCT) | notable), F.lit(False))


def anomaly_reason(old: Column, new: Column) -> Column:
    """Anomaly text, NULL for an ordinary change. Classes are decided on the unrounded percentage."""
    label = (
        F.when(at_least(old, new, EXTREME_PCT), EXTREME_TEXT)
        .when(at_least(old, new, SIGNIFICANT_PCT), SIGNIFICANT_TEXT)
        .otherwise(NOTABLE_TEXT)
    )
    # One digit, ties to even.
    shown = F.bround(pct_change(old, new), 1).cast("decimal(20,1)").cast("string")
    return F.when(is_anomaly(old, new), F.concat(label, shown, F.lit("%")))


def with_change(events: DataFrame) -> DataFrame:
    """Percentage change as stored, anomaly flag and text."""
    old, new = F.col("old_price"), F.col("new_price")
    return events.withColumns(
        {
            "pct_change": stored_pct(pct_change(old, new)),
            "anomaly_flag": is_anomaly(old, new),
            "anomaly_reason": anomaly_reason(old, new),
        }
    )


def price_error() -> Column:
    """Why a price pair cannot be stored, NULL when it can; needs ``pct_change``."""
    positive = (F.col("old_price") > 0) & (F.col("new_price") > 0)
    return F.when(~F.coalesce(positive, F.lit(False)), NOT_POSITIVE).when(
        F.col("pct_change").isNull(), OUT_OF_RANGE
    )


def admit_per_minute(attempts: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Requests within both limits of their clock minute.

    The product limit is applied first and only admitted requests use up the tenant's quota, which
    equals checking both counters one request at a time. Both ranks are bounded, so Spark keeps at
    most that many rows of a group per map task before it shuffles. ``settled`` holds requests of these minutes that were
    admitted earlier: they keep their places.
    """
    order = arrival()
    if settled is not None:
        attempts = attempts.withColumn("_new", F.lit(True)).unionByName(settled.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        order = ["_new", *order]
    minute = F.date_trunc("minute", "received_at")
    by_product = F.row_number().over(Window.partitionBy("product_id", minute).orderBy(*order))
    by_tenant = F.row_number().over(Window.partitionBy("tenant_id", minute).orderBy(*order))
    within = attempts.withColumn("_place", by_product).filter(F.col("_place") <= PRODUCT_LIMIT).drop("_place")
    within = within.withColumn("_place", by_tenant).filter(F.col("_place") <= TENANT_LIMIT).drop("_place")
    return within if settled is None else within.filter("_new").drop("_new")


def _winners(processed: DataFrame) -> DataFrame:
    """The first stored request of each key; combined before the shuffle, whatever the key's share of the rows."""
    return processed.filter("good").groupBy(*KEYS).agg(F.min(F.struct("received_at", "event_id")).alias("winner"))


def settle(requests: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Who is a replay and who is admitted, as if requests were answered one at a time.

    ``requests`` (event_id, tenant_id, product_id, received_at, idempotency_key, good: could be stored if admitted) gains
    ``answered_by`` (the event that a replay names) and ``admitted``. A key answers later requests once one of its requests was
    stored; a request refused by a limit or for its prices leaves the key free, and its retry is counted and judged anew.

    What a request meets depends on earlier requests only, so there is one consistent outcome. It is found in rounds: from the first
    stored request of each key as known so far follows who attempts, from that who is admitted, from that the first
    stored request. A round settles at least the earliest request still judged wrongly; the rounds end when nothing changes.
    """
    rows = stored(requests, "price-requests")
    winners, was = _winners(rows), None
    while True:
        winners = stored(winners, "price-winners")
        state = tuple(winners.agg(F.count("*"), F.sum(F.xxhash64(*KEYS, "winner").cast("decimal(38,0)"))).first())
        judged = rows.join(winners, KEYS, "left")
        attempts = F.col("winner").isNull() | (F.struct("received_at", "event_id") <= F.col("winner"))
        admitted = admit_per_minute(judged.filter(attempts).drop("winner"), settled)
        if state == was:
            break
        winners, was = _winners(admitted), state
    return judged.join(admitted.select("event_id", F.lit(True).alias("admitted")), "event_id", "left").select(
        *rows.columns, F.when(~attempts, F.col("winner.event_id")).alias("answered_by"), "admitted"
    )


def intake(
    events: DataFrame, products: DataFrame, known_keys: DataFrame | None = None, settled: DataFrame | None = None
) -> DataFrame:
    """Every request with its outcome: product check, idempotency, admission, price check, classification.

    ``known_keys`` (tenant_id, idempotency_key, expires_at, event_id) holds recorded keys: until they expire they answer
    every request. ``settled`` are requests admitted earlier, whose minutes may go on. A replay names the event that answers it in
    ``answered_by``. Decisions are made on narrow rows and brought back by the unique event id, so no hot
    tenant, product or key is joined as a group.
    """
    listed = products.select("tenant_id", "product_id", F.lit(True).alias("listed"))
    found = with_change(events.join(listed, ["tenant_id", "product_id"], "left"))
    eligible = found.filter(F.col("listed") & F.col("idempotency_key").isNotNull()).select(
        "event_id", "tenant_id", "product_id", "received_at", "idempotency_key", price_error().isNull().alias("good")
    )
    if known_keys is None:
        decided = settle(eligible, settled)
    else:
        live = known_keys.groupBy(*KEYS).agg(F.max(F.struct("expires_at", "event_id")).alias("known"))
        met = stored(eligible.join(live, KEYS, "left"), "price-known")
        answered = F.coalesce(F.col("known.expires_at") >= F.col("received_at"), F.lit(False))
        replays = met.filter(answered).withColumns({"answered_by": F.col("known.event_id"), "admitted": F.lit(None).cast("boolean")})
        decided = settle(met.filter(~answered).drop("known"), settled).unionByName(replays.drop("known"))
    decisions = decided.select("event_id", "answered_by", "admitted", F.lit(True).alias("eligible"))
    replay = F.col("eligible").isNotNull() & F.col("admitted").isNull() & F.col("answered_by").isNotNull()
    error = (
        F.when(F.col("listed").isNull(), NO_PRODUCT)
        .when(F.col("idempotency_key").isNull(), NO_KEY)
        .when(replay, None)
        .when(F.col("admitted").isNull(), LIMITED)
        .otherwise(price_error())
    )
    status = F.when(replay, REPLAYED).when(error.isNull(), PROCESSED).otherwise(REJECTED)
    ok = F.col("status") == PROCESSED
    return (
        found.join(decisions, "event_id", "left")
        .withColumns({"error": error, "status": status})
        .select(
            *events.columns,
            "status",
            "error",
            F.when(ok, F.col("pct_change")).alias("pct_change"),
            (ok & F.col("anomaly_flag")).alias("anomaly_flag"),
            F.when(ok, F.col("anomaly_reason")).alias("anomaly_reason"),
            F.when(ok, F.col("event_id")).otherwise(F.col("answered_by")).alias("answered_by"),
        )
    )


def _metadata() -> Column:
    """The request's metadata, a JSON text; unreadable text stays a text."""
    read = F.try_parse_json("metadata")
    return F.coalesce(read, F.to_variant_object(F.struct(F.col("metadata").alias("value"))))


def stored_events(outcomes: DataFrame) -> DataFrame:
    """Rows of the price event table."""
    return outcomes.filter(F.col("status") == PROCESSED).select(
        "event_id",
        "tenant_id",
        "product_id",
        "old_price",
        "new_price",
        "pct_change",
        "anomaly_flag",
        F.to_json(F.struct("source", "anomaly_reason", F.when(F.col("metadata").isNotNull(), _metadata()).alias("metadata"))).alias("meta"),
        "received_at",
    )


def idempotency_records(outcomes: DataFrame) -> DataFrame:
    """Rows of the idempotency key table, valid for a day."""
    given = F.when(F.col("metadata").isNotNull(), _metadata()).alias("metadata")
    body = F.to_json(F.struct(given, "new_price", "old_price", "source"))  # in order of the names
    return outcomes.filter(F.col("status") == PROCESSED).select(
        *KEYS,
        "event_id",
        F.sha2(body, 256).alias("request_hash"),
        F.to_json(F.struct("event_id", "anomaly_flag", "anomaly_reason", "status")).alias("response_summary"),
        F.lit("completed").alias("status"),
        F.col("received_at").alias("created_at"),
        (F.col("received_at") + F.make_dt_interval(F.lit(0), F.lit(KEY_LIFETIME_HOURS))).alias("expires_at"),
    )


def anomalies(price_events: DataFrame, products: DataFrame, as_of=None, hours: int | None = 24) -> DataFrame:
    """Flagged events of the look-back window with the fields of the feed; the events may be a stream."""
    names = products.select("tenant_id", "product_id", F.col("name").alias("product_name"))
    flagged = price_events.filter("anomaly_flag").join(names, ["tenant_id", "product_id"], "left")
    if as_of is not None and hours is not None:
        flagged = flagged.filter(F.col("received_at") >= before(as_of, hours=hours))
    return flagged.select(
        "event_id",
        "tenant_id",
        "product_id",
        "product_name",
        F.col("old_price").cast("double").alias("old_price"),
        F.col("new_price").cast("double").alias("new_price"),
        F.col("pct_change").cast("double").alias("pct_change"),
        F.get_json_object("meta", "$.anomaly_reason").alias("anomaly_reason"),
        F.get_json_object("meta", "$.source").alias("source"),
        F.get_json_object("meta", "$.metadata").alias("metadata"),
        "received_at",
    )


def recent_anomalies(price_events: DataFrame, products: DataFrame, as_of, *, hours: int = 24, limit: int = 100) -> DataFrame:
    """The newest ``limit`` anomalies of each product."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("received_at"), F.desc("event_id"))
    return (
        anomalies(price_events, products, as_of, hours)
        .withColumn("_place", F.row_number().over(newest))
        .filter(F.col("_place") <= limit)
        .drop("_place")
        .orderBy("product_id", F.desc("received_at"), F.desc("event_id"))
    )


def anomaly_summary(price_events: DataFrame, as_of, *, hours: int = 24) -> DataFrame:
    """The closing line of each product's feed: how many anomalies there were."""
    flagged = price_events.filter("anomaly_flag").filter(F.col("received_at") >= before(as_of, hours=hours))
    per_product = flagged.groupBy("tenant_id", "product_id").count()
    return per_product.select(
        "tenant_id",
        "product_id",
        F.col("count").alias("total_anomalies"),
        F.lit(hours).alias("time_range_hours"),
    )
