"""Price event streams: intake of requests and the anomaly feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators import prices
from tallymart.session import drop_folder, exists, folders

#: Folders of an expiry day, by hash of the key.
BUCKETS = 16


def _bucket():
    return F.pmod(F.xxhash64(*prices.KEYS), F.lit(BUCKETS)).cast("int")


def recorded_keys(spark: SparkSession, folder: str, requests: DataFrame, batch: int) -> DataFrame | None:
    """Keys of earlier batches that may answer these requests.

    Only folders are read whose expiry day is not before the earliest request and whose hash a request has.
    """
    if not exists(spark, f"{folder}/keys"):
        return None
    first, wanted = requests.agg(F.min("received_at").cast("date"), F.collect_set(_bucket())).first()  # BUCKETS numbers at most
    keys = spark.read.option("basePath", f"{folder}/keys").parquet(f"{folder}/keys")
    return keys.filter((F.col("expires") >= F.lit(first)) & F.col("bucket").isin(wanted) & (F.col("batch") < batch))


def settled_requests(spark: SparkSession, folder: str, requests: DataFrame, batch: int) -> DataFrame | None:
    """Requests of earlier batches admitted in a minute of these requests: at most the tenant limit for each tenant and minute."""
    if not exists(spark, f"{folder}/admitted"):
        return None
    minute = F.date_trunc("minute", "received_at")
    minutes = requests.select(minute.alias("minute")).distinct()
    first, last = requests.agg(F.min("received_at").cast("date"), F.max("received_at").cast("date")).first()
    admitted = spark.read.parquet(f"{folder}/admitted").filter(F.col("day").between(first, last) & (F.col("batch") < batch))
    return admitted.withColumn("minute", minute).join(minutes, "minute", "left_semi").drop("minute", "day", "batch")


def intake_into(folder: str, products: DataFrame) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler that answers requests and stores outcomes, recorded keys and admissions.

    A batch sees what earlier batches stored, so running it again after a failure gives the same result and replaces the same folders.
    Within a micro-batch, keys do not expire.
    """

    def apply(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        if requests.isEmpty():
            return
        known, settled = recorded_keys(spark, folder, requests, batch), settled_requests(spark, folder, requests, batch)
        place = f"{folder}/outcomes/batch={batch}"
        prices.intake(requests, products, known, settled).write.mode("overwrite").parquet(place)
        outcomes = spark.read.parquet(place)

        def add(rows: DataFrame, name: str, *by: str) -> None:
            writer = rows.withColumn("batch", F.lit(batch)).repartition(*by).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(f"{folder}/{name}")

        keys = prices.idempotency_records(outcomes).withColumns({"expires": F.to_date("expires_at"), "bucket": _bucket()})
        add(keys, "keys", "expires", "bucket")
        # Admitted is also what was then refused for its prices.
        admitted = outcomes.filter((F.col("status") == prices.PROCESSED) | F.col("error").isin(prices.NOT_POSITIVE, prices.OUT_OF_RANGE))
        add(admitted.select("event_id", "tenant_id", "product_id", "received_at", F.to_date("received_at").alias("day")), "admitted", "day")

    return apply


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The outcome of every request so far."""
    return spark.read.parquet(f"{folder}/outcomes").drop("batch")


def drop_expired(spark: SparkSession, folder: str, day: str) -> list[str]:
    """Remove recorded keys that expired before the day (yyyy-MM-dd), and admissions before it: whole folders, none is rewritten."""
    gone = []
    for name, column in (("keys", "expires"), ("admitted", "day")):
        old = [f for f in folders(spark, f"{folder}/{name}") if f.startswith(f"{column}=") and f.removeprefix(f"{column}=") < day]
        for found in old:
            drop_folder(spark, f"{folder}/{name}/{found}")
        gone += [f"{name}/{f}" for f in old]
    return gone


def anomaly_feed(price_events: DataFrame, products: DataFrame) -> DataFrame:
    """The feed of flagged events as they are stored, with product data; rejected requests and replays are never stored."""
    return prices.anomalies(price_events, products)


def feed_lines(feed: DataFrame) -> DataFrame:
    """The feed as JSON lines for a text sink."""
    return feed.select(F.to_json(F.struct(*feed.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
