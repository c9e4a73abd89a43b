"""Retention, layout and reorganisation of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.dates import at, before


def live_keys(keys: DataFrame, as_of) -> DataFrame:
    """Idempotency keys that have not expired."""
    return keys.filter(F.col("expires_at") >= at(as_of))


def live_rows(rows: DataFrame, column: str, as_of, days: int = 90) -> DataFrame:
    """Log rows younger than the retention."""
    return rows.filter(F.col(column) >= before(as_of, days=days))


def cleanup_report(keys: DataFrame, logs: DataFrame, as_of, days: int = 90) -> DataFrame:
    """How many rows a cleanup deletes from each table."""
    no = F.lit(False)
    expired = keys.select((F.col("expires_at") < at(as_of)).alias("key"), no.alias("log"))
    old = logs.select(no.alias("key"), (F.col("created_at") < before(as_of, days=days)).alias("log"))
    return expired.unionByName(old).agg(
        F.count_if("key").alias("expired_idempotency_keys"), F.count_if("log").alias("expired_audit_logs")
    )


def month_of(ts: str = "order_date") -> Column:
    return F.date_format(ts, "yyyy-MM")


def write_by_month(orders: DataFrame, path: str) -> None:
    """Orders partitioned by month of their date.

    Rebalancing brings a month together so that it fills few files, but splits a month that is too
    big for one task.
    """
    dated = orders.withColumn("order_month", month_of())
    dated.hint("rebalance", "order_month").write.partitionBy("order_month").parquet(path)


def write_by_tenant(products: DataFrame, path: str, buckets: int = 8) -> None:
    """Products spread over a fixed number of tenant buckets, as folders that a tenant filter can prune."""
    bucket = F.pmod(F.hash("tenant_id"), F.lit(buckets))
    products.withColumn("tenant_bucket", bucket).hint("rebalance", "tenant_bucket").write.partitionBy("tenant_bucket").parquet(path)


def tenant_bucket(tenant_id: Column, buckets: int = 8) -> Column:
    return F.pmod(F.hash(tenant_id), F.lit(buckets))


def union_periods(parts: list[DataFrame], tenant_id=None) -> DataFrame:
    """One table from period tables, each filtered by tenant before the union."""
    scoped = [p if tenant_id is None else p.filter(F.col("tenant_id") == tenant_id) for p in parts]
    return reduce(DataFrame.unionByName, scoped)


def with_source(orders: DataFrame) -> DataFrame:
    """Orders with the payload's source as a column, fit for partitioning or statistics."""
    return orders.withColumn("source", F.get_json_object("raw_payload", "$.source"))
