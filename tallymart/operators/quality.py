"""Data-quality checks over the loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_customer(orders: DataFrame) -> DataFrame:
    """Orders whose customer snapshot is incomplete, with or without a customer id."""
    incomplete = F.col("customer_name_snapshot").isNull() | F.col("customer_email_snapshot").isNull()
    return orders.filter(incomplete).select(
        "order_id",
        "external_order_id",
        "customer_id",
        "customer_name_snapshot",
        "customer_email_snapshot",
        "order_date",
    )


def dangling(children: DataFrame, reference: str, parents: DataFrame, key: str, check: str) -> DataFrame:
    """How many child rows, and how many distinct values, refer to a parent that is not there.

    Children are counted per referenced value before the join: a hot value travels as one row.
    """
    referenced = children.filter(F.col(reference).isNotNull()).groupBy(F.col(reference).alias(key)).count()
    lost = referenced.join(parents.select(key), key, "left_anti")
    return lost.agg(
        F.lit(check).alias("check_name"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("dangling_rows"),
        F.count("*").alias("dangling_values"),
    )


def integrity_checks(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """The three reference checks as one table; all zeros on sound data."""
    checks = [
        dangling(orders, "customer_id", customers, "customer_id", "orders_without_customer"),
        dangling(items, "product_id", products, "product_id", "items_without_product"),
        dangling(items, "order_id", orders, "order_id", "items_without_order"),
    ]
    return reduce(DataFrame.unionByName, checks)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))

    return reduce(DataFrame.unionByName, (counted(n, df) for n, df in tables.items()))
