"""Tenant loading and request resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.dates import parse_timestamp
from tallymart.functions.ids import api_key_digest, canonical_uuid
from tallymart.operators.upsert import first_per_key, insert_new, last_per_key, upsert
from tallymart.sources import csv

CREATED, UPDATED, SKIPPED, ERROR = "created", "updated", "skipped", "error"
FILE_COLUMNS = ["tenant_id", "name", "api_key_hash", "created_at"]
NO_KEY, BAD_KEY, MISMATCH, OK = "X-API-Key header required", "Invalid API key", "Tenant ID mismatch", "ok"


def load_plan(existing: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """What a tenant file would do to each of its rows."""
    known = existing.select("tenant_id", F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), CREATED).otherwise(UPDATED if overwrite else SKIPPED)
    return incoming.join(known, "tenant_id", "left").withColumn("action", action).drop("_known")


def apply_plan(existing: DataFrame, plan: DataFrame) -> DataFrame:
    """The tenant table after the load."""
    written = plan.filter(F.col("action") != SKIPPED).select(existing.columns)
    return existing.join(written, "tenant_id", "left_anti").unionByName(written)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tenant file, with their place and why a row cannot be loaded (``reason``)."""
    found = csv.scan(spark, path)

    def cell(name: str):
        place = F.array_position("header", name).cast("int")
        return F.try_element_at("cells", F.when(place > 0, place))

    text = found.select("file", "block", "pos", *(cell(c).alias(f"_{c}") for c in FILE_COLUMNS))
    typed = text.withColumns(
        {
            "tenant_id": canonical_uuid(F.col("_tenant_id")),
            "name": F.col("_name"),
            "api_key_hash": F.col("_api_key_hash"),
            "created_at": parse_timestamp(F.col("_created_at")),
        }
    )
    reason = F.lit(None).cast("string")
    for column in reversed(FILE_COLUMNS):
        missing = F.col(f"_{column}").isNull()
        unreadable = F.concat(F.lit(f"Invalid {column} format: "), F.col(f"_{column}"))
        reason = F.when(missing, f"Missing required field: {column}").when(F.col(column).isNull(), unreadable).otherwise(reason)
    return typed.withColumn("reason", reason).withColumn("given_id", F.col("_tenant_id")).drop(*(f"_{c}" for c in FILE_COLUMNS))


def load_file(existing: DataFrame, rows: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """What became of each row of ``read_file``, and the tenant table afterwards.

    Rows are taken in file order: the first of an id creates its tenant unless the table has it; later ones update it (``overwrite``)
    or are skipped. Rows with a ``reason`` are errors and change nothing; the rest of the file is loaded.
    """
    # Rows that cannot be loaded have no place among the repeats of an id.
    good = rows.filter(F.col("reason").isNull())
    order = ["file", "block", "pos"]
    first = first_per_key(good, ["tenant_id"], *(F.asc(c) for c in order)).select("tenant_id", F.struct(*order).alias("_first"))
    both = existing.select("tenant_id", F.lit(True).alias("_known")).join(first, "tenant_id", "full")
    again = F.col("_known").isNotNull() | (F.struct(*order) != F.col("_first"))
    outcome = F.when(F.col("reason").isNotNull(), ERROR).when(~again, CREATED).otherwise(UPDATED if overwrite else SKIPPED)
    outcomes = rows.join(both, "tenant_id", "left").select(*rows.columns, outcome.alias("outcome"))
    taken = last_per_key(good, ["tenant_id"], *order) if overwrite else first_per_key(good, ["tenant_id"], *(F.asc(c) for c in order))
    taken = taken.select(existing.columns)
    if overwrite:
        return outcomes, upsert(existing, taken, ["tenant_id"])
    return outcomes, insert_new(existing, taken, ["tenant_id"])


def preview(incoming: DataFrame, limit: int = 5) -> DataFrame:
    """First tenants of a file with the key they will use; nothing is written."""
    return incoming.orderBy("tenant_id").limit(limit).select(
        "tenant_id", "name", F.concat(F.lit("api_key_"), F.col("tenant_id").cast("string")).alias("api_key")
    )


def resolve(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests with the tenant their key belongs to and the outcome of the check.

    A key may be sent raw or already hashed. Both readings are looked up by equality; the hash of a
    key is never another tenant's hash, so at most one matches.
    """
    holder = tenants.select(F.col("api_key_hash").alias("_hash"), F.col("tenant_id").alias("key_tenant"))
    # One reading per row, then one equi-join.
    readings = requests.withColumn(
        "_hash", F.explode_outer(F.array_distinct(F.array(F.col("api_key"), api_key_digest(F.col("api_key")))))
    )
    found = readings.join(holder, "_hash").select("request_id", "key_tenant")
    resolved = requests.join(found, "request_id", "left")
    outcome = (
        F.when(F.col("api_key").isNull() | (F.col("api_key") == ""), NO_KEY)
        .when(F.col("key_tenant").isNull(), BAD_KEY)
        .when(F.col("key_tenant") != F.col("tenant_id"), MISMATCH)
        .otherwise(OK)
    )
    return resolved.withColumn("outcome", outcome)
