"""Incremental file ingestion: new upload files are loaded as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators.loading import check_csv, check_ndjson, load, staging_folder
from tallymart.schemas import LOAD_ORDER
from tallymart.session import stored
from tallymart.sources import csv
from tallymart.sources.files import UNKNOWN_KIND, is_csv, route
from tallymart.sources.store import TableStore


def arriving_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of uploads with their file and split; the checkpoint knows which files are done."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .option("lineSep", "\n")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )


def apply_to(store: TableStore, tenant_id: str, as_of, source: str | None = None) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler that loads each record type, parents first, from NDJSON and CSV uploads.

    A micro-batch holds whole files. Its lines are staged once by type, numbered in read order, which is what CSV records are put
    together by. Files of unknown type are recorded as rejects under ``_rejects/unknown``, one row each. ``source`` names
    the stream in the store and is the tenant unless given; streams with checkpoints of their own need names of their own.
    """
    source = source or f"stream-{tenant_id}"

    def apply(lines: DataFrame, batch: int) -> None:
        part = f"source={source}/batch={batch}"
        file = F.col("file")
        arrived = staging_folder(store, "lines", as_of, batch, source, "_arrived")
        placed = csv.numbered(lines).withColumns({"kind": F.coalesce(route(file), F.lit("unknown")), "csv": is_csv(file)})
        placed.write.mode("overwrite").partitionBy("kind", "csv").parquet(arrived)
        staged = store.spark.read.schema(placed.schema).parquet(arrived)
        failed = staged.filter(F.col("kind") == "unknown").groupBy("file", F.lit(UNKNOWN_KIND).alias("reason")).count()
        failed.write.mode("overwrite").parquet(f"{store.root}/_rejects/unknown/{part}")
        there = {(r["kind"], r["csv"]) for r in staged.select("kind", "csv").distinct().collect()}
        for kind in LOAD_ORDER:
            mine = staged.filter(F.col("kind") == kind)
            parts = []
            if (kind, False) in there:
                parts.append(check_ndjson(mine.filter("not csv").select("file", "block", "pos", "value"), kind, tenant_id, as_of))
            if (kind, True) in there:
                rows = mine.filter("csv").drop("kind", "csv")
                borders = stored(csv.splits(rows), "csv-splits")
                parts.append(check_csv(csv.with_cells(rows, borders), kind, tenant_id, as_of))
            if parts:
                rejected = load(store, kind, reduce(DataFrame.unionByName, parts), as_of, batch, source).rejected
                rejected.write.mode("overwrite").parquet(f"{store.root}/_rejects/{kind}/{part}")

    return apply
