"""Writers: chunked upload files, exports with their manifest, NDJSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.dates import iso_text
from tallymart.session import drop_folder, exists, folders, make_folder

RECORDS_PER_CHUNK = 10_000
EXPORT_FORMATS = ["csv", "parquet", "json"]


def write_chunks(
    df: DataFrame, path: str, fmt: str = "ndjson", records: int = RECORDS_PER_CHUNK, compress: bool = False
) -> None:
    """Write records as chunk files of bounded size: NDJSON, or CSV with a header."""
    writer = df.write.option("maxRecordsPerFile", records)
    if compress:
        writer = writer.option("compression", "gzip")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(path)
    elif df.columns == ["value"]:
        writer.text(path)
    else:
        writer.json(path)


def export_rows(orders: DataFrame, **filters) -> DataFrame:
    """Orders in export form: every column text, a missing customer spelled out, dates in ISO form.

    ``filters`` are equality filters on order columns; a list matches any of its values.
    """
    for column, wanted in filters.items():
        orders = orders.filter(F.col(column).isin(wanted if isinstance(wanted, list) else [wanted]))
    return orders.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.coalesce(F.col("customer_id").cast("string"), F.lit("None")).alias("customer"),
        F.col("total_amount").cast("string").alias("total_amount"),
        F.coalesce(iso_text(F.col("order_date")), F.lit("")).alias("order_date"),
    )


def export(rows: DataFrame, path: str, fmt: str = "csv", ordered: bool = False) -> int:
    """Write an export as a folder of gzipped files; the number of rows, observed while writing.

    The commit protocol publishes files only when their task succeeded, so a lost executor leaves no
    half-written file behind. Rows are written where they are read; ``ordered`` sorts them by order id
    across the files, which costs a shuffle of the whole export.
    """
    if fmt not in EXPORT_FORMATS:
        raise ValueError("unsupported format")
    written = Observation()
    observed = (rows.orderBy("order_id") if ordered else rows).observe(written, F.count("*").alias("rows"))
    writer = observed.write.option("compression", "gzip")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
    return written.get["rows"]


def read_export(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    schema = "order_id string, customer string, total_amount string, order_date string"
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return reader.parquet(*([path] if isinstance(path, str) else path)) if fmt == "parquet" else reader.json(path)


def manifest(spark: SparkSession, path: str, fmt: str, rows: int) -> DataFrame:
    """One row per exported file with the job's totals; only the file listing is read.

    The index is the number Spark gave the part file; parts without rows have no file.
    """
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("chunk_index"),
        F.col("path").alias("storage_path"),
        F.col("length").alias("bytes"),
        F.lit("completed").alias("status"),
        F.lit(fmt).alias("format"),
        F.lit(rows).cast("bigint").alias("rows"),
    )


def ndjson(rows: DataFrame) -> DataFrame:
    """Each row as one JSON line; NULL members are written out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def meta_line(summary: DataFrame) -> DataFrame:
    """The trailing ``_meta`` line of a result stream."""
    return summary.select(F.to_json(F.struct(F.struct("*").alias("_meta"))).alias("value"))


def export_ranges(rows: DataFrame, path: str, key: str = "order_id", ranges: int = 64, wave: int = 16, waves: int | None = None) -> int:
    """Write a gzipped CSV export range by range, and go on where an earlier call ended; the number of ranges written now.

    A range holds the rows of some hashes of the key, so that ranges are even whatever the keys. A wave of ranges is one job; when it
    has succeeded, each of its ranges gets a row in the manifest, and a range with a row there is never written again. What a job
    that failed has left of its wave is replaced. ``waves`` ends the call early. All calls need the same rows and
    number of ranges.
    """
    spark = rows.sparkSession
    planned = folders(spark, f"{path}/_plan")
    if planned and planned != [f"ranges-{ranges}"]:
        raise ValueError(f"the export was begun with {planned[0]}")
    make_folder(spark, f"{path}/_plan/ranges-{ranges}")
    done = {r["range"] for r in ranges_done(spark, path).select("range").collect()}  # a number for each range
    missing = [k for k in range(ranges) if k not in done]
    numbered = rows.withColumn("range", F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"))
    for count, at in enumerate(range(0, len(missing), wave)):
        if count == waves:
            return count * wave
        mine = missing[at : at + wave]
        for k in mine:
            drop_folder(spark, f"{path}/data/range={k}")
        writer = numbered.filter(F.col("range").isin(mine)).repartition(len(mine), "range").write.mode("append").partitionBy("range")
        writer.option("compression", "gzip").option("header", True).option("escape", '"').csv(f"{path}/data")
        there = [k for k in mine if exists(spark, f"{path}/data/range={k}")]
        counted = spark.createDataFrame([(k,) for k in mine], "range int")
        if there:
            read = read_export(spark, [f"{path}/data/range={k}" for k in there]).select(F.col("_metadata.file_path").alias("file"))
            number = F.regexp_extract("file", r"/range=(\d+)/", 1).cast("int").alias("range")
            counted = counted.join(read.groupBy(number).agg(F.count("*").alias("rows")), "range", "left")
        else:
            counted = counted.withColumn("rows", F.lit(None).cast("bigint"))
        counted.select("range", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(missing)


def ranges_done(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an export by ranges: ``range``, ``rows``."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "range int, rows bigint")
    return spark.read.schema("range int, rows bigint").parquet(f"{path}/manifest")
