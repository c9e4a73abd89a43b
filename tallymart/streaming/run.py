"""Running a stream over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallymart.session import fresh_dir


def arriving(
    spark: SparkSession, path: str, schema: StructType | str, *, files: int | None = None, size: int = 64 << 30
) -> DataFrame:
    """Parquet files as they arrive; the micro-batch is bounded by total size, or by a number of files."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", size) if files is None else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> None:
    """Append everything that is available to a folder, then stop."""
    query = (
        stream.writeStream.format(format)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def each_batch(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Hand every available micro-batch to ``apply``, then stop. A repeated batch keeps its number."""
    query = (
        stream.writeStream.foreachBatch(apply)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def collected(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The stream's output over all available input, as a table in the shared folder."""
    path = fresh_dir(spark, "stream")
    to_table(stream, path, fresh_dir(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)
