"""Session helpers: building one for tests, and finding the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass the session you have instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymart")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without one uses a folder in the warehouse; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, asked of the file system that Spark uses for the path."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path; none if there is no such path."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())


def drop_folder(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to the place of another one, which goes. Called again after a failure it completes the move."""
    system, place = _file_system(spark, path)
    _, target = _file_system(spark, to)
    system.mkdirs(target.getParent())
    system.delete(target, True)
    if not system.rename(place, target):
        raise OSError(f"cannot move {path} to {to}")


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.mkdirs(place)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of change of a table's files: another one after every change."""
    system, place = _file_system(spark, path)
    files = system.listStatus(place)
    return "|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
