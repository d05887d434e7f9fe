"""Session helpers: settings for local use, and intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only where the session names none, as in local tests, a
    temporary one is set; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foliomill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
BROADCAST_BYTES = 10_000_000


def sized_broadcasts(spark: SparkSession) -> None:
    """Let no table be broadcast on an estimate: the planner's guess for a scan of a few wide columns is far too low. Adaptive
    execution still broadcasts a side that it has measured to be under BROADCAST_BYTES."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST_BYTES)


def removed(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, is computed once, and any
    executor can read it again after a loss. The table is removed by released() or when the driver ends."""
    spark = df.sparkSession
    sized_broadcasts(spark)
    path = f"{shared_folder(spark)}/foliomill-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(removed, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def released(df: DataFrame) -> None:
    """Remove the table of a staged DataFrame that nothing reads any more."""
    path = _PATHS.pop(df, None)
    if path:
        removed(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer; for passes that cost far more than moving the rows.
    A large table has more partitions than cores and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    sized_broadcasts(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")
