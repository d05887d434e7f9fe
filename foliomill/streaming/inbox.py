"""A folder that files arrive in, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import file_type
from ..sources.files import documents

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def inbox(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Files as they arrive, at most per_trigger in a batch."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)


def once(files: DataFrame, wait: str = "1 day") -> DataFrame:
    """Drops files whose content came before, within the watermark, so that the state stays bounded."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", wait).dropDuplicatesWithinWatermark(["digest"])


def extracted(files: DataFrame) -> DataFrame:
    """Markdown of the files that documents() reads."""
    return documents(files.where(file_type(F.col("path")).isin("docx", "pptx", "html")))


def arrivals(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """How many rows arrived per key and window of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
