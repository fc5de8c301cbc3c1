"""Extension: the report's counts over a folder that log files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators.parse import parse


def read_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path, lineSep="\n")


def with_time(parsed: DataFrame) -> DataFrame:
    """A timestamp ``at`` from the log's own time; null where it is not one."""
    return parsed.withColumn("at", F.try_to_timestamp("time_local", F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def windowed_counts(lines: DataFrame, field: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, key, n: counts by event-time window; state is bounded by the watermark."""
    timed = with_time(parse(lines)).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), F.col(field).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")
