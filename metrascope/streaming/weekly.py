"""Event-time twins of the batch rates: tumbling weeks, sliding totals, sessions, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rate_columns
from ..workspace import shared_dir, stored

# Weeks begin on Mondays, four days after the epoch's Thursday.
WEEK, MONDAY, LATE = "7 days", "4 days", "2 days"


def event_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream over the Parquet files of a table (one file or a folder)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    place, store = stored(spark, path)
    if store.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def timed(events: DataFrame, at: str) -> DataFrame:
    """Event time as a timestamp of the session's zone, which is UTC here."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def weekly_counts(events: DataFrame, positive, at: str = "ts", late: str = LATE) -> DataFrame:
    """(week, n, k) of tumbling Monday weeks; events later than the watermark are dropped."""
    week = F.window(at, WEEK, WEEK, MONDAY)
    told = timed(events, at).withWatermark(at, late).groupBy(week).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("k"))
    return told.select(F.date_format("window.start", "yyyy-MM-dd").alias("bucket"), "n", "k")


def sliding_totals(events: DataFrame, at: str = "ts", span: str = "28 days", step: str = "7 days", late: str = LATE) -> DataFrame:
    """(start, n) of sliding windows."""
    told = timed(events, at).withWatermark(at, late).groupBy(F.window(at, span, step, MONDAY)).agg(F.count(F.lit(1)).alias("n"))
    return told.select(F.col("window.start").alias("start"), "n")


def user_sessions(events: DataFrame, key: str, gap: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """(key, start, end, n) of sessions that a pause longer than ``gap`` ends."""
    told = timed(events, at).withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return told.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_versions(events: DataFrame, keys: list[str], at: str = "ts", late: str = LATE) -> DataFrame:
    """The first row seen of each key within the watermark."""
    return timed(events, at).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result; for aggregates of few rows."""
    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/{name}").start().awaitTermination()
    return spark.table(name)


def weekly_rates(spark: SparkSession, path: str) -> DataFrame:
    """Weekly rates of purchases, from a stream."""
    told = run_to_table(weekly_counts(event_stream(spark, path), F.col("event_type") == "purchase"))
    return told.select("bucket", *rate_columns(F.col("k"), F.col("n")))
