"""Streaming bars: an extension that runs the batch rules on unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def ohlcv(events: DataFrame, every: str = "1 hour", late: str = "1 day", key: str = "user_id", at: str = "ts", price: str = "value") -> DataFrame:
    """Open, high, low, close and count of each key and window; rows later than ``late`` are left out."""
    windowed = events.withWatermark(at, late).groupBy(key, F.window(at, every).alias("w"))
    out = windowed.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day", key: str = "user_id", at: str = "ts") -> DataFrame:
    s = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def unique(events: DataFrame, keys: list[str], late: str = "1 day", at: str = "ts") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain_all(events: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Runs ``build`` of the events, a stream, over all that is there, and then over one more row of the far future, without
    a key: it moves the watermark past every open window, so the table holds the whole result."""
    spark = events.sparkSession
    flush = f"{folder}/flush"
    empty = spark.createDataFrame([], events.schema)
    empty.write.mode("overwrite").parquet(flush)
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(flush))
    drain(build(both), folder)
    kind = events.schema[at].dataType
    last = [F.lit("9000-01-01 00:00:00").cast(kind).alias(c) if c == at else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns]
    spark.range(1).select(*last).write.mode("append").parquet(flush)
    return drain(build(both), folder).where(F.col(key).isNotNull())


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet table and returns it."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/table")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")
