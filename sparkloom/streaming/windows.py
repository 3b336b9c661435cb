"""Structured Streaming over event files: watermarked windows, written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import new_path
from ..sources.views import micros


def as_pattern(path: str) -> str:
    """``path`` as a pattern that matches just it, whether it is a file or a folder; a stream takes a file only by a pattern."""
    plain = path.rstrip("/")
    escaped = "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in plain[:-1])
    return f"{escaped}[{plain[-1]}]" if plain[-1] not in "[]{}*?\\^-" else f"{escaped}\\{plain[-1]}"


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over the parquet file or folder at ``path``; as a pattern it may be either."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(path))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def window_counts(events: DataFrame, width: str = "6 hours", late: str = "2 days") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, label: str, mode: str = "update", home: str | None = None) -> DataFrame:
    """Run a stream over all that is there; each batch overwrites its own folder, so a repeated batch adds nothing.

    Returns every update, with its batch number.
    """
    spark = stream.sparkSession
    home = home or new_path(spark, label)

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{home}/out/b{number}")

    stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_no", T.LongType())])
    return spark.read.schema(schema).parquet(f"{home}/out/*")


def windowed_totals(spark: SparkSession, path: str) -> DataFrame:
    updates = drain(window_counts(events_stream(spark, path)), "windows")
    # the last update of a window holds its totals
    last = updates.groupBy(micros("window.start").alias("start_us"), "event_type").agg(F.max(F.struct("batch_no", "n", "total")).alias("u"))
    return last.select("start_us", "event_type", "u.n", F.round("u.total", 4).alias("total"))


def session_spans(events: DataFrame, quiet: str = "30 minutes") -> DataFrame:
    """(user_id, first_us, last_us, n): sessions that end after a quiet time, by session windows; works on streams too."""
    by = events.groupBy("user_id", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return by.select("user_id", micros("w.start").alias("first_us"), micros("last").alias("last_us"), "n")


def counters(events: DataFrame) -> DataFrame:
    """(user_id, event_type, n, last_us) so far; on a stream the counts are its state."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max(micros("ts")).alias("last_us"))


def running_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters after the last batch of a drained stream."""
    updates = drain(counters(events_stream(spark, path)), "counters")
    return updates.groupBy("user_id", "event_type").agg(F.max("n").alias("n"), F.max("last_us").alias("last_us"))
