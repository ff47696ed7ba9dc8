"""Append-only ledgers as streams: windowed sums with a watermark, an extension of the batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, phase, calls, client_ms) by tumbling windows, for a batch or a stream; late: how long a stream waits."""
    d = events.withWatermark("ts", late) if late else events
    g = d.groupBy(F.window("ts", size).alias("w"), "phase").agg(F.count("*").alias("calls"), F.sum("client_ms").alias("client_ms"))
    return g.select(F.col("w.start").alias("start"), "phase", "calls", "client_ms")


def file_stream(spark: SparkSession, folder: str, schema, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).format(form).load(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there into Parquet, exactly once, and stops."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
