"""Structured Streaming: documents are self-contained, so their jobs keep no state; daily usage keeps a watermarked window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom import model as M
from tersloom.operators import documents as D


def document_stream(spark: SparkSession, path: str, schema, files: int = M.CHANNEL_SIZE) -> DataFrame:
    """Parquet files of documents as they arrive; ``files`` a trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files)).parquet(path)


def transpiled(stream: DataFrame, **options) -> DataFrame:
    return D.transpile(stream, **options)


def chunks(stream: DataFrame, **options) -> DataFrame:
    return D.stream_chunks(stream, **options)


def daily_usage(stream: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Calls and sums by day and agent; a day closes once the watermark has passed it."""
    t = stream.withColumn("at", F.to_timestamp(ts)).withWatermark("at", late)
    g = t.groupBy(F.window("at", "1 day"), "agent").agg(F.count("*").alias("calls"), F.sum("input_tok").alias("input_tok"), F.sum("output_tok").alias("output_tok"), F.sum("saved").alias("saved"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "agent", "calls", "input_tok", "output_tok", "saved")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """All input that is there, then stop; rows land in the in-memory table ``name``."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
