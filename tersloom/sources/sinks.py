"""Sinks: text, JSON, CSV and append-only logs, all by Spark's committing writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersloom.functions import text as X


def write_text(df: DataFrame, path: str, column: str = "content", mode: str = "error") -> None:
    df.select(column).write.mode(mode).text(path)


def as_json(df: DataFrame) -> DataFrame:
    """``value``: input_tok, output_tok, reduction_pct (a string with one decimal) and content as one JSON object."""
    pct = F.format_string("%.1f", X.reduction_pct(F.col("input_tok"), F.col("output_tok")))
    return df.select(F.to_json(F.struct("input_tok", "output_tok", pct.alias("reduction_pct"), "content")).alias("value"))


def stats_line(df: DataFrame) -> DataFrame:
    """``value``: tokens before and after, and the reduction, for people."""
    return df.select(F.concat(X.spaced_thousands(F.col("input_tok")), F.lit(" -> "), X.spaced_thousands(F.col("output_tok")), F.lit(" tokens ("), F.format_string("%.1f", X.reduction_pct(F.col("input_tok"), F.col("output_tok"))), F.lit("%)")).alias("value"))


def append_usage(df: DataFrame, path: str) -> None:
    """Usage rows into a folder a day."""
    df.withColumn("date", F.substring("ts", 1, 10)).write.mode("append").partitionBy("date").json(path)


def write_run(df: DataFrame, path: str) -> None:
    """Benchmark rows into a folder a run; a run is written once."""
    df.write.mode("append").partitionBy("run_id").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
