"""Scans: whole files, directories, sections and logs as DataFrames."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom import model as M
from tersloom.functions import text as X


def whole_files(spark: SparkSession, paths: str | list[str], default: str = "markdown", glob: str | None = None) -> DataFrame:
    """path, text, format: a row for each file; the format by the ending, in its exact case. Not recursive."""
    r = spark.read
    r = r.option("pathGlobFilter", glob) if glob else r
    t = r.text(paths, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("format", X.detect_format("path", default))


def text_row(spark: SparkSession, text: str, kind: str = "markdown") -> DataFrame:
    """One document that is already in memory, as from standard input."""
    return spark.createDataFrame([("stdin", text, kind)], "path string, text string, format string")


def directory(spark: SparkSession, path: str, extension: str, kind: str) -> DataFrame:
    """Files of one exact ending, in order of path."""
    return whole_files(spark, path, glob=f"*.{extension}").withColumn("format", F.lit(kind)).orderBy("path")


def sections(spark: SparkSession, root: str, parts: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Union of (subdirectory, ending, format) scans that exist, each with its name as ``section``."""
    out = None
    for sub, extension, kind in parts:
        if exists(spark, f"{root}/{sub}"):
            d = whole_files(spark, f"{root}/{sub}", glob=f"*.{extension}").withColumn("format", F.lit(kind)).withColumn("section", F.lit(sub))
            out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "path string, text string, format string, section string")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def usage_days(spark: SparkSession, root: str, days: int, today: datetime.date | None = None, strict: bool = False) -> DataFrame:
    """The usage logs ``YYYY-MM-DD.jsonl`` of the last ``days`` days; only those files are opened.

    Lenient: malformed lines go, missing fields become "" or 0. Strict: a line without a required field goes too; only agent and project may be missing.
    """
    today = today or datetime.datetime.now(datetime.UTC).date()
    wanted = [f"{root}/{today - datetime.timedelta(days=i)}.jsonl" for i in range(days)]
    return usage_files(spark, [p for p in wanted if exists(spark, p)], strict)


def usage_files(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    from pyspark.sql import types as T

    if not paths:
        return spark.createDataFrame([], M.USAGE_LOG)
    schema = T.StructType([*M.USAGE_LOG.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    d = spark.read.text(paths).select(F.from_json("value", schema, options).alias("j")).filter("j is not null and j._bad is null").select("j.*").drop("_bad")
    if strict:
        need = [f.name for f in M.USAGE_LOG.fields if f.name not in ("agent", "project")]
        d = d.dropna(subset=need)
    return d.select(*(F.coalesce(f.name, F.lit("" if f.dataType == T.StringType() else 0).cast(f.dataType)).alias(f.name) for f in M.USAGE_LOG.fields))


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """All benchmark logs below ``root``; a missing directory gives no rows, bad lines are skipped."""
    if not exists(spark, root):
        return spark.createDataFrame([], M.BENCH_LOG)
    return spark.read.schema(M.BENCH_LOG).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json*").option("recursiveFileLookup", True).json(root)
