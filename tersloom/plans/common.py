"""Tables, derived inputs and SQL pieces that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom import model as M

# Words frequent in the test data, so that stopword removal has something to remove.
DATA_STOPWORDS = ("thatin", "ononst", "inoran", "hehely", "orantion", "thble", "thing", "thtion", "nicht", "mente", "erble", "attion", "ertion")
LINE_WORDS = "(?i)\\b(?:" + "|".join(sorted(DATA_STOPWORDS, key=lambda w: (-len(w), w))) + ")\\b[ \\t]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Deals a table of few large files to all cores before per-document work; a table of enough files stays."""
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def paragraphs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """V1: every line a paragraph."""
    return documents(spark, sf_dir, *columns).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: a usage log made of events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    out = F.floor(F.col("value") * F.when(k % 10 == 0, 1.2).otherwise(0.8)).cast("long")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.col("event_type").alias("agent"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("p"), (k % 4).cast("string"))).alias("project"),
        F.concat(F.lit("file"), (F.col("user_id") % 50).cast("string"), F.lit(".md")).alias("file"),
        F.element_at(F.array(*map(F.lit, M.FORMATS)), (k % 3 + 1).cast("int")).alias("format"),
        F.element_at(F.array(*map(F.lit, M.FIDELITIES)), (F.col("event_id") % 3 + 1).cast("int")).alias("fidelity"),
        F.floor("value").cast("long").alias("input_tok"),
        out.alias("output_tok"),
    ).withColumn("saved", F.greatest(F.col("input_tok") - F.col("output_tok"), F.lit(0))).withColumn("reduction_pct", F.when(F.col("input_tok") == 0, 0.0).otherwise(F.round(100.0 - F.col("output_tok") / F.col("input_tok") * 100.0, 1)))


USAGE_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
log0 AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS agent, CASE WHEN k % 4 = 0 THEN '' ELSE 'p' || (k % 4) END AS project, 'file' || (user_id % 50) || '.md' AS file,
  ['plaintext', 'markdown', 'html'][(k % 3 + 1)::INT] AS format, ['lossless', 'semantic', 'compressed'][(event_id % 3 + 1)::INT] AS fidelity,
  floor(value)::BIGINT AS input_tok, floor(value * CASE WHEN k % 10 = 0 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END)::BIGINT AS output_tok FROM ev),
log AS (SELECT *, greatest(input_tok - output_tok, 0) AS saved, CASE WHEN input_tok = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE - output_tok::DOUBLE / input_tok * 100.0::DOUBLE, 1) END AS reduction_pct FROM log0)"""

#: Blocks of V1 with their place; every block is a paragraph, as no line begins with a header mark.
PARAS_SQL = r"""
raw AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS bs FROM documents),
blocks AS (SELECT doc_id, generate_subscripts(bs, 1) - 1 AS idx, unnest(bs) AS text FROM raw),
paras AS (SELECT doc_id, idx, text,
  greatest(0.1::FLOAT, least(1.0::FLOAT, (CASE WHEN idx = 0 THEN 1.0::FLOAT WHEN idx = 1 THEN 0.95::FLOAT WHEN idx = 2 THEN 0.9::FLOAT WHEN idx <= 5 THEN 0.8::FLOAT WHEN idx <= 10 THEN 0.65::FLOAT ELSE 0.5::FLOAT END * 0.5::FLOAT
    + CASE WHEN length(text) <= 15 THEN 0.3::FLOAT WHEN length(text) <= 40 THEN 0.55::FLOAT WHEN length(text) <= 80 THEN 0.75::FLOAT WHEN length(text) <= 200 THEN 0.9::FLOAT ELSE 1.0::FLOAT END * 0.4::FLOAT)
    + CASE WHEN idx = 0 THEN 1.0::FLOAT ELSE 0.0::FLOAT END * 0.1::FLOAT)) AS importance FROM blocks)"""

#: Heuristic tokens of text without scripts of two or three characters to a token, as in the test tables.
TOKENS_SQL = "greatest(1, ceil(length({0}) / 4.0))::BIGINT"
SQUEEZE_SQL = r"trim(regexp_replace({0}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B]+', ' ', 'g'))"
