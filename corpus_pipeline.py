"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed, texts are encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Near duplicates are those whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more. Part of the subpackage tersloom.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tersloom.llm import bpe, jaccard, lines, mixing, toxicity
from tersloom.llm.common import dropped, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on a bounded sample of the labelled documents among ``docs``; documents that score as toxic go. Null and empty texts hold no token and
    stay; each of repeated rows is scored; long texts are scored whole; no documents or labels: everything stays; further columns are carried along."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays at its first occurrence only; documents that lose all their words go. Null, empty and wordless texts stay as they are; rows that
    repeat an id and a text are one document and keep the same lines; ties go to the smallest (id, text hash, line); an empty table gives no rows."""
    return lines.without_duplicate_lines(docs)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id, of rows that share it the smallest text. Texts without a word and rows with
    a null id stay; an empty table gives no rows; further columns are carried along."""
    return jaccard.one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as their source's target takes them. Null and empty texts have no word to take and go; null sources are one source; equal
    ids are ordered by size; an empty table gives no rows; further columns are carried along."""
    return mixing.mixture(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encoded(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A fitted model, near-duplicate components and a tokenizer are none of them SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)  # the table of the stage before, if there is one
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
