"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, of every stage: an empty table gives an empty one; extra columns stay as they are, whatever their names;
the order of rows means nothing; repeated rows count as rows of their own except in near-dedup, where equal rows are
copies.  Language ID drops null, empty and letterless texts, and with no label at all keeps every row.  Near-dedup keeps
a row of each group, that of the smallest known doc_id, or where none is known one row of each text.  Decontamination
and secret scans keep rows with a null text or doc_id as they are.  The last stage takes a null text as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontamination, language_id, secrets, sentencepiece_sampling, simhash_bktree
from tidelog.llm.common import delete_at_exit, delete_path, released, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash_bktree.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold test items."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts."""
    return secrets.redacted(docs)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text to its sampled segmentations."""
    return sentencepiece_sampling.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("sentencepiece", sample_segmentations),
]

#: The stages train models, build trees and sample, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's input and inner tables are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, base)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with released():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{k}_{name}")
        if k:
            delete_path(spark, f"{base}/{k - 1}_{STAGES[k - 1][0]}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
