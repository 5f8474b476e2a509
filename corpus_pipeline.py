"""The corpus pipeline: quality rules, line dedup, near copies, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_runs, near_copies, packing, private_data, quality
from tidemark.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more leave the texts; a document whose every word
    stands in such a copy goes, so that no emptied text is packed."""
    return line_runs.drop_emptied(docs)


def near_copy_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the least doc_id stays."""
    return near_copies.keep_one(docs)


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked by their kind."""
    return private_data.mask_private(docs, private_data.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its sequence and the ids' checksum."""
    return packing.digest(packing.pack(docs, with_ids=False))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copy_join),
    ("PII", private_spans),
    ("packing", pack_sequences),
]

#: Compression ratios, fitted span models and BPE ids have no SQL form; tests/llm/test_pipeline.py holds
#: each stage and the whole against plain forms.

#: Odd rows: a null or empty text has no words and goes in the first stage; rows of one doc_id are one
#: document to the second and third stage; equal documents leave the least doc_id; columns of other
#: names, whatever they are, pass through to the last stage, which returns its own. Empty tables give none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
