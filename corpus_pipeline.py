"""The corpus pipeline: quality rules, near-duplicate removal, redaction, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept, and returns a DataFrame; all but
the last return the columns of documents. `run` stores each stage's rows in the cluster's shared folder and reads them
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import mixing, neardup, packing, pii, quality
from quillstone.llm.common import drop_table, read, shared_result
from quillstone.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the likelihood ratio reject go."""
    model = quality.fit(docs, "text", "doc_id", quality.trusted_ids(read(spark, sf_dir, "labels")))
    return quality.filtered(docs, "text", model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: the one with the smallest id."""
    return neardup.first_of_each(docs, "text", "doc_id")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by marks."""
    return pii.redact(docs, "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and registers have their target weights."""
    return mixing.mixed(docs, "text", "doc_id", "source", "lang")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs, "text", "doc_id", tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned models and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on its way, and the rows before it, are deleted once its own are stored."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, shared_result(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(before)
    return docs
