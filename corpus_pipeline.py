"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept; its result is written as Parquet to the shared folder and read again.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from claimspark.llm.catalog import tokenizer_path
from claimspark.llm.common import prepare, table, write_shared
from claimspark.llm.tokens import NARROW


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels that are not held out, doesn't reject."""
    prepare(spark)
    return toxicity.clean_rows(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.keep_one(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by eight tenths of their 5-word shingles."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), room=NARROW)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct_texts),
    ("n-gram jaccard join", distinct_shingles),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed),
]

#: SQL cannot express the trained model or the tokenizer: tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
