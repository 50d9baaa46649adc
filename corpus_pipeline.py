"""From raw documents to packed training sequences: language, exact copies, near copies, source mix, packing.

Every stage takes (spark, docs, sf_dir), docs having the columns of ``documents`` and perhaps more, works on all rows it is
given and returns those columns; the last returns the pieces of sequences. Repeated rows, null columns, empty texts and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, jaccard, language, mixing, packing
from factloom.plans.session import materialize, tune

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
NEAR = jaccard.Similarity(words=5, percent=80)
ORACLE_SQL = None  # tokenisation and clustering have no SQL; tests/llm compares every stage with plain Python


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language like those seen; others, and texts without a letter, go."""
    found = language.identify(docs, language.train(docs))
    return found.filter("NOT __rejected").drop("__lang", "__score", "__rejected")


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id; rows without an id stay."""
    return jaccard.one_of_each(docs, like=NEAR)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it; the last one of a source up to its last word taken."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language", known_language), ("exact_dedup", no_copies), ("jaccard_join", no_near_copies), ("source_mixing", mixed_sources), ("best_fit", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
