"""The corpus pipeline: documents are filtered in four stages and then encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the rows it returns are written and read again as the next stage's docs.
The filtering stages return all columns of their docs, also ones that carry
names used by an operator. A null or empty text passes through every stage like
any other text; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from lendlens.llm.common import fresh, table
from lendlens.operators.cache import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking predicts to be good; it learns from their labels."""
    name = fresh(docs, "score")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score=name).filter(F.col(name) >= 0.5).drop(name)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    name = fresh(docs, "found")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), found=name)
    return found.filter(F.size(F.col(f"{name}.hits")) == 0).drop(name)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests, and the digest of what decoding gives back."""
    tokenizer = bpe.Tokenizer(bpe.ranks_of(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    encoded = tokenizer.encode(docs.select("doc_id", "text"))
    return bpe.digests(encoded, tokenizer, keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("near dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

# a learned ranking decides the first stage, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
