"""A corpus pipeline of four stages over documents: toxicity, exact dedup, n-gram Jaccard join, packing.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet in the shared folder and reads it again for the next. All but the last keep the columns of documents.
Null columns, empty texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.llm import exact_dedup, jaccard, packing, toxicity
from tracequill.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model rejects (score 0.7 or more) go."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as pieces of sequences of 4096 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("packing", pack)]

#: The stages can't be said in SQL: a fitted model comes first and a tokenizer last. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
