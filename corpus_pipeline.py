"""Documents to packed training sequences: five stages, each an operator of lobweave.llm over all that its predecessor kept.

1. toxicity: documents that the ordinal model rejects go;
2. exact dedup: of equal texts the largest doc_id stays;
3. near dedup: of documents joined by a Jaccard similarity of at least 0.8 on
   five-word shingles the smallest doc_id stays;
4. repeats: byte strings of 100 that occur earlier are cut out; what is left of a
   document stays, an empty rest goes;
5. packing: token windows of 2048, one row for each piece with its ids.

Nulls, empty texts, ties, repeats and clashing columns are as each operator says;
a stage given an empty table returns an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lobweave.llm import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from lobweave.llm.common import saved


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedup(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("ngram_jaccard_join", unlike),
    ("suffix_array_dedup", unrepeated),
    ("packing", packed),
]

#: The trained model and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
