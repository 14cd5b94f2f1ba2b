"""A corpus pipeline of five stages over the operators of lodegauge.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents.

Every stage gives an empty table for an empty one. Nulls: a null or wordless text goes in the first stage; a null source
or language is one of its own; rows with a null doc_id are judged by their text, and of equal ones one stays. Repeated
rows are judged alike until one of them stays in the third stage; ties are broken by the least doc_id, then by text. Extra
columns, of whatever name, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegauge.llm import jaccard_join, language_id, mixing, piece_sampling, quality_rules
from lodegauge.sources import scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with a posterior of a half, go."""
    return language_id.keep_identified(docs, 0.5)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, one document stays."""
    return jaccard_join.one_of_each(docs, 5, 80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the sources' targets ask."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document: doc_id, n_pieces, ids, lossless."""
    return piece_sampling.encode(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("language_id", known_language),
    ("jaccard_join", without_copies),
    ("mixing", mixed),
    ("piece_sampling", encoded),
]

#: SQL expresses neither the language model nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote for itself goes when it is done, and its
    predecessor's table with it."""
    docs = scratch.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch.scope() as keep:
            keep(docs := scratch.written(stage(spark, before, sf_dir), name))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
