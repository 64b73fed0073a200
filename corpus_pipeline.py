"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``; other columns, whatever their names, go along. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidpath.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from braidpath.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts with them.

    Texts are judged whole, however long; repeated rows share a verdict; a score just at the cut stays. Without labels the base
    rules alone decide.
    """
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones being equal, the document with the largest id stays; a null id is the smallest.

    Texts are compared whole, however long; of rows that share text and id one stays.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the least id stays; a null id only where there is no other.

    The fingerprint and the two bits are those of the contract of the operator's query; the README says what that finds. Texts are
    read whole, however long; rows are told apart by id and text, and of rows that share both one stays.
    """
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix visits them, sorted by training position; texts without words are never visited.

    A document, however long, is visited whole; repeated rows are visited each; equal positions are ordered by id.
    """
    return mixing.curriculum(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each visit, with the digests of the ids and of what they decode to.

    Null and empty texts have no ids; texts are encoded whole, however long; repeated rows get equal ids.
    """
    return bpe.encode_documents(docs, bpe.rank_file())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("curriculum_mix", mixed), ("byte_bpe", encoded)]

#: Boosted trees, XXH64 fingerprints and merges aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
