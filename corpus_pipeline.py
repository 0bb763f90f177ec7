"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents that the model calls toxic go (operator 4).
2. line dedup: later copies of repeated line runs are deleted (operator 7).
3. near dedup: one document of each group of near-duplicates stays (operator 3).
4. mix: sources are mixed to their target weights; documents repeat or go (operator 8).
5. pack: documents are tokenized and packed into sequences (operator 2).

Each stage works on all that its predecessor kept, and all but the last return the columns of
``documents``. Empty tables pass through every stage; null and empty texts are kept by the
first three stages, have no words to mix and so go in the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelens.llm import line_dedup, mixing, near_dup, packing, toxicity
from hirelens.llm.common import materialize
from hirelens.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near),
          ("mix", mix_sources), ("pack", pack)]

#: Learned scores and subword ids are outside SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
