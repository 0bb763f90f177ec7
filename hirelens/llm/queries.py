"""Registered queries of the training-data operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import (
    conversation_repair,
    line_dedup,
    mixing,
    near_dup,
    packing,
    pages,
    pii,
    prefix_trie,
    quality,
    rules,
    token_counts,
    toxicity,
    vector_search,
)
from hirelens.llm.oracle import ORACLE  # noqa: F401 - read by the driver entry
from hirelens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


@_register
def op1_quality(spark, d):
    return quality.quality(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@_register
def op2_packing(spark, d):
    return packing.pack_documents(read_table(spark, d, "documents"))


@_register
def op3_near_dup(spark, d):
    return near_dup.near_duplicates(read_table(spark, d, "documents"), width=2)


@_register
def op4_toxicity(spark, d):
    return toxicity.toxicity(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@_register
def op5_personal_data(spark, d):
    return pii.personal_data(read_table(spark, d, "documents"))


@_register
def op6_vector_search(spark, d):
    return vector_search.search(read_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@_register
def op7_line_dedup(spark, d):
    return line_dedup.line_dedup(read_table(spark, d, "documents"))


@_register
def op8_mixing(spark, d):
    return mixing.mix(read_table(spark, d, "documents"))


@_register
def op9_quality_rules(spark, d):
    return rules.quality_rules(read_table(spark, d, "documents"))


@_register
def op10_pages(spark, d):
    return pages.extract(read_table(spark, d, "pages"))


@_register
def op11_prefix_trie(spark, d):
    return prefix_trie.rebuilt_trie(read_table(spark, d, "conversations"))


@_register
def op12_conversation_repair(spark, d):
    turns = read_table(spark, d, "conversations")
    return conversation_repair.report(conversation_repair.damage(turns), turns)


@_register
def op13_token_counts(spark, d):
    return token_counts.token_counts(read_table(spark, d, "documents"))
