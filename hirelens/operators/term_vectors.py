"""TF-IDF term vectors as rows and cosines of explicit pairs.

A text's vector is a row per distinct term of the whole text: count * ln((texts + 1) /
(texts with the term + 1)), scaled to length 1. Rows have no fixed dimension, so different
terms never share a slot. Null and empty texts have no rows; a term found in every text
weighs 0, and a text of such terms only keeps zero rows.

A text's terms are counted within its row and its vector is built in one row too, so no task
holds a table of the terms of many texts. Where terms are spread over rows, tasks get about
``TASK_TERMS`` of them each, however many there are. The vocabulary, a row per term, is
broadcast where its measured rows and bytes allow and otherwise joined by shuffle, where
adaptive execution splits the hot terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.scoring import percent
from hirelens.operators.joins import is_small
from hirelens.operators.skills import tokens
from hirelens.session import materialize

TASK_TERMS = 1_000_000      # terms of texts that one task is given


def _once(c: Column) -> Column:
    """``c`` as a column that later steps read; the generator keeps Spark from copying its
    expression into them."""
    return F.explode(F.array(c))


def _counted(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, terms: every row's distinct terms with how often they stand in it."""
    toks = F.sort_array(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    t = texts.select(id_col, _once(toks).alias("_s"))
    first = F.array_compact(F.transform(
        "_s", lambda x, i: F.when((i == 0) | (x != F.get(F.col("_s"), i - 1)), i)))
    t = t.select(id_col, "_s", _once(first).alias("_first"))
    following = F.slice("_first", 2, F.size("_first"))
    tf = F.zip_with("_first", following, lambda a, b: (F.coalesce(b, F.size("_s")) - a).cast("long"))
    return t.select(id_col, F.arrays_zip(F.array_distinct("_s").alias("term"), tf.alias("tf")).alias("terms"))


def _rows(counts: DataFrame, id_col: str, outer: bool = False) -> DataFrame:
    each = (F.explode_outer if outer else F.explode)("terms").alias("t")
    return counts.select(id_col, each).select(id_col, "t.term", "t.tf")


def text_vectors(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, vector (array of term, weight), a row per id that has a term; rows with the same
    id are read as one text."""
    counts = materialize(_counted(texts, id_col, text_col), "term-counts")
    rows, spread = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n = counts.select(id_col).distinct().count()
    parts = -(-spread // TASK_TERMS) or 1
    if rows != n:       # texts in several rows
        summed = _rows(counts.repartition(parts, id_col), id_col, outer=True).groupBy(id_col, "term").agg(
            F.sum("tf").alias("tf"))
        counts = materialize(summed.groupBy(id_col).agg(
            F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms")), "term-counts")
    vocabulary = materialize(_rows(counts, id_col).groupBy("term").agg(
        F.log(F.lit(float(n + 1)) / (F.count(F.lit(1)) + 1)).alias("idf")), "vocabulary")
    if is_small(vocabulary):
        tf = _rows(counts.repartition(parts, id_col), id_col).join(F.broadcast(vocabulary), "term")
    else:
        tf = _rows(counts, id_col).join(vocabulary, "term").repartition(parts, id_col)
    raw = tf.groupBy(id_col).agg(
        F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    weight = F.transform("_v", lambda x: F.struct(
        x["term"].alias("term"),
        F.when(F.col("_norm") > 0, x["w"] / F.col("_norm")).otherwise(F.lit(0.0)).alias("weight")))
    return raw.select(id_col, "_v", _once(norm).alias("_norm")).select(id_col, weight.alias("vector"))


def term_weights(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, term, weight; rows with the same id are read as one text."""
    return (text_vectors(texts, id_col, text_col).select(id_col, F.explode("vector").alias("v"))
            .select(id_col, "v.term", "v.weight"))


def vector_cosines(pairs: DataFrame, left: str, right: str, left_vectors: DataFrame, right_vectors: DataFrame,
                   id_col: str) -> DataFrame:
    """``pairs`` with score, the cosine of the vectors of its two ids clamped to [0, 1] (0 for an
    id without a vector), and percent (M5). A pair's vectors meet in its row: sorted together,
    a term that both have stands twice in a row."""
    a = left_vectors.select(F.col(id_col).alias(left), F.col("vector").alias("_a"))
    b = right_vectors.select(F.col(id_col).alias(right), F.col("vector").alias("_b"))
    met = pairs.join(a, left, "left").join(b, right, "left")
    met = met.withColumn("_s", _once(F.sort_array(F.concat("_a", "_b"))))
    shared = F.zip_with("_s", F.slice("_s", 2, F.size("_s")), lambda x, y: F.when(
        x["term"] == y["term"], x["weight"] * y["weight"]).otherwise(F.lit(0.0)))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot, F.lit(0.0)))), 6)
    rest = [c for c in pairs.columns if c not in (left, right)]
    return met.select(left, right, *rest, score.alias("score")).withColumn("percent", percent(F.col("score")))


def pair_cosines(pairs: DataFrame, left: str, right: str, weights: DataFrame, id_col: str) -> DataFrame:
    """V2 for the given pairs of text ids (two columns of ``pairs``) and term weights as rows:
    cosine of their term vectors, clamped to [0, 1], and the percent (M5). Work grows with the
    pairs' terms."""
    vectors = (weights.repartition(id_col).groupBy(id_col, "term").agg(F.sum("weight").alias("weight"))
               .groupBy(id_col).agg(F.collect_list(F.struct("term", "weight")).alias("vector")))
    return vector_cosines(pairs, left, right, vectors, vectors, id_col)
