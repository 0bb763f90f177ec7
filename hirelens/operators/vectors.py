"""Built-in text encoder: a pyspark.ml pipeline
HashingTF -> IDF -> Normalizer(p=2) over the terms of the whole cleaned text
(``window`` cuts it only for callers whose model has an input limit). It is lexical, not the reference's sentence model; what carries over
is the interface (text in, unit vector out) and the unit norm. IDF.fit is one
distributed aggregation (document frequencies), transform is a map."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import text_window
from hirelens.operators.skills import tokens
from hirelens.session import materialize


def encoder(num_features: int) -> Pipeline:
    return Pipeline(stages=[
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features", p=2.0),
    ])


def tfidf_vectors(docs: DataFrame, id_col: str, text_col: str, num_features: int,
                  window: int | None = None) -> DataFrame:
    """id, features (unit vector), nnz, norm (1.0, or 0.0 for a text with no token)."""
    # fit (IDF document frequencies) and transform both read the input: write it once
    text = F.col(text_col) if window is None else text_window(F.col(text_col), window)
    inp = materialize(docs.select(id_col, text.alias("_text")), "encoder-input")
    terms = inp.select(id_col, tokens(F.col("_text")).alias("_tok"))
    out = encoder(num_features).fit(terms).transform(terms)
    # most slots are 0: they go before the lambda sums the others
    filled = F.array_remove(vector_to_array(F.col("features")), 0.0)
    return out.select(id_col, "features", F.explode(F.array(filled)).alias("_filled")).select(
        id_col, "features", F.size("_filled").alias("nnz"),
        F.round(F.sqrt(F.aggregate("_filled", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))
