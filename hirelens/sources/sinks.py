"""Sinks and parameterised tenant reads.

Parquet has no in-place update, so a changed table is written as a new snapshot folder
and readers switch to it; JSON records are written with ``to_json`` on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the metadata record's nested values: JSON text in a DataFrame, objects in the stored record
NESTED = {
    "top_categories": T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("count", T.LongType())])),
    "exp_distribution": T.MapType(T.StringType(), T.LongType()),
}

METADATA_SCHEMA = T.StructType([
    T.StructField("trained_at", T.StringType()),
    T.StructField("total_jds", T.LongType()),
    T.StructField("total_categories", T.LongType()),
    T.StructField("top_categories", NESTED["top_categories"]),
    T.StructField("exp_distribution", NESTED["exp_distribution"]),
    T.StructField("retrain_threshold", T.IntegerType()),
    T.StructField("analyses_since_retrain", T.IntegerType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("embedding_dim", T.IntegerType()),
])


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a table version to a new folder (never over the one being read)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_json_records(df: DataFrame, path: str) -> str:
    """One JSON object per row (``to_json(struct(*))``) as text files."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")).write.text(path)
    return path


def rows_of_user(spark: SparkSession, view: str, user_id, status: str | None = None) -> DataFrame:
    """S3 + P1 + P2: the tenant read with bound parameters (no string splicing of values);
    the status filter is added only when given. Catalyst pushes both into the scan."""
    sql = f"SELECT * FROM {view} WHERE user_id = :uid"
    args = {"uid": user_id}
    if status is not None:
        sql += " AND status = :status"
        args["status"] = status
    return spark.sql(sql, args=args)


def write_corpus_artefacts(final: DataFrame, metadata: DataFrame | Callable[[DataFrame], DataFrame], base: str) -> str:
    """S6 + S7 + S8: the corpus table (Parquet, one row per posting, so no positional lists;
    a vector column, where there is one, is part of the row) and the one-row metadata record
    (JSON, lists and maps as such). ``metadata`` may be a function of the corpus, which then gets
    the table as it was written, so that it is neither computed nor written twice."""
    write_snapshot(final, f"{base}/corpus")
    if callable(metadata):
        metadata = metadata(final.sparkSession.read.parquet(f"{base}/corpus"))
    nested = metadata.withColumns({c: F.from_json(c, t) for c, t in NESTED.items()})
    write_json_records(nested, f"{base}/metadata")
    return base


def load_corpus_artefacts(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Load both artefacts with fixed schemas (no inference)."""
    return (spark.read.parquet(f"{base}/corpus"),
            spark.read.schema(METADATA_SCHEMA).json(f"{base}/metadata"))
