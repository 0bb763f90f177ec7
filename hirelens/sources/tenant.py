"""A table laid out for reads by user.

Rows are bucketed by user_id and sorted by user and time, so a read of one user opens the files
of one bucket, and an aggregation per user needs no shuffle. A bucket holds many users; a user
with very many rows makes one large bucket, whose file is split by size as any other when it is
read for anything but an aggregation per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 32


def write_user_table(df: DataFrame, name: str, path: str, time_col: str = "created_at", buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` as the table ``name`` with its files in ``path`` and return the table."""
    (df.repartition(buckets, "user_id").write.bucketBy(buckets, "user_id").sortBy("user_id", time_col)
     .option("path", path).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def user_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
