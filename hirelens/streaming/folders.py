"""Append sinks of micro-batches that are folded from time to time.

Each micro-batch owns a folder, which a replayed batch overwrites. ``fold_batches`` folds all
folders so far into one and publishes their number in a one-row file; readers take the newest
fold and the folders after it, so old folders are never read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def start_sink(spark: SparkSession, out: str, schema) -> None:
    """An empty first folder: the sink can be read before, or without, any micro-batch."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/batches/batch_id=-1")


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``, which may run a batch again after a failure: a replay replaces its
    own rows."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batches/batch_id={batch_id}")
    return sink


def compacted_upto(spark: SparkSession, out: str) -> int:
    """The last batch of the newest published fold, -2 before there is one."""
    spark.createDataFrame([], "upto long").write.mode("ignore").parquet(f"{out}/published/first")
    row = spark.read.schema("upto long").parquet(f"{out}/published/*").agg(F.max("upto")).first()
    return -2 if row[0] is None else row[0]


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of the newest fold and of the folders after it, with ``batch_id``; those of the
    fold have the number of its last batch."""
    upto = compacted_upto(spark, out)
    rows = spark.read.schema(f"{schema}, batch_id long").parquet(f"{out}/batches").filter(F.col("batch_id") > upto)
    if upto > -2:
        folded = spark.read.schema(schema).parquet(f"{out}/compact/upto={upto}")
        rows = rows.unionByName(folded.withColumn("batch_id", F.lit(upto).cast("long")))
    return rows


def fold_batches(spark: SparkSession, out: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> int:
    """Folds every batch written so far into one folder and publishes it; returns the last
    batch in it. ``fold`` turns the rows of ``read_batches`` into rows of ``schema``. Safe to run
    again: an unpublished folder is overwritten, and a replay of a folded batch is not read."""
    found = spark.read.schema(f"{schema}, batch_id long").parquet(f"{out}/batches").inputFiles()
    last = max(int(f.split("batch_id=")[1].split("/")[0]) for f in found)
    if last > compacted_upto(spark, out):
        fold(read_batches(spark, out, schema)).write.mode("overwrite").parquet(f"{out}/compact/upto={last}")
        (spark.createDataFrame([(last,)], "upto long").coalesce(1).write.mode("overwrite")
         .parquet(f"{out}/published/upto-{last}"))
    return last
