"""Skew-safe ordering helpers.

``position_within`` numbers the rows of each key group (1, 2, ...) in a given order
without putting a whole group in one task: the data is range-partitioned on
(key, order), so a hot key spreads over many partitions; each row gets its index
inside its (partition, key) slice, and a small per-(partition, key) count table gives
the offset contributed by earlier partitions. Every step's group is bounded by one
range partition, not by the size of a key.

The partition ids must be the same in both branches (row index and offsets), so the
range-partitioned data is written once as a table in the cluster's shared checkpoint
folder; both branches read that copy (each file keeps its partition id), and the
lineage is cut there (a lost executor re-reads it instead of recomputing the range
sampling).
"""

from __future__ import annotations

from hirelens.session import ensure_checkpoint_dir, materialize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_RANGE = 1_000_000     # rows a range partition should hold


def _partitions(df: DataFrame) -> int:
    """Range partitions for ``df``: the session's shuffle partitions, or more when the
    data is larger (counted; a projection of a Parquet table counts from its footers)."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-df.count() // ROWS_PER_RANGE))


def position_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    n = num_partitions or _partitions(df)
    ensure_checkpoint_dir(df.sparkSession)
    key_cols = [F.col(k).asc_nulls_first() for k in keys]
    ranged = materialize(df.repartitionByRange(n, *key_cols, *order)
                         .withColumn("_pid", F.spark_partition_id()), "ranked")
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)))
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_pid").alias("_opid"),
                            *[F.col(k).alias(f"_o_{k}") for k in keys],
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    # null keys form a group of their own, as in a window: the join must match them too
    same = F.col("_pid") == F.col("_opid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return (local.join(offsets, same)
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("int"))
            .drop("_pid", "_local", "_off", "_opid", *[f"_o_{k}" for k in keys]))


def top_k_within(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_col: str,
                 name: str = "rank", salts: int = 16) -> DataFrame:
    """Exact top-k per key (k bounded): rank inside (key, salt) slices first and keep
    k per slice, then rank the <= k * salts survivors per key. ``order`` must be a
    total order (end it with a unique column) so ties are deterministic. The salt is a
    hash of ``salt_col``, so a retried task puts every row in the same slice again."""
    salt = F.abs(F.xxhash64(F.col(salt_col))) % salts
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = (df.withColumn("_salt", salt)
             .withColumn("_r1", F.row_number().over(w1))
             .filter(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= k)
