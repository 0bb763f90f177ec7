"""Tables changed by copy-on-write, with versions that readers see whole or not at all.

A table is a folder with ``data`` and ``versions``. Rows belong to parts: values of a part
column, such as the bucket of an id or a week. ``data/_v=N/_part=P`` holds the rows of part P as
version N wrote them; ``versions/v=N`` is one small file that names, for every part of version N,
the version that wrote it. A change writes the touched parts anew under the next number and then
publishes that list, so parts that it does not touch keep their files, and the table's new state
appears at once: the list is one file, renamed into place when its job commits. A write that fails
before leaves rows that no list names; readers go on with the version before.

One writer at a time: the folder of a version's list must not exist, so a second writer of the
same version fails and starts over from the version published meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, WROTE = "_part", "_v"
LIST = "v long, part string, wrote long"


def id_bucket(key: Column | str, buckets: int) -> Column:
    """The part of a row by hash of its key: ``buckets`` parts of about equal size."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def _lists(spark: SparkSession, base: str) -> DataFrame:
    # lists of a few rows a part; their folders are never partly written
    return spark.read.schema(LIST).parquet(f"{base}/versions/v=*")


def versions(spark: SparkSession, base: str) -> list[int]:
    """The published versions, oldest first."""
    return sorted(r.v for r in _lists(spark, base).select("v").distinct().collect())


def parts(spark: SparkSession, base: str, version: int | None = None) -> dict[str, int]:
    """part -> the version that wrote it, of the newest version (or an older one)."""
    version = versions(spark, base)[-1] if version is None else version
    rows = _lists(spark, base).where(F.col("v") == version).where("part is not null")
    return {r.part: r.wrote for r in rows.collect()}      # a row a part


def read_version(spark: SparkSession, base: str, version: int | None = None,
                 only: list[str] | None = None) -> DataFrame:
    """The table as of a version (the newest by default); ``only`` some of its parts, whose
    files alone are read."""
    named = parts(spark, base, version)
    wanted = named if only is None else {p: named[p] for p in only if p in named}
    paths = [f"{base}/data/{WROTE}={v}/{PART}={p}" for p, v in sorted(wanted.items())]
    schema = spark.read.parquet(f"{base}/schema").schema
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _write_parts(df: DataFrame, part: Column, base: str, version: int, order: list[str]) -> list[str]:
    """Write the rows by part, each sorted by ``order``, and return the parts that have rows. A
    part is one task's file: choose parts so that one fits a task (buckets, weeks)."""
    path = f"{base}/data/{WROTE}={version}"
    (df.withColumn(PART, part).repartition(PART).sortWithinPartitions(PART, *order)
     .write.mode("overwrite").partitionBy(PART).parquet(path))
    found = df.sparkSession.read.schema(f"{PART} string").option("basePath", path).parquet(path)
    return [r[0] for r in found.distinct().collect()]


def _publish(spark: SparkSession, base: str, version: int, named: dict[str, int]) -> int:
    """Write the list of a version; a table without rows has one row without a part."""
    rows = [(version, p, v) for p, v in sorted(named.items())] or [(version, None, None)]
    (spark.createDataFrame(rows, LIST).coalesce(1).write.mode("errorifexists")
     .parquet(f"{base}/versions/v={version}"))
    return version


def create(df: DataFrame, base: str, part: Column, order: list[str]) -> int:
    """Write version 0 of a table."""
    spark = df.sparkSession
    df.limit(0).write.mode("errorifexists").parquet(f"{base}/schema")
    return _publish(spark, base, 0, dict.fromkeys(_write_parts(df, part, base, 0, order), 0))


def replace_parts(df: DataFrame, base: str, part: Column, order: list[str], touched: list[str]) -> int:
    """The next version: ``df`` has the rows of the ``touched`` parts, which may be fewer, more
    or none; all other parts stay as they are. Nothing is published if the write fails."""
    spark = df.sparkSession
    named = parts(spark, base)
    version = versions(spark, base)[-1] + 1
    schema = spark.read.parquet(f"{base}/schema").schema
    wrote = _write_parts(df.select(*schema.names), part, base, version, order)
    stray = set(wrote) - set(touched)
    if stray:
        raise ValueError(f"rows of parts that are not replaced: {sorted(stray)[:5]}")
    kept = {p: v for p, v in named.items() if p not in set(touched)}
    return _publish(spark, base, version, kept | dict.fromkeys(wrote, version))
