"""Join helpers.

``join_dimension`` broadcasts the small side only after proving its size: it counts the
rows and adds up the bytes of at most ``max_rows + 1`` rows of the (already projected)
side. Past either bound it falls back to a plain join, which Spark plans as a shuffled sort-merge join (AQE may still
convert it at run time from measured sizes, and splits skewed partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION_MAX_ROWS = 1_000_000
DIMENSION_MAX_BYTES = 64 << 20      # of values, as they are counted by ``_row_bytes``


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has no more than ``max_rows`` rows; reads at most max_rows + 1."""
    return df.limit(max_rows + 1).count() <= max_rows


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: texts and nested values by length, others 16 each."""
    def size(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            return F.octet_length(F.col(f"`{f.name}`"))
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            return F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        return F.lit(16)
    return sum((F.coalesce(size(f), F.lit(0)) for f in df.schema.fields), F.lit(16))


def is_small(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS,
             max_bytes: int = DIMENSION_MAX_BYTES) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows of ``max_bytes`` bytes together."""
    n, size = (df.limit(max_rows + 1).select(_row_bytes(df).cast("long").alias("b"))
               .agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first())
    return n <= max_rows and size <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int = DIMENSION_MAX_ROWS) -> DataFrame:
    return fact.join(maybe_broadcast(dim, max_rows), on, how)


def broadcast_if_within(df: DataFrame, bound: int | None) -> DataFrame | None:
    """``broadcast(df)`` when ``df`` is proven to hold at most ``bound`` rows, else None."""
    if bound is not None and has_at_most(df, bound):
        return F.broadcast(df)
    return None
