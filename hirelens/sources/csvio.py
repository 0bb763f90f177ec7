"""CSV scans and writes.

Schemas are always given (never inferred). Descriptions hold newlines: quoting is RFC-4180
(the quote doubles as the escape) and writes quote the same way. Tables without line breaks in
their values are read by Spark's CSV reader, which splits files by lines (``read_csv``).

``read_csv_records`` reads files whose values hold line breaks with several tasks a file, and
numbers the records by file and place. The text source deals out byte ranges; whether a range
begins inside a quoted value follows from the number of quotes before it, a prefix sum of one
bit per range. With that known each task puts its lines together to records, and only the ends
of ranges, at most two pieces each, are joined in a shuffle. After the scan, the missing-value
tokens a pandas reader would treat as missing are normalised to null, so dropna sees the same
rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: pandas' default missing-value tokens -----------------------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# ---------------------------------------------------------------------------------

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None,
             multi_line: bool = True) -> DataFrame:
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    df = spark.read.schema(schema).options(**options).csv(path)
    if columns:
        df = df.select(*columns)
    return _missing_as_null(df)


def _missing_as_null(df: DataFrame) -> DataFrame:
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.when(~F.col(f.name).isin(*NA_TOKENS), F.col(f.name)))
    return df


# ---- files with line breaks in values, many tasks a file -----------------------------

PLACE = ["file", "start", "line"]       # of a record: its file, its byte range's start, its first line there
_PIECES = "file string, start long, line long, whole boolean, goes_on boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), value: physical lines, in order within a range."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _quotes_before(lines: DataFrame) -> list[tuple[str, int]]:
    """The ranges that begin inside a quoted value. One row per range meets in a window over a
    file's ranges; what reaches the driver is an entry per such range."""
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    per = lines.groupBy("file", "start").agg(F.sum(quotes).alias("q"))
    w = Window.partitionBy("file").orderBy("start")
    odd = per.select("file", "start", (F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).alias("odd"),
                     (F.sum("q").over(Window.partitionBy("file")) % 2).alias("open"))
    rows = odd.where("odd = 1 or open = 1").collect()
    unclosed = sorted({r.file for r in rows if r.open})
    if unclosed:
        raise ValueError(f"a quoted value is not closed in {unclosed[:3]}")
    return [(r.file, r.start) for r in rows]


def _assembler(inside: frozenset):
    """Lines of byte ranges to records and pieces of records. A record ends with the line
    after which the number of quotes is even."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, first, goes_on, open_, n = None, [], 0, False, False, 0
        for b in batches:
            out: list[tuple] = []
            for file, start, value in zip(*(c.to_pylist() for c in b.columns)):
                if (file, start) != here:
                    if held:
                        out.append((*here, first, False, goes_on, "\n".join(held)))
                    here, held, n = (file, start), [], 0
                    goes_on = open_ = here in inside
                if not held:
                    first = n
                held.append(value)
                open_ ^= value.count('"') % 2 == 1
                n += 1
                if not open_:
                    out.append((file, start, first, not goes_on, goes_on, "\n".join(held)))
                    held, goes_on = [], False
            yield _pieces(out)
        if held:
            yield _pieces([(*here, first, False, goes_on, "\n".join(held))])
    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    columns = zip(*rows) if rows else ((),) * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*PLACE, "whole", "goes_on", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, start, line, text of every record, blank lines left out. A file that ends inside
    a quoted value is an error."""
    lines = _lines(spark, path)
    pieces = lines.mapInArrow(_assembler(frozenset(_quotes_before(lines))), _PIECES)
    parts = pieces.where("not whole")
    # a piece that goes on belongs to the record that the last piece before it began
    record = F.count(F.when(~F.col("goes_on"), 1)).over(Window.partitionBy("file").orderBy("start", "line"))
    joined = (parts.withColumn("record", record).groupBy("file", "record")
              .agg(F.array_sort(F.collect_list(F.struct("start", "line", "text"))).alias("p"))
              .select("file", F.get("p", F.lit(0)).getField("start").alias("start"), F.get("p", F.lit(0)).getField("line").alias("line"),
                      F.array_join("p.text", "\n").alias("text")))
    every = pieces.where("whole").select(*PLACE, "text").unionByName(joined)
    return every.withColumn("text", F.rtrim("text", F.lit("\r"))).where("text <> ''")


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType,
                     columns: list[str] | None = None) -> DataFrame:
    """The columns of CSV files with a header line each, and ``position``, by which the rows
    have the order of the files (by name) and of the lines in them."""
    header = (F.col("start") == 0) & (F.col("line") == 0)
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    rows = csv_records(spark, path).where(~header).select(
        F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"), F.struct(*PLACE).alias("position"))
    return _missing_as_null(rows.select(*(f"r.{c}" for c in columns or schema.names), "position"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).option("quoteAll", "true").mode("overwrite").csv(path)
