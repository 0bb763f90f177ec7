"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines that have a word; equal lines have equal ids. The
suffixes of all documents are sorted by prefix doubling: at level k a suffix's rank orders
the first 2**k lines from it (shorter ones at a document's end first), and the pair of ranks
at i and i + 2**k gives level k + 1. Suffixes whose rank nobody shares can have no longer
common prefix and leave, so only repeated text is sorted on.

A repeated run counts when it has at least ``min_words`` words. Each of its lines lies in a
window of the run that is the shortest with that many words from its first line, or from its
last line backwards, and such a window has at most ``min_words`` lines. So the suffixes need
sorting by that many lines only, a bound that does not depend on the data. A window of m
lines stands for the interval of suffixes with a longest common prefix of m or more: the
ranks at its first line and 2**k before its end, 2**k <= m < 2**(k + 1), name that interval.
If the interval holds an earlier suffix, by (doc_id, line), the window is part of a later copy.
The windows of a maximal repeated run cover it whole, and nothing else is deleted.

Copies that overlap themselves count: of ``x x x x`` all but the first stays out, if x is long
enough. Runs shorter than ``min_words`` stay, so short common lines are left alone.

Edge cases: null and empty texts and lines without a word never change; rows that repeat
(equal doc_id and text) count as one document; null ids come first, ties between equal ids are
broken by a hash of the text; an empty table gives an empty result; other columns pass
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import doc_columns, hash_docs, materialize, packed, unpacked
from hirelens.operators.joins import has_at_most

MIN_WORDS = 25
BROADCAST_SPANS = 1_000_000  # rows of two ints and a key: some 30 MB
ORDER = ["doc_id", "th", "pos"]


def _word_lines(text: str) -> list[str]:
    """The lines of a text that have a word (a line is what stands between line feeds)."""
    return [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the length of the shortest run with ``least`` words from it, and of
    the shortest that ends with it; 0 if there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(total, total[:-1] + least, "left")
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    return np.where(end <= n, end - np.arange(n), 0), np.where(start >= 0, np.arange(n) + 1 - start, 0)


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word: doc_id, th (hash of the text), pos, n (lines of the
    document), id1, id2 (hash of the line), fwd and back (window lengths)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, cols = [], [[] for _ in range(6)]
            for i, t in enumerate(b.column(2).to_pylist()):
                found = _word_lines(t or "")
                if not found:
                    continue
                n = len(found)
                count = np.concatenate([np.diff(w.bounds) for w in hash_docs(found)])
                ids = [xxhash.xxh3_128_intdigest(x) for x in found]
                fwd, back = _windows(count, min_words)
                own.append(np.full(n, i))
                for c, x in zip(cols, (np.arange(n), np.full(n, n), np.array([x >> 65 for x in ids]),
                                       np.array([x & (1 << 63) - 1 for x in ids]), fwd, back)):
                    c.append(x)
            if own:
                at = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at)]
                    + [pa.array(np.concatenate(c).astype(t), pa.from_numpy_dtype(np.dtype(t)))
                       for c, t in zip(cols, ("int32", "int32", "int64", "int64", "int32", "int32"))],
                    ["doc_id", "th", "pos", "n", "id1", "id2", "fwd", "back"])
    return docs.select(docs["doc_id"].cast("long"), _text_hash(docs), docs["text"]).mapInArrow(
        run, "doc_id long, th long, pos int, n int, id1 long, id2 long, fwd int, back int")


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"]).alias("th")


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` whose values of ``by`` occur more than once, with their rank in that order.

    The distinct values are counted (partially before the shuffle), sorted by range and
    numbered; ids grow with the sort order over all partitions. They are written once."""
    values = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    values = materialize(values.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return rows.join(values, list(by))


def _same_doc(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th")))


def suffix_ranks(table: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k, rows (doc_id, th, pos, n, rank) of the suffixes that share their first
    2**k lines (fewer at a document's end) with another suffix."""
    own = ["doc_id", "th", "pos", "n"]
    now = materialize(_ranked(table, "id1", "id2").select(*own, "rank").dropDuplicates(ORDER), "level")
    out = [now]
    for k in range(levels):
        step = 1 << k
        a, b = now.alias("a"), now.alias("b")
        pairs = (a.join(b, _same_doc("a", "b") & (F.col("b.pos") == F.col("a.pos") + step), "left")
                 .where(F.col("b.rank").isNotNull() | (F.col("a.pos") + step >= F.col("a.n")))
                 .select(*[f"a.{c}" for c in own], F.col("a.rank").alias("r1"),
                         F.coalesce("b.rank", F.lit(-1)).alias("r2")))
        pairs = materialize(pairs, "pairs")
        now = materialize(_ranked(pairs, "r1", "r2").select(*own, "rank"), "level")
        out.append(now)
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, first, last): line windows, counted over the lines with a word, that are
    part of a later copy of a repeated run."""
    table = materialize(lines(docs, min_words), "lines")
    levels = max(0, int(min_words).bit_length() - 1)
    ranks = suffix_ranks(table, levels)
    spans = table.select(*ORDER, F.explode(F.array(
        F.struct(F.col("pos").alias("start"), F.col("fwd").alias("m")),
        F.struct((F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("m")))).alias("w")
    ).where("w.m > 0").select("doc_id", "th", "w.start", "w.m").distinct()
    windows = []
    for k, level in enumerate(ranks):
        here = spans.where((F.col("m") >= 1 << k) & (F.col("m") < 1 << (k + 1))).alias("s")
        a, b = level.alias("a"), level.alias("b")
        windows.append(
            here.join(a, _same_doc("s", "a") & (F.col("s.start") == F.col("a.pos")))
            .join(b, _same_doc("s", "b") & (F.col("s.start") + F.col("s.m") - (1 << k) == F.col("b.pos")))
            .select("s.doc_id", "s.th", "s.start", "s.m", F.lit(k).alias("k"),
                    F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2")))
    found = materialize(reduce(DataFrame.unionAll, windows), "windows")
    interval = ["k", "m", "r1", "r2"]
    place = F.struct("doc_id", "th", "start")
    first = materialize(found.groupBy(*interval).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
                        .where("c > 1").drop("c"), "intervals")
    return (found.join(first, interval).where(F.col("first") < place)
            .select("doc_id", "th", F.col("start").alias("first"), (F.col("start") + F.col("m") - 1).alias("last")))


def _cut(text: str, spans: list) -> tuple[str, int]:
    """The text without the lines that ``spans`` cover, and how many those are."""
    gone = np.zeros(len(_word_lines(text)) + 1, int)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["last"] + 1] -= 1
    gone = np.cumsum(gone) > 0
    out, at = [], 0
    for x in text.split("\n"):
        if x.strip(" \t\n\r\x0b\x0c"):
            if not gone[at]:
                out.append(x)
            at += 1
        else:
            out.append(x)
    return "\n".join(out), int(gone[:-1].sum())


def _apply(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """rest, doc_id, text (cut), lines (with a word, before) and removed of every row."""
    spans = materialize(spans.distinct(), "spans")
    per_doc = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    per_doc = per_doc.select(F.col("doc_id").alias("id"), "th", "spans")
    if has_at_most(spans, BROADCAST_SPANS):
        per_doc = F.broadcast(per_doc)
    rows = packed(docs, "doc_id", "text")
    both = rows.join(per_doc, rows["doc_id"].cast("long").eqNullSafe(F.col("id"))
                     & (F.xxhash64(rows["text"]) == F.col("th")), "left").select("rest", "doc_id", "text", "spans")
    schema = T.StructType([*both.schema.fields[:3], *T.StructType.fromDDL("lines int, removed int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            made = [_cut(t, s) if s else (t, 0) for t, s in zip(texts, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([t for t, _ in made], b.column(2).type),
                 pa.array([len(_word_lines(t or "")) for t in texts], pa.int32()),
                 pa.array([n for _, n in made], pa.int32())], schema.names)
    return both.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without later copies, n_lines (with a word, before) and n_removed."""
    docs = doc_columns(docs, "doc_id", "text")
    return _apply(docs, later_copies(docs, min_words)).select(
        "doc_id", "text", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs; ``n_chars``, if there, follows the
    text. A document all of whose lines are later copies goes."""
    rows = _apply(docs, later_copies(docs, min_words)).where((F.col("removed") == 0) | (F.col("removed") < F.col("lines")))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("removed") > 0, F.length("text")).otherwise(F.col("rest")["n_chars"])
        rows = rows.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return unpacked(rows, docs.columns, "doc_id", "text", "n_chars")
