"""Shared helpers of the training-data operators.

``hash_docs`` turns a batch of texts into 64-bit word hashes with whole-array operations:
the texts of a batch are laid end to end in buffers of bounded size, every byte is mapped
to a random 64-bit value and weighted by a power of an odd base, and a word's hash is the
difference of two prefix sums shifted back to position 0 (arithmetic modulo 2**64, so it
does not depend on where the word stands). Words are maximal runs of bytes other than
space and \\x09-\\x0D; a text of any length is hashed whole, in segments cut at white space.
Two different words share a hash with chance about 2**-63.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens import session
from hirelens.sources.tables import read_table

__all__ = ["WORD", "Words", "doc_columns", "hash_docs", "held_out", "labelled_sample",
           "map_text", "materialize", "mix64", "packed", "read_table", "unpacked"]

#: A word of a text, for Java, Python and DuckDB regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, 5 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATED = _SPACE.copy()  # ASCII other than letters and digits also ends a word
_PUNCTUATED[[c for c in range(128) if not chr(c).isalnum()]] = True
_BYTES[_SPACE] = 0
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of the session by bytes, unless the session has a limit of its own:
    rows hold whole documents, and a worker holds a batch several times over."""
    if spark.conf.get(BATCH[0]) == "67108864b":  # Spark's default
        spark.conf.set(*BATCH)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    bound_batches(df.sparkSession)
    return session.materialize(df, name)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, _SEGMENT + 1), _powers(_INVERSE, _SEGMENT + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_buffer(raw: bytes, lower: bool, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one buffer."""
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    edge = np.ones(n + 2, np.int8)
    edge[1:-1] = ends_word[buf]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    power, inverse = (_POW, _INV) if n <= _SEGMENT else (_powers(_BASE, n), _powers(_INVERSE, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[buf] * power[:n], out=total[1:])
    own = (total[ends] - total[starts]) * inverse[starts]
    return starts, mix64(own ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _segments(raw: bytes) -> Iterator[bytes]:
    """Pieces of about _SEGMENT bytes that end at white space (a longer word stays whole)."""
    at = 0
    while len(raw) - at > _SEGMENT:
        cut = max(raw.rfind(c, at, at + _SEGMENT) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            later = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := raw.find(c, at + 1)) > 0]
            cut = min(later, default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


class Words:
    """Word hashes of texts ``first`` .. ``first + len(bounds) - 1`` of a batch: those of the
    i-th one are ``hashes[bounds[i]:bounds[i + 1]]``; ``doc`` has the text of each word."""

    def __init__(self, first: int, bounds: np.ndarray, hashes: np.ndarray):
        self.first, self.bounds, self.hashes, self.n = first, bounds, hashes, len(bounds) - 1
        self.doc = np.repeat(np.arange(self.n), np.diff(bounds))


def hash_docs(texts: Iterable[str | None], lower: bool = True, punctuation: bool = True) -> Iterator[Words]:
    """Word hashes of a batch of texts, some hundred kB of text at a time; null is empty.
    ``lower`` folds A-Z; without ``punctuation`` ASCII punctuation ends words as well."""
    first, parts, size = 0, [], 0
    ends_word = _SPACE if punctuation else _PUNCTUATED

    def flush() -> Words:
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        starts, hashes = _hash_buffer(b"\n".join(parts), lower, ends_word)
        return Words(first, np.searchsorted(starts, offsets), hashes)

    for text in texts:
        raw = text.encode() if isinstance(text, str) else b""
        if parts and size + len(raw) > _SEGMENT - 1:
            yield flush()
            first, parts, size = first + len(parts), [], 0
        if len(raw) >= _SEGMENT:
            hashes = np.concatenate([_hash_buffer(s, lower, ends_word)[1] for s in _segments(raw)])
            yield Words(first, np.array([0, len(hashes)]), hashes)
            first += 1
        else:
            parts.append(raw)
            size += len(raw) + 1
    if parts:
        yield flush()


def held_out(doc_id: Column | str) -> Column:
    """True for the fold no label is learned from: crc32(doc_id as text) mod 4 is 2
    (a null id counts as the empty text, so it is never held out)."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % 4 == 2


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input cannot clash with ours."""
    return docs.select(*[docs[n] for n in names])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct ``rest``: columns that a caller brings
    along cannot clash with those an operator adds."""
    others = [docs[c] for c in docs.columns if c not in names]
    return docs.select((F.struct(*others) if others else F.lit(0)).alias("rest"), *[docs[n] for n in names])


def unpacked(rows: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """``columns`` again, those in ``names`` as they stand in ``rows``, the others from ``rest``."""
    return rows.select(*[F.col(c) if c in names else F.col("rest")[c].alias(c) for c in columns])


def row_keys(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with k1 and k2, 128 bits of hashes over the named columns. Joins and de-duplication
    by them need no text as a key, and null or repeated ids do not meet in one place."""
    parts = [rows[n] for n in names] + [rows[n].isNull() for n in names]
    return rows.withColumn("k1", F.xxhash64(*parts)).withColumn("k2", F.xxhash64(F.lit(1), *reversed(parts)))


def map_text(docs: DataFrame, keep: Iterable[str], new: str, function: Callable[[list], list],
             text: str = "text") -> DataFrame:
    """The columns in ``keep``, passed through as Arrow data, and those that ``function``
    makes from a batch of texts (a list of columns in the order of the DDL ``new``)."""
    bound_batches(docs.sparkSession)
    keep = list(keep)
    fields = T.StructType.fromDDL(new).fields
    schema = T.StructType([docs.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(f.dataType) for f in fields]
        names = [*keep, *(f.name for f in fields)]
        for b in batches:
            made = function(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in keep),
                 *(pa.array(x, t) for x, t in zip(made, types))], names)

    return docs.select(*[docs[c] for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
                    features: Callable[[list], list[bytes]]) -> DataFrame:
    """(doc_id, label, key, x): at most ``max_rows`` labelled documents outside the held-out
    fold, those with the smallest hash of doc_id, with what ``features`` makes of their texts.
    A document with several labels takes the largest, one with several texts the one with the
    smallest hash; null labels and null texts are left out. The sample is chosen among the
    small label rows first, and features are made where the texts lie, so no text is moved and
    what meets in one task has the size of ``max_rows`` features."""
    bound_batches(docs.sparkSession)
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .where(~held_out("doc_id"))
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
              .withColumn("key", F.xxhash64("doc_id"))
              .orderBy("key", "doc_id").limit(max_rows))
    # the sample is bounded by max_rows, and so is the broadcast
    rows = (doc_columns(docs, "doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "key", F.xxhash64("text").alias("th"), "text"))
    made = map_text(rows, ["doc_id", "label", "key", "th"], "x binary", lambda texts: [features(texts)])
    return made.groupBy("doc_id", "label", "key").agg(F.min_by("x", "th").alias("x"))
