"""Token counts without token ids.

Byte-pair merges never cross a pre-token, so a text has as many tokens as its pre-tokens have
together. Each distinct pre-token of the corpus is encoded once, whatever the number of places
it stands in (``piece_counts``); a document's count is the sum over its pre-tokens of their
frequency there times the pieces of one (``token_counts``). No text is ever encoded as a whole
and no ids leave the encoder.

The join of the two sides is split by frequency. The commonest pre-tokens, at most ``HEAD`` of
``HEAD_BYTES`` bytes together, are a broadcast table, and a document's sum over them is made
where the text is read; a histogram over logarithms of the frequency gives the line, so no
order of all pre-tokens is needed. What is rarer leaves as rows (document, pre-token, frequency)
and meets its count in a shuffle join, where no key is hot: a pre-token beyond the line stands
in few documents. Both bounds hold at every size, nothing is dropped.

Pre-tokens are those of the library itself: strings of added tokens are split off first, then
the pattern of the vocabulary is matched. The pattern runs in the ``re`` module over
ASCII slices and in ``regex`` over others, whose Unicode tables are newer than the library's; a
slice with a character that the two class
differently (each character is tried once per worker) is split by the library. Long texts are
read in slices, cut where a white space follows a printable ASCII character, which is always a
boundary of pre-tokens.

Edge cases: a null or empty text has no bytes and no tokens; repeated rows and rows without an
id are counted each; a very long word is one pre-token; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import bound_batches, materialize

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
HEAD = 1 << 17            # broadcast pre-tokens at most,
HEAD_BYTES = 8 << 20      # and bytes of their strings at most
SLICE = 1 << 20           # characters of a text that are split at a time
FLUSH = 1 << 17           # distinct pre-tokens a task counts before it hands them on
STEPS = 8                 # frequency classes to a power of two
#: The vocabulary's pattern over ASCII, where ``re`` can match it, twice as fast.
ASCII_PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                 r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def default_vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(VOCABULARY))


class Splitter:
    """The pre-tokens of texts under a byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind = made["pre_tokenizer"] or {}
        if made["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.ascii = re.compile(ASCII_PATTERN)
        added = sorted((a["content"] for a in made["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.cut = regex.compile(r"(?<=[!-~])[ \n]")
        self.odd: dict[str, bool] = {}

    def by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def is_odd(self, char: str) -> bool:
        """True if library and pattern class the character differently. The probe has it after
        a letter, between digits and signs and after a space, which tells the classes apart."""
        if char not in self.odd:
            probe = f"a{char}1{char}! {char}\t"
            self.odd[char] = self.by_library(probe) != self.pattern.findall(probe)
        return self.odd[char]

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            m = self.cut.search(text, at + SLICE)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a slice at a time; an added token is one of its own."""
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield [part]
                continue
            for s in self.slices(part):
                if s.isascii():
                    yield self.ascii.findall(s)
                elif not any(map(self.is_odd, set(s))):
                    yield self.pattern.findall(s)
                else:
                    yield self.by_library(s)

    def frequencies(self, text: str) -> Counter:
        counts: Counter = Counter()
        for some in self.pieces(text):
            counts.update(some)
        return counts


@lru_cache(maxsize=2)
def _splitter(path: str) -> Splitter:
    return Splitter(path)


def piece_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(piece, n, tokens): every distinct pre-token of the corpus, the number of its places and
    the number of tokens the library makes of it."""
    path = vocabulary or default_vocabulary()
    bound_batches(docs.sparkSession)

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = _splitter(path), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for some in split.pieces(t or ""):
                    counts.update(some)
                if len(counts) > FLUSH:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _splitter(path).tokenizer
        for b in batches:
            made = tokenizer.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in made], pa.int64())],
                ["piece", "n", "tokens"])

    distinct = (docs.select(docs["text"]).mapInArrow(count, "piece string, n long")
                .groupBy("piece").agg(F.sum("n").alias("n")))
    return distinct.mapInArrow(encode, "piece string, n long, tokens long")


def _classed(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("class", F.floor(F.log2("n") * STEPS).cast("int"))


def head_line(pieces: DataFrame, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> int:
    """The lowest frequency class from which on the pre-tokens, and their bytes, are within
    the bounds. The histogram has at most 64 * STEPS rows."""
    classes = (_classed(pieces).groupBy("class")
               .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("piece")).alias("bytes")).collect())
    line, rows, size = 64 * STEPS, 0, 0
    for c in sorted(classes, reverse=True):
        rows, size = rows + c["rows"], size + c["bytes"]
        if rows > most or size > most_bytes:
            break
        line = c["class"]
    return line


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None,
                 most: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    pieces = materialize(piece_counts(docs, path), "pieces")
    line = head_line(pieces, most)
    head = (_classed(pieces).where(F.col("class") >= line)
            .select("piece", "tokens").toPandas())  # within HEAD rows and HEAD_BYTES bytes
    known = spark.sparkContext.broadcast(dict(zip(head["piece"], head["tokens"].astype(int))))
    rare = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, tokens = _splitter(path), known.value
        for b in batches:
            size, common, rest = [], [], []
            for t in b.column(1).to_pylist():
                counts, total, others = split.frequencies(t or ""), 0, []
                for piece, n in counts.items():
                    if piece in tokens:
                        total += n * tokens[piece]
                    else:
                        others.append({"piece": piece, "n": n})
                size.append(len((t or "").encode()))
                common.append(total)
                rest.append(others)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(common, pa.int64()), pa.array(rest, rare)],
                ["doc_id", "n_bytes", "common", "rest"])

    made = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(
        run, "doc_id long, n_bytes long, common long, rest array<struct<piece: string, n: long>>")
    # written once, so that a row keeps its number
    rows = materialize(made.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    tail = rows.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.n")
    seldom = _classed(pieces).where(F.col("class") < line).select("piece", "tokens")
    sums = (tail.join(seldom, "piece").groupBy("row")
            .agg(F.sum(F.col("n") * F.col("tokens")).alias("seldom")))
    total = F.col("common") + F.coalesce("seldom", F.lit(0))
    return (rows.drop("rest").join(sums, "row", "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
