"""Best-fit packing by sums of squares.

A document is its token ids and one closing id 0. A document of more than ``size`` ids is cut
into pieces: the first takes what is left over, all others are full and form a sequence of
their own, so that each document leaves at most one piece to pack.

Those are dealt to blocks of bounded size by hash. In a block, longest first, each piece goes
to the gap for which the sum over all gaps of (number of open sequences with that gap)^2
becomes smallest, a new sequence being one of the choices; the pieces of sequences left open
are placed anew as long as that saves a sequence. The pieces of a block's emptiest sequences,
at most the ``FAN``-th part of a block, go on to the next round, where ``FAN`` blocks meet in
one, until one block is left: no task ever sees more than about ``BLOCK`` pieces, and what
many blocks leave open still meets.

Tokenizing uses the ranks of the same byte-level vocabulary as ``byte_bpe_50k.json`` through
``tiktoken``, about five times as fast as ``tokenizers``. The ids are those that ``tokenizers``
gives with add_special_tokens=False (tests hold them equal): an added token of the JSON that
stands in a text, such as ``<|endoftext|>``, is its one id. The regular expressions of
``tiktoken`` fail on runs of some 1,000,000 white-space characters, so a text with a run of
``2 * SPACES`` or more goes to ``tokenizers`` itself.

Edge cases: a null or empty text is the single id 0; repeated rows are packed as often as they
occur; null ids are packed; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import materialize

SIZE = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK, FAN = 16384, 16
SPACES = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64
    import json

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    beside = Path(path).with_suffix(".json")  # a vocabulary without one has no added tokens
    added = json.loads(beside.read_text("utf-8"))["added_tokens"] if beside.exists() else []
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})


def default_vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(str(Path(path).with_suffix(".json")))


def _spacious(text: str) -> bool:
    """True for every text with a run of 2 * SPACES white-space characters or more: such a run
    fills one of the slices that start at multiples of SPACES."""
    return any(text[at:at + SPACES].isspace() for at in range(0, len(text) - SPACES + 1, SPACES))


def encode(text: str, path: str) -> list[int]:
    """The ids of a text, with added tokens as ids of their own."""
    if _spacious(text):
        return _tokenizer(path).encode(text, add_special_tokens=False).ids
    return _encoder(path).encode(text, allowed_special="all")


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be short, the others are full."""
    first = (n - 1) % size + 1
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def tokenize(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, own = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(t or "", path), 0], "<u4")
                for piece, (start, n) in enumerate(cut(len(ids), size)):
                    own.append(i)
                    rows.append((piece, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            piece, start, n, crc = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item, placed in the order given.

    ``count[g]`` sequences have the gap g. Putting an item of length n into a gap g > n changes
    the sum of squares by 2 * (count[g - n] - count[g]) + 2, into g == n by 1 - 2 * count[n], and
    opening a sequence by 2 * count[size - n] + 1; ties go to the smallest gap."""
    count = np.zeros(size + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        if n == size:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        own = count[n:size]
        change = np.where(own > 0, 2 * (count[:size - n] - own) + 2, far)
        if own[0]:
            change[0] = 1 - 2 * own[0]
        best = int(change.argmin())
        gap = n + best
        if change[best] <= 2 * count[size - n] + 1:
            b = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            b, gap, made = made, size, made + 1
        bins[i], offsets[i] = b, size - gap
        if gap > n:
            count[gap - n] += 1
            open_by_gap[gap - n].append(b)
    return bins, offsets


def pack_lengths(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each of the lengths, which come longest first: one pass of
    ``sum_of_squares``, then the open sequences' pieces again while that saves a sequence."""
    bins, offsets = sum_of_squares(lengths, size)
    while len(lengths):
        open_ = np.bincount(bins, lengths) < size
        again = np.flatnonzero(open_[bins])
        new_bins, new_offsets = sum_of_squares(lengths[again], size)
        made = int(new_bins.max()) + 1 if len(again) else 0
        if made >= open_.sum():
            break
        bins = (np.cumsum(~open_) - 1)[bins]
        bins[again], offsets[again] = new_bins + (~open_).sum(), new_offsets
    return bins, offsets


def _pack_block(size: int, hand_on: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "item"], ascending=[False, True])
        lengths = items["length"].to_numpy()
        bins, offsets = pack_lengths(lengths, size)
        filled = np.bincount(bins, lengths)
        emptiest = np.argsort(filled, kind="stable")
        pieces = np.cumsum(np.bincount(bins)[emptiest])
        left = np.zeros(len(filled), bool)
        left[emptiest[(pieces <= hand_on) & (filled[emptiest] < size)]] = True
        return items.assign(bin=bins, at=offsets, left=left[bins])
    return run


def pack(items: DataFrame, size: int = SIZE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(item, sequence, at) for items (item long, length long) of at most ``size``."""
    blocks = max(1, -(-items.count() // block))
    here = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    rounds = []
    while True:
        run = _pack_block(size, block // fan if blocks > 1 else 0)
        out = materialize(here.groupBy("block").applyInPandas(
            run, "item long, length long, block long, bin long, at long, left boolean"), "pack")
        # a sequence's number: its round, its block, its number there
        number = F.lit(len(rounds) << 56) + F.col("block") * F.lit(1 << 20) + F.col("bin")
        rounds.append(out.where(~F.col("left")).select("item", number.alias("sequence"), "at"))
        if blocks == 1:
            return reduce(DataFrame.unionAll, rounds)
        blocks = -(-blocks // fan)
        here = out.where("left").select("item", "length",
                                        F.floor(F.col("block") / fan).cast("long").alias("block"))


def pack_documents(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenize(docs, size, vocabulary)
                         .withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < size).select("item", "length")
    where = pack(short, size)
    # full pieces are sequences of their own, numbered below zero
    return (pieces.join(where, "item", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("sequence", -1 - F.col("item")).alias("sequence_id"),
                    F.coalesce("at", F.lit(0)).cast("long").alias("offset")))
