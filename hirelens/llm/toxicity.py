"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbouring words and pairs with one word
between them (A-Z folded), each hashed to one of ``2**bits`` slots. FTRL-proximal keeps a
learning rate per slot and its L1 term leaves most weights exactly zero, so the model that
is broadcast is a short list of (slot, weight) whose size ``2**bits`` bounds.

The model is fitted in one task on a bounded sample of labelled rows (``max_rows``, by hash
of doc_id); every document is then scored in its own partition, whole text, without a
shuffle.

Edge cases: a null or empty text scores the bias alone; repeated rows score alike; null ids
are scored and never held out; without a labelled row every score is 0; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import Words, hash_docs, held_out, labelled_sample, map_text, mix64, packed, unpacked

MAX_ROWS = 12_000
BITS = 20
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.01
THRESHOLD = 0.3


def slots(words: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of every word, neighbouring pair and skip pair of a group of texts."""
    h, doc, shift = words.hashes, words.doc, np.uint64(64 - bits)
    yield doc, (h >> shift).astype(np.int64)
    for gap, factor in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        same = doc[gap:] == doc[:-gap]
        pair = mix64(h[:-gap][same] * np.uint64(factor) + h[gap:][same])
        yield doc[gap:][same], (pair >> shift).astype(np.int64)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int = EPOCHS,
             alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights per slot, the bias last. ``rows``: the distinct slots of each text."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    penalty_free = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        limit = np.where(at == penalty_free, 0.0, l1)
        zs = z[at]
        w = -(zs - np.sign(zs) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= limit, 0.0, w)

    for _ in range(epochs):
        for own, y in zip(rows, labels):
            at = np.append(own, penalty_free)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def features(texts: list, bits: int) -> list[bytes]:
    """The distinct slots of each text, as 32-bit numbers."""
    out = []
    for words in hash_docs(texts, punctuation=False):
        doc, slot = (np.concatenate(x) for x in zip(*slots(words, bits)))
        order = np.argsort(doc, kind="stable")
        ends = np.searchsorted(doc[order], np.arange(words.n + 1))
        out += [np.unique(slot[order[ends[i]:ends[i + 1]]]).astype(np.int32).tobytes() for i in range(words.n)]
    return out


def _fit(bits: int, options: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["key"], b["doc_id"], b["label"], b["x"])]
        if rows:
            rows.sort(key=lambda r: r[:2])  # one order, however the rows came in
            w = fit_ftrl([np.frombuffer(r[3], np.int32) for r in rows], np.array([r[2] for r in rows], float),
                         bits, **options)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"slot": at, "weight": w[at]})
    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS,
          bits: int = BITS, **options) -> tuple[np.ndarray, np.ndarray]:
    """The slots with a weight, and the weights; the bias has slot ``2**bits``."""
    # at most max_rows lists of at most 2**bits slots meet in the task
    sample = labelled_sample(docs, labels, label, max_rows, lambda texts: features(texts, bits))
    model = (sample.repartition(1).mapInPandas(_fit(bits, options), "slot long, weight double")
             .toPandas().sort_values("slot"))
    return model["slot"].to_numpy(np.int64), model["weight"].to_numpy(float)


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: Iterable[str],
               name: str = "score", bits: int = BITS) -> DataFrame:
    """The columns in ``keep`` of every row, and its score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits + 1 weights

    def run(texts: list) -> list:
        at, w = shared.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = w
        total = np.full(len(texts), dense[-1], float)
        for words in hash_docs(texts, punctuation=False):
            pairs = [np.empty(0, np.int64)]
            for doc, slot in slots(words, bits):
                hit = np.flatnonzero(dense[slot])
                pairs.append(doc[hit] << (bits + 1) | slot[hit])
            pair = np.unique(np.concatenate(pairs))  # a slot counts once a text
            total[words.first:words.first + words.n] += np.bincount(
                pair >> (bits + 1), dense[pair & ((1 << bits + 1) - 1)], words.n)
        return [1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(w) else np.zeros(len(texts))]

    return map_text(docs, keep, f"`{name}` double", run)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS,
             **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_score(docs, train(docs, labels, bits=bits, **options), ["doc_id"], bits=bits)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not call toxic, with their own columns."""
    scored = with_score(packed(docs, "text"), train(docs, labels), ["rest", "text"])
    return unpacked(scored.where(F.col("score") < threshold), docs.columns, "text")
