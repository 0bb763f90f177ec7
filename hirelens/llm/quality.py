"""Quality: nearest-neighbour voting over latent-semantic vectors.

The terms of a text are its byte trigrams (hashed to ``DIM`` slots) and one structural
term: words equal to the word before. A text is the vector of square-rooted term shares,
trigrams weighted by inverse document frequency over all documents. A truncated SVD of the
labelled vectors gives the latent axes. The labelled latent vectors, at most ``max_rows``
of ``RANK`` numbers, are broadcast; each partition multiplies blocks of its documents with
all of them (exact cosines) and the ``K`` nearest vote with their cosine as weight.

Edge cases: a null or empty text has no direction, its score is the share of label 1 among
the labelled rows, and so is that of a text without a positive cosine; repeated rows score
alike; null ids are scored and never held out; without a labelled row every score is 0.5;
other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import doc_columns, hash_docs, held_out, labelled_sample, map_text

MAX_ROWS = 6_000
DIM, RANK, K = 4096, 64, 15
THRESHOLD = 0.7
_SLICE, _BLOCK = 1 << 20, 256


def term_counts(text: str | None, dim: int = DIM) -> np.ndarray:
    """Counts of the hashed byte trigrams of one text, read in slices of bounded size."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(dim, np.int64)
    shift = np.uint32(33 - dim.bit_length())
    for at in range(0, max(len(raw) - 2, 0), _SLICE):
        b = raw[at:at + _SLICE + 2].astype(np.uint32)
        slot = b[:-2] * np.uint32(0x2C1B3C6D) + b[1:-1] * np.uint32(0x297A2D39) + b[2:] * np.uint32(0x9E3779B1)
        out += np.bincount(slot >> shift, minlength=dim)
    return out


def repeated_share(texts: list) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    out = np.zeros(len(texts))
    for w in hash_docs(texts, lower=False):
        again = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
        out[w.first:w.first + w.n] = (np.bincount(w.doc[1:][again], minlength=w.n)
                                      / np.maximum(np.diff(w.bounds), 1))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def term_vectors(texts: list, idf: np.ndarray) -> np.ndarray:
    """Unit term vectors; a text without terms is all zero."""
    out = np.zeros((len(texts), len(idf) + 1), np.float32)
    for i, t in enumerate(texts):
        c = term_counts(t, len(idf))
        out[i, :-1] = np.sqrt(c / max(c.sum(), 1)) * idf
    out[:, -1] = np.sqrt(repeated_share(texts))
    return _unit(out)


def fit_axes(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Latent axes (terms x rank): randomised subspace iteration, then a small SVD."""
    start = np.random.default_rng(7).standard_normal((x.shape[0], rank + 16)).astype(np.float32)
    q = x.T @ start
    for _ in range(rounds):
        q, _r = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))
    _u, _s, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt[:rank].T).astype(np.float32))


def term_idf(docs: DataFrame, dim: int = DIM) -> np.ndarray:
    """Inverse document frequency of each slot over all documents: every partition sends one
    count per slot, so at most ``dim`` rows reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(dim + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                seen[:-1] += term_counts(t, dim) > 0
            n += len(b)
        seen[-1] = n
        yield pd.DataFrame({"slot": np.arange(dim + 1), "n": seen})

    found = (doc_columns(docs, "text").mapInPandas(count, "slot int, n long")
             .groupBy("slot").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(dim + 1)
    df[found["slot"].to_numpy(int)] = found["n"]
    return np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
          rank: int = RANK, dim: int = DIM) -> dict | None:
    """idf, axes, labelled latent vectors and their labels; None without a labelled row.
    Fitted in one task on at most ``max_rows`` labelled documents."""
    idf = term_idf(docs, dim)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["key"], b["doc_id"], b["label"], b["x"])]
        if rows:
            rows.sort(key=lambda r: r[:2])  # one order, however the rows came in
            x = np.empty((len(rows), dim + 1), np.float32)
            for i, r in enumerate(rows):
                x[i] = np.frombuffer(r[3], np.float32)
            axes = fit_axes(x, rank)
            out = io.BytesIO()
            np.savez(out, axes=axes, near=_unit(x @ axes), label=np.array([r[2] for r in rows], np.float32))
            yield pd.DataFrame({"model": [out.getvalue()]})

    def features(texts: list) -> list[bytes]:
        return [v.tobytes() for at in range(0, len(texts), _BLOCK) for v in term_vectors(texts[at:at + _BLOCK], idf)]

    # at most max_rows vectors of dim + 1 numbers meet in the task
    sample = labelled_sample(docs, labels, label, max_rows, features)
    rows = sample.repartition(1).mapInPandas(fit, "model binary").collect()
    return None if not rows else {"idf": idf, **np.load(io.BytesIO(bytes(rows[0]["model"])))}


def vote(texts: list, model: dict, k: int = K) -> np.ndarray:
    """Score of each text: the labels of its k nearest labelled vectors, weighted by cosine."""
    near, label = model["near"], model["label"]
    k, prior = min(k, len(label)), float(label.mean())
    out = np.full(len(texts), prior)
    for at in range(0, len(texts), _BLOCK):
        x = _unit(term_vectors(texts[at:at + _BLOCK], model["idf"]) @ model["axes"])
        cosine = x @ near.T
        top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(float)
        total = weight.sum(1)
        found = total > 1e-9
        out[at:at + _BLOCK][found] = np.clip((weight * label[top]).sum(1)[found] / total[found], 0, 1)
    return out


def with_score(docs: DataFrame, model: dict | None, keep: Iterable[str], name: str = "score",
               k: int = K) -> DataFrame:
    """The columns in ``keep`` of every row, and its score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_rows, rank and dim
    return map_text(docs, keep, f"`{name}` double",
                    lambda texts: [np.full(len(texts), 0.5) if shared.value is None
                                   else vote(texts, shared.value, k)])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_score(docs, train(docs, labels, **options), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
