"""V1: text vectors by a model of the caller's, S7: written with the corpus.

``encode`` takes a function that loads the model; each Python worker calls it once, however many
tasks and batches it works on, and the model then gets lists of texts that are close in length, so that a model which
pads a batch to its longest text does little work for nothing. Texts stay where they are: the
vectors come back as one more column of the same rows, so a vector can't be put with another
posting. Vectors are scaled to length 1 (a zero vector stays zero).

``LetterModel`` is a stand-in without weights, for tests and jobs that have no model at hand.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import text_window

BATCH = 128              # texts the model gets at a time
BATCH_CHARS = 1 << 20    # and characters, unless one text alone has more


class Model(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """A row of numbers for every text."""


def in_batches(texts: list[str], size: int, chars: int) -> Iterator[np.ndarray]:
    """Places of the texts, shortest first, in batches of at most ``size`` texts and
    ``chars`` characters (a longer text is a batch of its own)."""
    order = np.argsort([len(t) for t in texts], kind="stable")
    at = 0
    while at < len(order):
        longest, end = 0, at
        while end < len(order) and end - at < size:
            longest = len(texts[order[end]])
            if end > at and longest * (end - at + 1) > chars:
                break
            end += 1
        yield order[at:end]
        at = end


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> Model:
    return pickle.loads(packed)()


def encode(df: DataFrame, text_col: str, load: Callable[[], Model], vector_col: str = "vector",
           window: int | None = None, size: int = BATCH, chars: int = BATCH_CHARS) -> DataFrame:
    """``df`` with ``vector_col`` (array<float>), the unit vector of each text; a null text is
    empty. ``window`` cuts texts to that many characters for a model with an input limit (F3)."""
    packed = cloudpickle.dumps(load)

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(packed)
        for texts in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            out: list = [None] * len(texts)
            for places in in_batches(texts, size, chars):
                made = unit_rows(np.asarray(model.encode([texts[i] for i in places]), np.float64)).astype(np.float32)
                for i, v in zip(places, made):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.col(text_col) if window is None else text_window(F.col(text_col), window)
    return df.withColumn(vector_col, F.pandas_udf(vectors, "array<float>")(text))


class LetterModel:
    """26 numbers: how often each letter from a to z stands in a text, capitals too."""

    def encode(self, texts: list[str]) -> np.ndarray:
        rows = [np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[:256] for t in texts]
        m = np.stack(rows)
        return m[:, 97:123] + m[:, 65:91]
