"""Approximate nearest neighbours: an inverted multi-index.

Each vector is split into halves, and each half is quantised by its own k-means codebook
(``CENTROIDS`` entries, fitted on a bounded sample). A pair of centroids is a cell. A query
visits the cells by the sum of its halves' squared distances to the two centroids, smallest
first, with a heap over the sorted grid of pairs, until the cells seen hold enough vectors,
and always the cell that holds its own copies; those are reranked by their exact inner product. So that distance orders by inner product
for vectors of any length, a last coordinate fills every stored vector up to the
largest norm; a query has 0 there.

How many vectors are enough is measured, not guessed: ``PROBES`` query vectors are compared
with all vectors, and the smallest number that puts ``RECALL`` of their true neighbours in the
cells seen is used for all queries. Vectors without structure need a large part of the table,
clustered ones a small part.

Equal vectors are one entry that keeps its smallest ids, so a vector that fills a third of
the table is scored once, and equal queries are answered once. Cells are laid out over
shards of about ``SHARD`` entries, a larger cell over several; each query goes to the shards
that hold its cells, in blocks of ``QUERIES``, and a task multiplies one block with one shard
and returns the best ``k`` of each query.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null id, take no part; nor do vectors whose length differs from the commonest one;
repeated rows of one id count once; ties go to the smaller id; fewer than ``k`` others are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelens.llm.common import materialize

K = 20
CENTROIDS, SAMPLE, ROUNDS = 64, 20_000, 12
PROBES, RECALL = 256, 0.97
SHARD, QUERIES = 8192, 4096
_ENTRY = "vid long, ids array<long>, embedding array<float>, norm double"


def _usable(e: Column) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def entries(vectors: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): (vec_id, vid) of every usable row, and per distinct vector its vid,
    its k + 1 smallest ids, the vector and its norm."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"),
                          # -0.0 and 0.0 are one value
                          F.transform(vectors["embedding"].cast("array<float>"), lambda x: x + F.lit(0.0).cast("float"))
                          .alias("embedding")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (size["n"] if size else 0))
    rows = materialize(rows.withColumn("h1", F.xxhash64("embedding"))
                       .withColumn("h2", F.xxhash64(F.lit(1), "embedding")), "vectors")
    key = ["h1", "h2"]  # 128 bits name a vector
    salts = max(1, rows.count() // 65_536)
    ids = rows.select(*key, "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    first = F.row_number().over(W.partitionBy(*key, "salt").orderBy("vec_id"))
    ids = (ids.withColumn("r", first).where(F.col("r") <= k + 1).groupBy(*key)
           .agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")))
    one = rows.groupBy(*key).agg(F.first("embedding").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = materialize(ids.join(one, key).withColumn("vid", F.monotonically_increasing_id())
                        .withColumn("norm", norm).select(*key, "vid", "ids", "embedding", "norm"), "entries")
    rows = rows.select("vec_id", *key).distinct().join(found.select(*key, "vid"), key)
    return rows.select("vec_id", "vid"), found.drop(*key)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (at most k) by Lloyd's rounds from a seeded start."""
    c = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        total = np.add.reduceat(x[order], np.minimum(at, len(x) - 1), axis=0)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


class Index:
    """Two codebooks, the vectors per cell and the shards: of bounded size, broadcast."""

    def __init__(self, left: np.ndarray, right: np.ndarray, norm: float):
        self.left, self.right, self.norm = left, right, norm
        self.count = np.zeros(len(left) * len(right), np.int64)

    def halves(self, x: np.ndarray, norms: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The halves of vectors; ``norms`` are given for stored ones, None for queries."""
        fill = np.zeros(len(x)) if norms is None else np.sqrt(np.maximum(self.norm ** 2 - norms ** 2, 0))
        half = x.shape[1] // 2
        return x[:, :half], np.column_stack([x[:, half:], fill])

    def cells(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        a, b = self.halves(x, norms)
        return squared(a, self.left).argmin(1) * len(self.right) + squared(b, self.right).argmin(1)

    def lay_out(self, shard: int) -> None:
        """Cells, in order, fill shards; a cell above the size has shards of its own."""
        self.parts = np.maximum(1, -(-self.count // shard))
        alone = self.parts > 1
        small = np.cumsum(np.where(alone, 0, self.count)) // shard
        self.shard = np.where(alone, 0, small)
        n = int(small[-1]) + 1 if len(small) else 1
        self.shard[alone] = n + np.concatenate([[0], np.cumsum(self.parts[alone])])[:-1]

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """The cells that hold vectors, nearest pair of centroids first: a heap holds the frontier
        of the grid of pairs, each half sorted by its own distance."""
        a, b = self.halves(query[None], None)
        d1, d2 = squared(a, self.left)[0], squared(b, self.right)[0]
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        d1, d2 = d1[o1].tolist(), d2[o2].tolist()
        cell = (o1[:, None] * len(self.right) + o2[None, :]).tolist()
        heap = [(d1[0] + d2[0], 0, 0)]
        count = self.count
        while heap:
            _, i, j = heapq.heappop(heap)
            if count[cell[i][j]]:
                yield cell[i][j]
            if j + 1 < len(d2):  # to the right always, down from the first column only
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(d1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))

    def visit(self, query: np.ndarray, enough: int) -> list[int]:
        """Cells to look at: the nearest ones that hold ``enough`` vectors together."""
        out, seen = [], 0
        for c in self.walk(query):
            if seen >= enough:
                break
            out.append(c)
            seen += int(self.count[c])
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def build(found: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[Index | None, DataFrame]:
    """The index and (vid, ids, embedding, norm, cell) of every entry."""
    top = found.agg(F.max("norm")).first()[0]
    if top is None:
        return None, found.withColumn("cell", F.lit(0))
    some = found.orderBy(F.xxhash64("vid"), "vid").limit(sample).select("embedding", "norm").toPandas()
    x = _matrix(some["embedding"])
    index = Index(np.empty((0, 0)), np.empty((0, 0)), float(top))
    a, b = index.halves(x, some["norm"].to_numpy(float))
    index = Index(k_means(a, centroids), k_means(b, centroids), float(top))
    shared = found.sparkSession.sparkContext.broadcast(index)  # 2 * centroids vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(cell=shared.value.cells(_matrix(p["embedding"]), p["norm"].to_numpy(float)))
    placed = materialize(found.mapInPandas(assign, f"{_ENTRY}, cell long"), "cells")
    for r in placed.groupBy("cell").count().collect():  # at most centroids**2 rows
        index.count[r["cell"]] = r["count"]
    return index, placed


def _best(q: np.ndarray, x: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[np.ndarray]:
    """Per query the columns of its k largest inner products."""
    s = q @ x.T
    if allowed is not None:
        s = np.where(allowed, s, -np.inf)
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    for i in range(len(q)):
        yield top[i][s[i, top[i]] > -np.inf]


def measure(index: Index, placed: DataFrame, queries: DataFrame, k: int, probes: int, recall: float) -> int:
    """The smallest number of vectors to look at that finds ``recall`` of the true neighbours
    of at most ``probes`` query vectors, which are compared with every vector."""
    some = queries.orderBy(F.xxhash64("vid"), "vid").limit(probes).select("vid", "embedding").toPandas()
    if some.empty:
        return 0
    q, own = _matrix(some["embedding"]), some["vid"].to_numpy()
    shared = placed.sparkSession.sparkContext.broadcast(q)

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x, vid, cell = _matrix(p["embedding"]), p["vid"].to_numpy(), p["cell"].to_numpy()
            for i, at in enumerate(_best(shared.value, x, None, k + 1)):
                yield pd.DataFrame({"q": i, "vid": vid[at], "cell": cell[at], "score": x[at] @ shared.value[i]})

    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vid"))
    true = (placed.select("vid", "embedding", "cell").mapInPandas(top, "q int, vid long, cell long, score double")
            .withColumn("r", rank).where(F.col("r") <= k + 1).collect())  # probes * (k + 1) rows
    need = {}
    for i in range(len(q)):
        seen, need[i] = 0, {}
        for c in index.walk(q[i]):
            seen += int(index.count[c])
            need[i][c] = seen
    depth = np.sort([need[r["q"]][r["cell"]] for r in true if r["vid"] != own[r["q"]]])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) if len(depth) else 0


def search(vectors: DataFrame, is_query: Column | str, k: int = K, centroids: int = CENTROIDS,
           recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query; ``is_query``
    is a condition on vec_id."""
    rows, found = entries(vectors, k)
    asked = materialize(rows.where(is_query), "asked")
    index, placed = build(found, centroids)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    queries = placed.join(asked.select("vid").distinct(), "vid", "left_semi").select("vid", "embedding", "cell")
    # k + 1, as a query's own vector stands first among its neighbours
    enough = measure(index, placed, queries, k, probes, recall)
    index.lay_out(SHARD)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    n_blocks = max(1, -(-queries.count() // QUERIES))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for p in batches:
            for vid, e, home in zip(p["vid"], p["embedding"], p["cell"]):
                cells = ix.visit(np.array(e, float), enough)
                cells = np.array(cells if home in cells else [*cells, home], np.int64)
                many = ix.parts[cells]
                shards = np.repeat(ix.shard[cells], many) + np.concatenate([np.arange(m) for m in many])
                order = np.argsort(shards, kind="stable")
                cut = np.flatnonzero(np.diff(shards[order])) + 1
                own = np.split(np.repeat(cells, many)[order], cut)
                yield pd.DataFrame({"vid": vid, "embedding": [e] * len(own), "shard": np.unique(shards),
                                    "block": vid % n_blocks, "cells": own})

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for p in batches:
            cell = p["cell"].to_numpy()
            yield p.assign(shard=ix.shard[cell] + p["vid"].to_numpy() % ix.parts[cell])

    def score(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p = p.sort_values("cell")
            x, cell = _matrix(p["embedding"]), p["cell"].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at:at + 256]
                own = _matrix(part["embedding"])
                allowed = np.array([np.isin(cell, c) for c in part["cells"]])
                for i, top in enumerate(_best(own, x, allowed, k + 1)):
                    # the same sum for every pair, wherever it is computed
                    s = (x[top] * own[i]).sum(1)
                    near = sorted((-v, vec) for v, ids in zip(s.tolist(), p["ids"].iloc[top]) for vec in ids.tolist())
                    near = near[:k + 1]
                    out.append((part["vid"].iat[i], [-v for v, _ in near], [vec for _, vec in near]))
        return pd.DataFrame(out, columns=["vid", "scores", "ids"])

    routed = materialize(queries.mapInPandas(
        route, "vid long, embedding array<float>, shard long, block long, cells array<long>"), "routed")
    stored = (placed.mapInPandas(store, f"{_ENTRY}, cell long, shard long")
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
              .select("shard", "block", "cell", "ids", "embedding"))
    best = (routed.groupBy("shard", "block").cogroup(stored.groupBy("shard", "block"))
            .applyInPandas(score, "vid long, scores array<double>, ids array<long>"))
    pair = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x.scores).alias("far"), x.ids.alias("vec_id")))
    # at most k + 1 per shard that the query visits
    merged = best.select("vid", F.explode(pair).alias("x")).select("vid", "x.far", "x.vec_id")
    rank = F.row_number().over(W.partitionBy("vid").orderBy("far", "vec_id"))
    merged = materialize(merged.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("vid").agg(
        F.sort_array(F.collect_list(F.struct("far", "vec_id"))).alias("near")), "near")
    others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("vec_id")), 1, k)
    return (asked.join(merged, "vid").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.far")).alias("score")))
