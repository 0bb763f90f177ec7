"""Running folds and list ranking over shuffles: no task ever holds a whole list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import materialize

BLOCK = 4096          # rows whose fold is made in one window
SINGLE = 1 << 15      # arcs of a list that one task ranks


def running(df: DataFrame, keys: list[str], at: str, values: list[str], fold: Callable[[str], Column],
            block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``values`` replaced by its fold over the rows of the same ``keys``
    (not null) up to this one in the order of ``at``, which counts 0, 1, ... or 1, 2, ...
    without gaps. ``fold`` is an associative aggregate. Rows are folded in windows of ``block``,
    and what comes before a window is the running fold of the windows' totals, found by the same
    function: a key with very many rows is spread over as many windows. ``df`` is read twice."""
    others = [c for c in df.columns if c not in values]
    cut = df.withColumn("_block", F.floor(F.col(at) / block).cast("long"))
    here = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.select(*others, "_block", *[fold(v).over(here).alias(v) for v in values])
    totals = materialize(cut.groupBy(*keys, "_block").agg(*[fold(v).alias(v) for v in values])
                         .withColumnRenamed("_block", "_at"), "totals")
    if totals.where("_at > 0").isEmpty():
        return inner.drop("_block")
    before = running(totals, keys, "_at", values, fold, block).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_at") + 1).alias("_next"),
        *[F.col(v).alias(f"_b_{v}") for v in values])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_block") == F.col("_next")]
    # one fold of two values, those of the windows before and this one's
    both = inner.join(before, on, "left")
    return both.select(*others, *[_pair(fold, f"_b_{v}", v).alias(v) for v in values])


def _pair(fold: Callable[[str], Column], a: str, b: str) -> Column:
    if fold is F.sum:
        return F.coalesce(F.col(a), F.lit(0)) + F.col(b)
    if fold is F.bit_xor:
        return F.coalesce(F.col(a), F.lit(0)).bitwiseXOR(F.col(b))
    raise ValueError("folds are sum and bit_xor")


def _rank_single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks of a short list by pointer jumping over arrays."""
    parts = list(batches)
    if not parts:
        return
    arcs = pd.concat(parts)
    ids = arcs["id"].to_numpy(np.int64)
    order = np.argsort(ids)
    to = arcs["next"].to_numpy(np.int64)
    n, last = len(ids), to == -1
    nxt = np.append(np.where(last, n, order[np.searchsorted(ids[order], to) % n]), n)
    rank = np.append(arcs["steps"].to_numpy(np.int64), 0)
    while (nxt != n).any():
        rank, nxt = rank + rank[nxt], nxt[nxt]
    yield pd.DataFrame({"id": ids, "rank": rank[:n]})


def list_rank(arcs: DataFrame, single: int = SINGLE) -> DataFrame:
    """(id, rank): the number of steps from each element of a linked list to its end, for arcs
    (id long, next long, null at the end).

    The list is contracted: each element tosses a coin, a hash of its id and the round, and one
    with tails whose predecessor has heads leaves; the predecessor takes over its steps. That
    is a join on unique keys, takes about a quarter of the elements, and so all rounds together
    move four times the list. Once at most ``single`` elements are left, one task ranks them;
    then the elements that left come back, round by round, each behind the one it pointed to."""
    now = materialize(arcs.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")), "list")
    left = []
    while now.count() > single:
        tails = F.xxhash64("id", F.lit(len(left))).bitwiseAND(F.lit(1)) == 1
        heads = now.where(~tails)
        gone = now.where(tails).select(F.col("id").alias("o"), F.col("next").alias("o_next"), F.col("steps").alias("o_steps"))
        met = F.col("id").isNotNull() & F.col("o").isNotNull()
        out = materialize(heads.join(gone, F.col("next") == F.col("o"), "full_outer").select(
            F.coalesce("id", "o").alias("id"),
            F.when(F.col("o").isNull(), F.col("next")).otherwise(F.col("o_next")).alias("next"),
            (F.coalesce("steps", F.lit(0)) + F.coalesce("o_steps", F.lit(0))).alias("steps"),
            F.when(met, F.struct("o", "o_next", "o_steps")).alias("gone")), "contracted")
        left.append(out.where("gone is not null").select("gone.*"))
        now = out.select("id", "next", "steps")
    ranks = materialize(now.withColumn("next", F.coalesce("next", F.lit(-1))).repartition(1).mapInPandas(_rank_single, "id long, rank long"), "ranks")
    for gone in reversed(left):
        behind = ranks.select(F.col("id").alias("o_next"), "rank")
        back = gone.join(behind, "o_next", "left").select(
            F.col("o").alias("id"), (F.col("o_steps") + F.coalesce("rank", F.lit(0))).alias("rank"))
        ranks = materialize(ranks.unionByName(back), "ranks")
    return ranks
