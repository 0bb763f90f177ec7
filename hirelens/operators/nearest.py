"""V3: exact top-k vector matches with pruning.

Postings are laid out in blocks: each belongs to the nearest of at most ``PIVOTS`` directions
(k-means over a bounded sample; any choice gives the same result), and the postings of a
direction are cut into shells by their angle to it, at most a block's rows each. A hot direction
is many shells. For a resume at angle a from a block's direction, no posting of a shell from lo
to hi can be nearer than the angle max(0, a - hi, lo - a): the triangle inequality on the sphere
gives an upper bound of the score.

Each resume visits blocks in the order of that bound, twice as many in every round, and stops
when its k-th best score is above the bound of all blocks left. A resume travels only to the
blocks it visits, and a block only to the groups of at most ``RESUME_BLOCK`` resumes that visit
it; nothing is copied to all of the other side. What leaves a task are at most k rows per resume
and visited block, and of those only the ones that reach the resume's k-th score so far. Rounding can't lose a posting: bounds are widened by ``SLACK``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.operators.ordering import position_within, top_k_within
from hirelens.session import materialize

RESUME_BLOCK = 1024      # resumes that meet a block in one task
POSTING_BLOCK = 1024     # postings of a block, unless that makes more than MAX_BLOCKS
MAX_BLOCKS = 1 << 18     # entries of the block directory that every task gets: 10 MB
PIVOTS = 256             # directions
SAMPLE = 4096            # postings they are found on
FIRST_VISITS = 16        # blocks a resume visits in the first round
SLACK = 1e-6             # added to every bound
UNIT_TOLERANCE = 1e-6    # a stored float vector this close to length 1 is a unit vector


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows that have it already (to single precision) and zero
    rows stay as they are."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    keep = (n == 0.0) | (np.abs(n - 1.0) <= UNIT_TOLERANCE)
    return m / np.where(keep, 1.0, n)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return unit(np.stack(vectors.to_numpy()).astype(np.float64))


def directions(vectors: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Unit directions by k-means on the sphere; beginning with every (len / n)-th vector."""
    made = vectors[np.linspace(0, len(vectors) - 1, n).astype(int)]
    for _ in range(rounds):
        near = (vectors @ made.T).argmax(axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        made = np.where(size > 0, sums / np.where(size > 0, size, 1), made)
    return made


@dataclass
class Directory:
    """What a task needs to choose blocks: the directions, and per block its direction, the
    angles it spans and its smallest posting id."""
    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first_id: np.ndarray

    def gaps(self, resumes: np.ndarray) -> np.ndarray:
        """The least angle between each resume and any posting of each block."""
        if not len(self.block):
            return np.zeros((len(resumes), 0))
        angle = np.arccos(np.clip(resumes @ self.pivots.T, -1.0, 1.0))[:, self.pivot]
        return np.maximum(0.0, np.maximum(angle - self.high, self.low - angle))

    def choose(self, gap: np.ndarray, done: int, kth: float, kth_id: int, most: int) -> tuple[np.ndarray, int]:
        """The next blocks of one resume and how many are behind it then. ``kth`` is the k-th
        score so far, -1 before there are k. Blocks farther than a right angle hold scores of 0
        only, which count by posting id."""
        bound = np.where(gap > np.pi / 2 + SLACK, 0.0, np.minimum(1.0, np.cos(gap) + SLACK))
        order = np.lexsort((self.first_id, -bound))[done:]
        b = bound[order]
        open_ = np.where(b > 0, b >= kth, (kth < 0) | ((kth == 0) & (self.first_id[order] < kth_id)))
        at = np.flatnonzero(open_)[:most]
        return self.block[order[at]], done + (int(at[-1]) + 1 if len(at) else 0)


def lay_out(postings: DataFrame, block_rows: int = POSTING_BLOCK) -> tuple[DataFrame, Directory]:
    """(block, posting_id, vec) of all postings, written once in block order, and the directory."""
    n = postings.count()
    rows = max(block_rows, -(-n // MAX_BLOCKS))
    sample = postings.orderBy(F.xxhash64("posting_id"), "posting_id").limit(SAMPLE).select("vec").toPandas()["vec"]
    vectors = _matrix(sample) if len(sample) else np.zeros((0, 1))
    pivots = directions(vectors, min(PIVOTS, len(vectors), max(1, n // rows))) if len(vectors) else vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = _matrix(b["vec"]) @ pivots.T
            best = near.argmax(axis=1)
            yield b.assign(pivot=best, angle=np.arccos(np.clip(near[np.arange(len(b)), best], -1.0, 1.0)))

    schema = f"posting_id long, vec {postings.schema['vec'].dataType.simpleString()}, pivot int, angle double"
    order = [F.col("angle").asc(), F.col("posting_id").asc()]
    placed = position_within(postings.mapInPandas(assign, schema), ["pivot"], order)
    shell = F.floor((F.col("pos") - 1) / rows).cast("long")
    blocks = materialize(placed.select((F.col("pivot").cast("long") * (1 << 40) + shell).alias("block"),
                                       "pivot", "angle", "posting_id", "vec"), "posting-blocks")
    found = (blocks.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("angle").alias("low"),
                                         F.max("angle").alias("high"), F.min("posting_id").alias("first_id"))
             .orderBy("block").toPandas())      # at most MAX_BLOCKS + PIVOTS rows
    return blocks.select("block", "posting_id", "vec"), Directory(
        pivots, *(found[c].to_numpy() for c in ("block", "pivot", "low", "high", "first_id")))


def _router(directory: Directory, most: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 22) // max(1, len(directory.block)))   # rows whose gaps fit in 32 MB
        for b in batches:
            chosen, done = [], []
            for at in range(0, len(b), step):
                part = b.iloc[at:at + step]
                for gap, d, s, i in zip(directory.gaps(_matrix(part["vec"])), part["done"], part["kth"], part["kth_id"]):
                    blocks, behind = directory.choose(gap, int(d), float(s), int(i), most)
                    chosen.append(blocks)
                    done.append(behind)
            yield pd.DataFrame({"resume_id": b["resume_id"], "vec": b["vec"], "kth": b["kth"], "done": done,
                                "blocks": chosen})
    return run


def _scorer(k: int) -> Callable:
    def run(res: pd.DataFrame, post: pd.DataFrame) -> pd.DataFrame:
        if res.empty or post.empty:
            return pd.DataFrame({"resume_id": [], "posting_id": [], "score": []}).astype(
                {"resume_id": "int64", "posting_id": "int64", "score": "float64"})
        post = post.sort_values("posting_id")
        ids = post["posting_id"].to_numpy(np.int64)
        score = np.clip(_matrix(res["vec"]) @ _matrix(post["vec"]).T, 0.0, 1.0)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]     # ties by posting id
        top = np.take_along_axis(score, best, axis=1)
        row, col = np.nonzero(top >= res["kth"].to_numpy(float)[:, None])   # others can't be among the k
        return pd.DataFrame({"resume_id": res["resume_id"].to_numpy(np.int64)[row],
                             "posting_id": ids[best[row, col]], "score": top[row, col]})
    return run


def _visit(routed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(resume_id, posting_id, score): the k best of every visited block."""
    visits = routed.select("resume_id", "vec", "kth", F.explode("blocks").alias("block"))
    # one row per visited block, at most MAX_BLOCKS + PIVOTS
    groups = F.broadcast(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / RESUME_BLOCK).alias("groups")))
    res = (visits.join(groups, "block")
           .withColumn("part", F.pmod(F.xxhash64("resume_id"), F.col("groups"))).drop("groups"))
    post = (blocks.join(groups, "block")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups"))
    return (res.groupBy("block", "part").cogroup(post.groupBy("block", "part"))
            .applyInPandas(_scorer(k), "resume_id long, posting_id long, score double"))


def top_k(resumes: DataFrame, postings: DataFrame, k: int, block_rows: int = POSTING_BLOCK,
          first_visits: int = FIRST_VISITS, visited: list[int] | None = None) -> DataFrame:
    """resume_id, posting_id, score, rank of the k postings with the highest cosine, clamped to
    [0, 1], ties by posting id. Inputs: (resume_id, vec) and (posting_id, vec) with unique ids;
    rows without a vector take no part. ``visited`` collects the visits of each round."""
    resumes = resumes.where("vec is not null")
    blocks, directory = lay_out(postings.where("vec is not null"), block_rows)
    vec = resumes.schema["vec"].dataType.simpleString()
    order = [F.col("score").desc(), F.col("posting_id").asc()]
    state = resumes.select("resume_id", "vec", F.lit(0).alias("done"), F.lit(-1.0).alias("kth"),
                           F.lit(0).cast("long").alias("kth_id"))
    best, most = None, first_visits
    while True:
        routed = materialize(state.mapInPandas(
            _router(directory, most), f"resume_id long, vec {vec}, kth double, done int, blocks array<long>")
            .where(F.size("blocks") > 0), "routed")
        n = routed.agg(F.sum(F.size("blocks"))).first()[0]
        if n is None:
            break
        if visited is not None:
            visited.append(n)
        found = _visit(routed, blocks, k)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = materialize(top_k_within(found, ["resume_id"], order, k, name="rank", salt_col="posting_id"), "best")
        if most >= len(directory.block):
            break
        last = best.where(F.col("rank") == k).select("resume_id", F.col("score").alias("kth"), F.col("posting_id").alias("kth_id"))
        state = routed.drop("blocks", "kth").join(last, "resume_id", "left").select(
            "resume_id", "vec", "done", F.coalesce("kth", F.lit(-1.0)).alias("kth"), F.coalesce("kth_id", F.lit(0)).alias("kth_id"))
        most *= 2
    if best is None:
        best = resumes.sparkSession.createDataFrame([], "resume_id long, posting_id long, score double, rank int")
    return best.select("resume_id", "posting_id", "score", F.col("rank").cast("int").alias("rank"))
