"""V3: the pruned search equals a full comparison and leaves blocks out."""

import numpy as np
import pytest

from hirelens.operators import nearest


def rows(m, first=0):
    return [(first + i, [float(x) for x in v]) for i, v in enumerate(m)]


def frame(spark, data, name):
    return spark.createDataFrame(data, f"{name} long, vec array<float>")


def full(res, post, k):
    out = {}
    for r, v in res:
        sc = []
        for p, w in post:
            a, b = np.float32(v).astype(float), np.float32(w).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            sc.append((-min(1.0, max(0.0, float(a @ b) / n if n else 0.0)), p))
        out[r] = [(p, round(-s, 5)) for s, p in sorted((round(s, 9), p) for s, p in sc)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.resume_id, r["rank"])):
        out.setdefault(r.resume_id, []).append((r.posting_id, round(r.score, 5)))
    return out


def clustered(rng, n, dim=16, groups=12, spread=0.05):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clustered", "shapeless", "one hot group"])
def test_equals_full_comparison(spark, kind):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(700, 16)) if kind == "shapeless" else clustered(rng, 700, groups=1 if kind == "one hot group" else 12)
    res, post = rows(m[:100]), rows(m[100:], 1000)
    df = nearest.top_k(frame(spark, res, "resume_id"), frame(spark, post, "posting_id"), 7, block_rows=20, first_visits=1)
    assert got(df) == full(res, post, 7)


def test_blocks_are_skipped(spark):
    rng = np.random.default_rng(5)
    m = clustered(rng, 2200)
    res, post = rows(m[:200]), rows(m[200:], 1000)
    visited = []
    df = nearest.top_k(frame(spark, res, "resume_id"), frame(spark, post, "posting_id"), 5, 20, 1, visited)
    assert got(df) == full(res, post, 5)
    n_blocks = len(nearest.lay_out(frame(spark, post, "posting_id"), 20)[1].block)
    assert n_blocks >= 100 and len(visited) > 1
    assert sum(visited) < 0.35 * n_blocks * len(res)


def test_ties_zeros_and_missing_vectors(spark):
    res = [(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None)]
    post = [(10 + i, [1.0, 0.0] if i % 3 else [0.0, 2.0]) for i in range(40)] + [(5, [0.0, 0.0]), (90, None), (7, [1.0, 0.0])]
    df = nearest.top_k(frame(spark, res, "resume_id"), frame(spark, post, "posting_id"), 4, 3, 1)
    assert got(df) == full(res[:3], [p for p in post if p[1]], 4)
    assert [p for p, _ in got(df)[1]] == [7, 11, 12, 14] and [p for p, _ in got(df)[2]] == [5, 7, 10, 11]


def test_few_or_no_rows(spark):
    one = frame(spark, [(1, [1.0, 0.0])], "resume_id")
    post = frame(spark, [(9, [1.0, 1.0])], "posting_id")
    assert got(nearest.top_k(one, post, 3)) == {1: [(9, 0.70711)]}
    assert nearest.top_k(one, post.limit(0), 3).collect() == []
    assert nearest.top_k(one.limit(0), post, 3).collect() == []


def test_bound_holds_for_every_posting(spark):
    rng = np.random.default_rng(8)
    m = nearest.unit(clustered(rng, 400, spread=0.4))
    blocks, d = nearest.lay_out(frame(spark, rows(m[50:], 1000), "posting_id"), 10)
    gaps = d.gaps(m[:50])
    where = {b: i for i, b in enumerate(d.block)}
    for r in blocks.collect():
        angle = np.arccos(np.clip(m[:50] @ nearest.unit(np.array([r.vec], float))[0], -1, 1))
        assert (gaps[:, where[r.block]] <= angle + 1e-6).all()
