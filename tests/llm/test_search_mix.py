"""Vector search and source mixing."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hirelens.llm import mixing, vector_search
from tests.llm import helpers as H

QUERY = "vec_id % 20 = 0"


def brute(table: pd.DataFrame, k=20):
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        yield ids[i], ids[order].tolist(), s[order].tolist()


def test_search_recall_scores_and_order(spark):
    from hirelens.sources.tables import read_table
    table = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    got = vector_search.search(table, QUERY).toPandas()
    found = total = 0
    rows = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    x = table.toPandas().set_index("vec_id").embedding
    for q, ids, _ in brute(table.toPandas()):
        own = rows[q]
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert own.score.is_monotonic_decreasing
        exact = [float(np.dot(np.array(x[q], float), np.array(x[v], float))) for v in own.vec_id]
        assert np.allclose(own.score, exact, rtol=0, atol=1e-12)
        found += len(set(ids) & set(own.vec_id))
        total += 20
    assert found / total >= 0.9


def test_search_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHARD", 40)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[50:150] = x[7]  # one vector fills a third of the table
    table = pd.DataFrame({"vec_id": np.arange(300), "embedding": x.tolist()})
    got = vector_search.search(spark.createDataFrame(table), QUERY, centroids=4, recall=1.0).toPandas()
    rows = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    for q, ids, scores in brute(table):
        assert rows[q].vec_id.tolist() == ids and np.allclose(rows[q].score, scores)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, []), (9, [2.0, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]),
            (11, [1.0, 2.0, 3.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    table = H.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vector_search.search(table, QUERY).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (0, 1, 9, 2.0), (0, 2, 20, 1.0), (0, 3, 12, 0.0), (0, 4, 13, 0.0),
        (20, 1, 9, 2.0), (20, 2, 0, 1.0), (20, 3, 12, 0.0), (20, 4, 13, 0.0)]
    assert vector_search.search(table.limit(0), QUERY).collect() == []
    assert vector_search.search(table.where("vec_id = 9"), QUERY).collect() == []


def test_search_among_copies_of_one_vector(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in (0, 3, 20, 21)], "vec_id long, embedding array<float>")
    got = vector_search.search(table, QUERY).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [
        (0, 3, 5.0), (0, 20, 5.0), (0, 21, 5.0), (20, 0, 5.0), (20, 3, 5.0), (20, 21, 5.0)]
    assert vector_search.search(table.where("vec_id = 0"), QUERY).collect() == []


def test_own_copies_are_found_with_the_smallest_depth(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "measure", lambda *a: 0)
    x = np.random.default_rng(4).standard_normal((60, 4)).astype(np.float32)
    x[1::20] = x[::20]  # each query has a copy
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vector_search.search(table, QUERY).collect()
    assert {(0, 1), (20, 21), (40, 41)} <= {(r.query_id, r.vec_id) for r in got}


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    ix = vector_search.Index(rng.standard_normal((7, 3)), rng.standard_normal((5, 4)), 1.0)
    ix.count[:] = 1
    q = rng.standard_normal(6)
    a, b = ix.halves(q[None], None)
    d = (vector_search.squared(a, ix.left)[0][:, None] + vector_search.squared(b, ix.right)[0]).ravel()
    assert np.allclose(d[list(ix.walk(q))], np.sort(d))


def brute_targets(sizes):
    """source -> target, by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            out.update({s: weight[s] * level for s in free})
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        free -= over
    return out


def brute_seats(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        q = [Fraction(w) / (2 * n + 1) for w, n in zip(weights, won)]
        won[q.index(max(q))] += 1
    return won


@pytest.mark.parametrize("weights,seats", [([5, 2, 1], 37), ([1000, 1, 1, 1], 50), ([7] * 9, 13), ([3], 11),
                                           ([100, 60, 45, 3, 2, 1], 500)])
def test_apportionment_equals_one_seat_at_a_time(spark, weights, seats):
    rows = [(0, i, float(w), seats) for i, w in enumerate(weights)] + [(0, 99, 0.0, seats)]
    got = mixing.apportion(spark.createDataFrame(rows, "g int, p int, w double, s int"), "g", "p", "w", "s").collect()
    assert {r.p: r.quota for r in got} == dict(enumerate(brute_seats(weights, seats)))


def test_mix(documents):
    rows = mixing.mix(documents).toPandas().merge(documents.select("doc_id", "text", "source").toPandas(), on="doc_id")
    assert (rows["size"] == rows.text.map(lambda t: len(H.words(t)))).all()
    own = rows.groupby("source")["size"].sum().to_dict()
    want = brute_targets(own)
    for s, g in rows.groupby("source"):
        assert set(g.source_size) == {own[s]}
        assert g.target.iat[0] == pytest.approx(float(want[s]))
        assert abs(g.taken.sum() - float(want[s])) <= 4 * mixing.BLOCK
    assert (rows.taken <= 2 * rows["size"]).all()
    again = mixing.mix(documents.repartition(7)).toPandas().set_index("doc_id").taken
    assert (again.sort_index() == rows.set_index("doc_id").taken.sort_index()).all()


def test_mix_over_several_shards(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 3)
    rows = mixing.mix(documents).toPandas().merge(documents.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in rows.groupby("source"):
        assert abs(g.taken.sum() - g.target.iat[0]) <= 12 * mixing.BLOCK
    assert (rows.taken <= 2 * rows["size"]).all()


def test_mixed_documents_hold_the_words_taken(documents):
    plan = mixing.mix(documents).toPandas().set_index("doc_id")
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == documents.columns
    rows = mixed.toPandas()
    taken = rows.text.map(lambda t: len(H.words(t))).groupby(rows.doc_id).sum()
    assert taken.to_dict() == plan.taken[plan.taken > 0].to_dict()
    assert (rows.n_chars == rows.text.map(len)).all()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(t in texts[i] for i, t in zip(rows.doc_id, rows.text))


def test_mix_odd_rows(spark):
    rows = mixing.mix(H.clashing(H.table(spark)).drop("size")).collect()
    assert len(rows) == len(H.ODD)
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.taken <= 2 * r.size for r in rows)
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(empty).collect()} == {(0.0, 0)}
    assert mixing.mix(H.table(spark, [])).collect() == []
    assert mixing.mix_documents(H.table(spark, [])).collect() == []


def test_repeated_rows_and_null_ids_fill_no_shard_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 4)
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "a b c d e f g h", "s")] * 40 + [(None, f"t{i} u v w", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = docs.select("doc_id", "source", mixing.n_words(docs.text).alias("size"), mixing.text_hash(docs.text).alias("th"))
    numbered = mixing._numbered(sizes).collect()
    assert sorted(r.copy for r in numbered if r.size == 8) == list(range(40))
    shard = mixing._seeded(F.lit("shard"), F.col("doc_id"), F.col("th"), F.col("copy")) % 20
    per = mixing._numbered(sizes).groupBy(shard.alias("shard")).count().collect()
    assert len(per) > 10 and max(r["count"] for r in per) <= 16
    got = mixing.mix(docs).collect()
    assert len(got) == 80 and abs(sum(r.taken for r in got) - got[0].target) <= 40 * mixing.BLOCK


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_targets_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    sizes = {"b": 900, None: 40, "a": 10, "d": 0, "c": 333, "é": 2000, "Z": 7}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == {s: pytest.approx(float(t)) for s, t in brute_targets(sizes).items()}
