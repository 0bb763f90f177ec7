"""Model vectors written with the corpus; the layout for reads by user."""

import os
import uuid

import numpy as np
import pytest

from hirelens.operators import encoder, tracker
from hirelens.sources import sinks, tenant


def logging_model(path):
    """Loads a model that notes each load and each batch; local, so that workers get it whole."""
    class Logging:
        def encode(self, texts):
            with open(f"{path}/batch-{uuid.uuid4().hex}", "w") as f:
                f.write(",".join(str(len(t)) for t in texts))
            return np.array([[len(t), 1.0] for t in texts])

    def load():
        with open(f"{path}/load-{uuid.uuid4().hex}", "w") as f:
            f.write(str(os.getpid()))
        return Logging()
    return load


def _notes(path, kind):
    return [open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith(kind)]


def test_model_is_loaded_once_a_worker_and_batches_are_of_like_length(spark, tmp_dir):
    rows = [(i, "x" * ((i * 7919) % 500)) for i in range(2000)] + [(9000, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(24)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "50")
    try:
        got = {r.id: r.vector for r in encoder.encode(df, "t", logging_model(tmp_dir), size=32).collect()}
    finally:
        spark.conf.set(conf, before)
    for i, t in rows:
        n = np.hypot(len(t or ""), 1.0)
        assert got[i] == pytest.approx([len(t or "") / n, 1 / n], rel=1e-6)
    loads = _notes(tmp_dir, "load")
    assert len(loads) == len(set(loads)) < 24
    batches = [[int(x) for x in b.split(",")] for b in _notes(tmp_dir, "batch")]
    assert max(map(len, batches)) == 32 and sum(map(len, batches)) == 2001
    assert all(b == sorted(b) for b in batches)


def test_batches_are_bounded_by_characters():
    texts = ["a" * 10, "b" * 95, "c" * 100, "", "d" * 500, "e" * 60]
    places = [[int(i) for i in p] for p in encoder.in_batches(texts, 3, 200)]
    assert places == [[3, 0, 5], [1, 2], [4]] and list(encoder.in_batches([], 3, 200)) == []


def test_window_cuts_only_when_asked(spark):
    df = spark.createDataFrame([(1, "a" * 600 + "b" * 600)], "id long, t string")
    whole = encoder.encode(df, "t", encoder.LetterModel).first().vector
    cut = encoder.encode(df, "t", encoder.LetterModel, window=512).first().vector
    assert whole[:2] == pytest.approx([0.5 ** 0.5] * 2, rel=1e-6) and cut[:2] == [1.0, 0.0]
    assert set(encoder.encode(df.limit(0), "t", encoder.LetterModel).columns) == {"id", "t", "vector"}


def test_vectors_are_stored_in_their_rows(spark, tmp_dir):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (1, "Zz")], "job_id long, t string")
    meta = spark.createDataFrame([("x", "[]", "{}")], "trained_at string, top_categories string, exp_distribution string")
    base = sinks.write_corpus_artefacts(encoder.encode(df, "t", encoder.LetterModel), meta, f"{tmp_dir}/a")
    rows = {(r.job_id, r.t): r.vector for r in sinks.load_corpus_artefacts(spark, base)[0].collect()}
    assert rows[1, "Zz"][25] == 1.0 and rows[1, "ab"][:2] == pytest.approx([0.5 ** 0.5] * 2, rel=1e-6)
    assert not any(rows[2, ""]) and not any(rows[3, None])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_by_user_prune_buckets_and_need_no_shuffle(spark, tmp_dir):
    rows = [(i, i % 100, "saved" if i % 2 else "offer", i // 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, user_id long, status string, created_at long")
    name = "t" + uuid.uuid4().hex[:10]
    t = tenant.write_user_table(df, name, f"{tmp_dir}/{name}", buckets=8)
    one = sinks.rows_of_user(spark, name, 17, "offer")
    parts = lambda d: d._jdf.queryExecution().toRdd().getNumPartitions()
    assert parts(one) == 1 and parts(spark.table(name)) == 8    # a file a partition, of one bucket
    assert "EqualTo(user_id,17)" in _plan(one) and "EqualTo(status,offer)" in _plan(one)
    assert sorted(r.id for r in one.collect()) == [i for i, u, s, _ in rows if u == 17 and s == "offer"]
    latest = tracker.latest_per_user(t, ["id", "created_at"])
    assert "Exchange" not in _plan(latest)
    want = {}
    for i, u, _, c in rows:
        want[u] = max(want.get(u, (-1, -1)), (c, i))
    assert {r.user_id: (r.created_at, r.id) for r in latest.collect()} == want
    assert "Exchange" not in _plan(tracker.status_counts(tenant.user_table(spark, name)))
