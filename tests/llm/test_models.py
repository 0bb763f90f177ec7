"""Quality and toxicity: held-out accuracy, folds and odd rows."""

import zlib

import numpy as np
import pytest

from hirelens.llm import common, quality, toxicity
from tests.llm.helpers import LABELS, clashing, table


@pytest.fixture(scope="module")
def learned(spark):
    from hirelens.sources.tables import read_table
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    return {m: (f(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id"), label)
            for m, f, label in (("quality", quality.quality, "quality"), ("toxicity", toxicity.toxicity, "toxic"))}


def test_quality_held_out(learned):
    rows, label = learned["quality"]
    rows = rows[rows.held_out]
    assert ((rows.predicted == 1) == (rows[label] == 1)).mean() > 0.99


def test_toxicity_held_out(learned):
    rows, label = learned["toxicity"]
    rows = rows[rows.held_out]
    toxic = rows[label] == 1
    assert rows.predicted[toxic].mean() > 0.6
    assert rows.predicted[~toxic].mean() < 0.01


def test_fold_is_the_documents_crc(learned):
    rows, _ = learned["quality"]
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id] == rows.held_out.tolist()


@pytest.mark.parametrize("run,name", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_odd_rows(spark, run, name):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (7, 1, 0), (7, 0, 1), (7, None, None), (None, 1, 1),
                                    (8, 1, 0), (3, 0, 0)], LABELS)
    docs = table(spark)
    rows = run(clashing(docs), clashing(labels)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert len({r.score for r in rows if r.doc_id == 7}) == 1


@pytest.mark.parametrize("run,score", [(quality.quality, 0.5), (toxicity.toxicity, 0.0)])
def test_no_labels_and_no_rows(spark, run, score):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in run(table(spark), none).collect()} == {score}
    assert run(table(spark, []), none).collect() == []


def test_the_sample_is_bounded_whatever_rows_repeat(spark):
    one, two, three = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    docs = table(spark, [(one, f"text {i % 2}", "en", "a", 6) for i in range(50)]
                 + [(two, "other", "en", "a", 5), (three, None, "en", "a", 0)])
    labels = spark.createDataFrame([(one, 1, 1), (one, 0, 0), (two, 0, 0), (three, 1, 1)], LABELS)
    lengths = lambda texts: [str(len(t)).encode() for t in texts]
    rows = common.labelled_sample(docs, labels, "toxic", 10, lengths).collect()
    assert {(r.doc_id, r.label, bytes(r.x)) for r in rows} == {(one, 1, b"6"), (two, 0, b"5")} and len(rows) == 2
    assert common.labelled_sample(docs, labels, "toxic", 1, lengths).count() <= 1


def test_vote_equals_a_plain_neighbour_loop():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(60)] + ["", "w1"]
    idf = rng.random(256).astype(np.float32) + 0.5
    axes = quality.fit_axes(quality.term_vectors(texts[:40], idf), 12)
    near = quality._unit(quality.term_vectors(texts[:40], idf) @ axes)
    label = rng.integers(0, 2, 40).astype(np.float32)
    got = quality.vote(texts, {"idf": idf, "axes": axes, "near": near, "label": label}, 7)
    for text, score in zip(texts, got):
        v = (quality.term_vectors([text], idf) @ axes)[0]
        pairs = []
        for m, y in zip(near, label):
            n = np.linalg.norm(v) * np.linalg.norm(m)
            pairs.append((float(v @ m / n) if n > 1e-12 else 0.0, float(y)))
        best = sorted(pairs, reverse=True)[:7]
        total = sum(max(c, 0) for c, _ in best)
        want = sum(max(c, 0) * y for c, y in best) / total if total > 1e-9 else float(label.mean())
        assert abs(score - want) < 1e-4


def plain_slots(text, bits):
    """Distinct words, neighbouring pairs and pairs with one word between, hashed one by one."""
    [w] = common.hash_docs([text], punctuation=False)
    h = [int(x) for x in w.hashes]
    out = {x >> (64 - bits) for x in h}
    for gap, factor in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        for a, b in zip(h, h[gap:]):
            pair = np.array([(a * factor + b) % (1 << 64)], np.uint64)
            out.add(int(common.mix64(pair)[0]) >> (64 - bits))
    return out


def test_toxicity_equals_a_plain_ftrl(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, 8)), "en", "a", 1) for i in range(40)] + [(100, "", "en", "a", 0), (101, None, "en", "a", 0)]
    marks = [(i, 0, int("w3" in t.split())) for i, t, *_ in rows[:40]]
    docs, labels = table(spark, rows), spark.createDataFrame(marks, LABELS)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, bits=10, l1=0.1, epochs=3).collect()}
    key = {r.doc_id: r.key for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS key").collect()}
    text = {i: t for i, t, *_ in rows}
    order = sorted((key[i], i, y) for i, _, y in marks if zlib.crc32(str(i).encode()) % 4 != 2)
    z, n = {}, {}

    def weight(s):
        limit = 0.0 if s == 1024 else 0.1
        zs = z.get(s, 0.0)
        if abs(zs) <= limit:
            return 0.0
        return -(zs - np.sign(zs) * limit) / ((toxicity.BETA + np.sqrt(n.get(s, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for _, i, y in order:
            at = [*plain_slots(text[i], 10), 1024]
            w = {s: weight(s) for s in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for s in at:
                before = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / toxicity.ALPHA * w[s]
                n[s] = before + g * g
    for i, t, *_ in rows:
        total = weight(1024) + sum(weight(s) for s in (plain_slots(t, 10) if t else ()))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-5


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 1000, 30)) for _ in range(400)]
    y = np.array([float(5 in r or 17 in r) for r in rows])
    w = toxicity.fit_ftrl(rows, y, 10, l1=2.0)
    assert w[5] > 1 and w[17] > 1
    assert (w == 0).sum() > 0.9 * len(w)


def test_drop_toxic_keeps_columns_and_clean_rows(spark):
    from hirelens.sources.tables import read_table
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    gone = docs.join(left, "doc_id", "left_anti").join(labels, "doc_id")
    clean = labels.where("toxic = 0").count()
    assert gone.where("toxic = 0").count() < 0.01 * clean
    assert gone.where("toxic = 1").count() > 0.6 * labels.where("toxic = 1").count()
