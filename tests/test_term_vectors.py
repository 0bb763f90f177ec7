"""Term vectors and pair cosines against a brute-force calculation."""

import math
from collections import Counter

from hirelens.operators.term_vectors import pair_cosines, term_weights

TEXTS = [(1, "go go sql"), (2, "SQL and c#"), (3, ""), (4, None), (5, "go"), (6, "sql")]


def brute():
    bags = {i: Counter((t or "").lower().split()) for i, t in TEXTS}
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for i, b in bags.items():
        w = {t: c * math.log((len(TEXTS) + 1) / (df[t] + 1)) for t, c in b.items()}
        n = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / n for t, x in w.items()}
    return out


def test_term_weights_and_cosines(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    w = term_weights(texts, "id", "text")
    want = brute()
    got = {(r.id, r.term): r.weight for r in w.collect()}
    assert set(got) == {(i, t) for i, d in want.items() for t in d}
    assert all(abs(got[i, t] - want[i][t]) < 1e-12 for i, t in got)
    pairs = spark.createDataFrame([(1, 2), (1, 5), (1, 3), (5, 5), (4, 2), (1, 2), (6, 99)], "a long, b long")
    rows = [tuple(r) for r in pair_cosines(pairs, "a", "b", w, "id").collect()]
    assert len(rows) == 7
    for a, b, score, pct in rows:
        dot = sum(x * want.get(b, {}).get(t, 0.0) for t, x in want[a].items())
        assert abs(score - min(1.0, dot)) < 1e-6 and pct == round(score * 100)


def test_empty_table_and_common_term(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert term_weights(none, "id", "text").count() == 0
    same = spark.createDataFrame([(1, "go"), (2, "go go")], "id long, text string")
    assert {r.weight for r in term_weights(same, "id", "text").collect()} == {0.0}


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_counted_in_their_rows(spark):
    """No task holds a table of the terms of many texts."""
    from hirelens.operators import term_vectors as V
    texts = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "ü a.b Ü")], "id long, text string")
    counts = V._counted(texts, "id", "text")
    assert "Aggregate" not in _executed(counts) and "Exchange" not in _executed(counts)
    assert {r.id: [tuple(t) for t in r.terms] for r in counts.collect()} == {
        1: [("a", 1), ("b", 2)], 2: [], 3: [], 4: [("a.b", 1)]}


def test_ids_in_several_rows(spark, monkeypatch):
    from hirelens.operators import joins
    split = spark.createDataFrame([(1, "go"), (1, "go sql"), (2, "SQL and"), (2, "c#"), (3, ""), (3, None), (5, "go"),
                                   (None, "x"), (None, "x y")], "id long, text string")
    whole = spark.createDataFrame([(1, "go go sql"), (2, "sql and c#"), (3, ""), (5, "go"), (None, "x x y")],
                                  "id long, text string")
    rows = [sorted((str(r.id), r.term, round(r.weight, 9)) for r in term_weights(t, "id", "text").collect())
            for t in (split, whole)]
    monkeypatch.setattr("hirelens.operators.term_vectors.is_small", lambda df: False)     # joined by shuffle
    rows.append(sorted((str(r.id), r.term, round(r.weight, 9)) for r in term_weights(split, "id", "text").collect()))
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 8
    assert joins.is_small(whole)


def test_cosines_shuffle_vectors_not_terms(spark):
    from hirelens.operators import term_vectors as V
    v = V.text_vectors(spark.createDataFrame(TEXTS, "id long, text string"), "id", "text").localCheckpoint()
    pairs = spark.createDataFrame([(1, 2), (5, 5)], "a long, b long")
    plan = _executed(V.vector_cosines(pairs, "a", "b", v, v, "id"))
    assert "Aggregate" not in plan and plan.count("term#") == 0
