"""V1 encoder: unit vectors, and cosine on them agrees with a brute-force computation."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from hirelens.operators.vectors import tfidf_vectors


def test_tfidf_rows_are_unit_vectors(spark):
    df = E.queries()["tfidf_vectors"](spark, "/root/testdata/sf0.001")
    rows = df.select("nnz", "norm").collect()
    assert rows and all((r.norm == 1.0) == (r.nnz > 0) for r in rows)
    assert all(r.norm in (0.0, 1.0) for r in rows)


def test_tfidf_brute_force_cosine(spark):
    texts = [(1, "python sql spark"), (2, "python sql"), (3, "cooking baking"), (4, "python sql spark")]
    df = spark.createDataFrame(texts, "id long, t string")
    v = {r.id: r.a for r in tfidf_vectors(df, "id", "t", 1 << 12)
         .select("id", vector_to_array("features").alias("a")).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b))

    # same text -> same vector; shared terms -> positive; disjoint terms -> 0
    assert math.isclose(cos(v[1], v[4]), 1.0, rel_tol=1e-9)
    assert cos(v[1], v[2]) > 0.5 and cos(v[1], v[3]) == 0.0
    # brute force: idf = ln((m + 1) / (df + 1)); tf-idf weights of text 2 are python, sql
    m = 4
    idf = {w: math.log((m + 1) / (sum(w in t.split() for _, t in texts) + 1)) for w in ["python", "sql", "spark"]}
    a = [idf["python"], idf["sql"], idf["spark"]]
    b = [idf["python"], idf["sql"], 0.0]
    want = cos(a, b) / (math.sqrt(cos(a, a)) * math.sqrt(cos(b, b)))
    assert math.isclose(cos(v[1], v[2]), want, rel_tol=1e-9)


def test_encoder_reads_whole_texts(spark):
    df = spark.createDataFrame([(1, "pad " * 300 + "tail"), (2, "pad " * 300), (3, "other")], "id long, t string")
    nnz = {r.id: r.nnz for r in tfidf_vectors(df, "id", "t", 1 << 12).collect()}
    assert nnz[1] == 2 and nnz[2] == 1
    cut = {r.id: r.nnz for r in tfidf_vectors(df, "id", "t", 1 << 12, window=512).collect()}
    assert cut[1] == 1


def test_top_matches_normalises(spark):
    from hirelens.operators.matching import top_matches
    schema = "vec_id long, embedding array<float>"
    res = spark.createDataFrame([(1, [3.0, 0.0])], schema)
    post = spark.createDataFrame([(10, [5.0, 5.0]), (11, [0.5, 0.0]), (12, [0.0, 0.0])], schema)
    got = [(r.posting_id, r.score) for r in top_matches(res, post, 3).orderBy("rank").collect()]
    assert got == [(11, 1.0), (10, 0.707107), (12, 0.0)]


def test_slots_without_weight_are_dropped_before_the_sum(spark):
    df = spark.createDataFrame([(1, "Go SQL go"), (2, "sql"), (3, ""), (4, "rust")], "id long, t string")
    out = tfidf_vectors(df, "id", "t", 1 << 12)
    assert {r.id: (r.nnz, r.norm) for r in out.collect()} == {1: (2, 1.0), 2: (1, 1.0), 3: (0, 0.0), 4: (1, 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove" in plan and "filter(" not in plan
