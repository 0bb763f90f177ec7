"""Skew-safe ranking helpers agree with plain windows on a hot key; CSV null tokens."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelens.operators.ordering import position_within, top_k_within
from hirelens.sources import csvio
from pyspark.sql import types as T


def _skewed(spark):
    # key 0 holds 3000 of 3300 rows; ties on v broken by id
    return spark.range(3300).select(
        F.col("id"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * 7919 % 101).alias("v"))


def test_position_within_hot_key(spark):
    df = _skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = position_within(df, ["k"], order, num_partitions=6).select("id", "pos")
    want = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).alias("pos"))
    assert got.count() == 3300
    assert got.exceptAll(want).count() == 0


def test_top_k_within_hot_key(spark):
    df = _skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = top_k_within(df, ["k"], order, 5, salt_col="id").select("k", "id", "rank")
    want = (df.select("k", "id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).alias("rank"))
            .filter("rank <= 5"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_csv_missing_tokens_and_newlines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p.csv")
    with open(path, "w") as f:
        f.write('job_id,title,description\n1,NA,"line one\nline two"\n2,N/A,""\n3,ok,null\n4,x,kept\n')
    schema = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("title", T.StringType()),
                           T.StructField("description", T.StringType())])
    rows = {r.job_id: (r.title, r.description) for r in csvio.read_csv(spark, path, schema).collect()}
    assert rows == {1: (None, "line one\nline two"), 2: (None, None), 3: ("ok", None), 4: ("x", "kept")}
    with open(path, "w") as f:
        f.write('job_id,title,description\n1,"a ""b""",c\n2,,"d,e"\n')
    got = [tuple(r) for r in csvio.read_csv(spark, path, schema, multi_line=False).orderBy("job_id").collect()]
    assert got == [(1, 'a "b"', "c"), (2, None, "d,e")]


def test_position_within_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 7), (4, 7)], "id long, k long")
    got = {r.id: r.pos for r in position_within(df, ["k"], [F.col("id").asc()], num_partitions=3).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}


def test_only_one_machine_counts_as_local():
    from hirelens.session import is_local
    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
