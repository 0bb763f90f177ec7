"""CSV files with line breaks in their values, read by several tasks a file."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from hirelens.sources import csvio

SCHEMA = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("title", T.StringType()),
                       T.StructField("description", T.StringType())])
SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def small_splits(spark):
    keys = {SPLIT: "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(path, rows, end="\r\n", header=True):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    if header:
        w.writerow(SCHEMA.names)
    w.writerows(rows)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(out.getvalue())


def _random(rng, n, first=0):
    bits = ["a", 'say "hi"', "x,y", "\n", "\r\n", "\n\n", "é", '"', '""', ",", " ", "line " * 20, "NA "]
    return [(first + i, rng.choice(["t", 'a "b"', "c,d", "two\nlines"]), "".join(rng.choices(bits, k=rng.randint(1, 60))) + ".")
            for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_in_file_order_from_many_ranges(spark, tmp_dir, small_splits, end):
    rng = random.Random(4)
    first, second = _random(rng, 150), _random(rng, 40, 1000)
    first.insert(3, (900, "long", "start\n" + "middle \"quoted\"\n" * 150 + "end"))     # over many ranges
    _write(f"{tmp_dir}/a.csv", first, end)
    _write(f"{tmp_dir}/b.csv", second, end)
    lines = csvio._lines(spark, tmp_dir)
    assert lines.select("file", "start").distinct().count() > 30 and lines.rdd.getNumPartitions() > 8
    got = csvio.read_csv_records(spark, tmp_dir, SCHEMA).orderBy("position").collect()
    assert [(r.job_id, r.title, r.description) for r in got] == first + second


def test_same_as_the_multi_line_reader(spark, tmp_dir, small_splits):
    rows = [r for r in _random(random.Random(9), 80)]
    _write(f"{tmp_dir}/a.csv", rows, "\n")
    whole = csvio.read_csv(spark, tmp_dir, SCHEMA)
    assert sorted(map(tuple, csvio.read_csv_records(spark, tmp_dir, SCHEMA).select(*SCHEMA.names).collect())) \
        == sorted(map(tuple, whole.collect()))


def test_missing_values_blank_lines_and_columns(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w", encoding="utf-8") as f:
        f.write('job_id,title,description\n1,NA,"a\nb"\n\n2,,""\n3,"x"\n4,t,last')
    got = csvio.read_csv_records(spark, tmp_dir, SCHEMA, ["description", "job_id"]).orderBy("position")
    assert got.columns == ["description", "job_id", "position"]
    assert [(r.job_id, r.description) for r in got.collect()] == [(1, "a\nb"), (2, None), (3, None), (4, "last")]
    _write(f"{tmp_dir}/b.csv", [])
    assert csvio.read_csv_records(spark, f"{tmp_dir}/b.csv", SCHEMA).collect() == []


def test_an_unclosed_quote_is_an_error(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write('job_id,title,description\n1,t,"open\n2,t,x\n')
    with pytest.raises(ValueError, match="not closed"):
        csvio.read_csv_records(spark, tmp_dir, SCHEMA)


def test_written_tables_are_read_back(spark, tmp_dir):
    rows = [(i, 'q"', f"a\nb {i}, \"c\"") for i in range(50)] + [(None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    csvio.write_csv(df, f"{tmp_dir}/t")
    back = csvio.read_csv_records(spark, f"{tmp_dir}/t", SCHEMA).drop("position")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
