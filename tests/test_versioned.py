"""Copy-on-write tables: old or new is seen, untouched files stay."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from hirelens.operators import changes as CH
from hirelens.sources import versioned
from tests.test_changes import AS_OF, CHANGES, WANT, _frames


def _files(base):
    return {f for f in glob.glob(f"{base}/data/*/*/*.parquet")}


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def stored(spark, tmp_dir):
    base, changes = _frames(spark)
    CH.create_table(base, f"{tmp_dir}/t", 8)
    return f"{tmp_dir}/t", base, changes


def test_snapshot_equals_apply_changes(spark, stored):
    path, base, changes = stored
    out = CH.write_changes(spark, path, changes, AS_OF, 8)
    assert {r.seq: r.outcome for r in out.collect()} == WANT
    assert _rows(versioned.read_version(spark, path)) == _rows(CH.apply_changes(base, changes, AS_OF)[0])
    assert _rows(versioned.read_version(spark, path, 0)) == _rows(base)
    assert versioned.versions(spark, path) == [0, 1]


def test_untouched_parts_keep_their_files(spark, stored):
    path, base, changes = stored
    before, named = _files(path), versioned.parts(spark, path)
    one = changes.filter("seq = 9")                        # a patch of id 2
    CH.write_changes(spark, path, one, AS_OF, 8)
    bucket = base.filter("id = 2").select(versioned.id_bucket("id", 8)).first()[0]
    after = versioned.parts(spark, path)
    assert before < _files(path) and len(_files(path)) == len(before) + 1
    assert {p: v for p, v in after.items() if p != bucket} == {p: v for p, v in named.items() if p != bucket}
    assert after[bucket] == 1


def test_only_touched_parts_are_read(spark, stored):
    path, base, _ = stored
    named = sorted(versioned.parts(spark, path))
    df = versioned.read_version(spark, path, only=named[:1])
    assert all(f"{versioned.PART}={named[0]}/" in f for f in df.inputFiles())


def test_a_failed_write_leaves_the_old_version(spark, stored):
    path, base, changes = stored
    named = versioned.parts(spark, path)
    fails = base.withColumn("notes", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        versioned.replace_parts(fails, path, versioned.id_bucket("id", 8), ["id"], list(named))
    assert versioned.versions(spark, path) == [0] and _rows(versioned.read_version(spark, path)) == _rows(base)
    # the next writer takes the same number and succeeds over what was left
    CH.write_changes(spark, path, changes, AS_OF, 8)
    assert _rows(versioned.read_version(spark, path)) == _rows(CH.apply_changes(base, changes, AS_OF)[0])


def test_a_version_is_published_once(spark, stored):
    path, base, _ = stored
    with pytest.raises(Exception, match="exists"):
        versioned._publish(spark, path, 0, {})
    with pytest.raises(ValueError, match="not replaced"):
        versioned.replace_parts(base, path, versioned.id_bucket("id", 8), ["id"], [])


def test_no_change_and_all_rows_deleted(spark, stored):
    path, base, changes = stored
    CH.write_changes(spark, path, changes.limit(0), AS_OF, 8)
    assert _rows(versioned.read_version(spark, path)) == _rows(base)
    gone = spark.createDataFrame([(i, "delete", i, u, {}) for i, u in ((1, 10), (2, 10), (3, 20))], changes.schema)
    CH.write_changes(spark, path, gone, AS_OF, 8)
    now = versioned.read_version(spark, path)
    assert now.columns == base.columns and now.collect() == []
    CH.write_changes(spark, path, spark.createDataFrame(CHANGES[:1], changes.schema), AS_OF, 8)
    assert [r.id for r in versioned.read_version(spark, path).collect()] == [100]
    assert os.path.isdir(f"{path}/versions/v=3")


def test_propagation_in_dependency_order(spark):
    t = {
        "c": spark.createDataFrame([(1, 10, 100), (2, 11, 101), (3, 12, None), (4, None, 102), (5, 13, 102)], "id long, b long, a long"),
        "b": spark.createDataFrame([(10, 100), (11, 101), (12, 102), (13, 102)], "id long, a long"),
        "a": spark.createDataFrame([(100,), (101,), (102,)], "id long"),
    }
    keys = [CH.ForeignKey("c", "b", "b", True), CH.ForeignKey("c", "a", "a", False), CH.ForeignKey("b", "a", "a", True)]
    assert CH.delete_order(list(t), keys) == ["a", "b", "c"]
    ask = {"a": spark.createDataFrame([(102,), (102,), (999,)], "id long"), "c": spark.createDataFrame([(1,), (5,)], "id long")}
    left, gone = CH.propagate_deletes(t, keys, ask)
    assert {n: {(r.id, r.because) for r in df.collect()} for n, df in gone.items()} == {
        "a": {(102, "asked")}, "b": {(12, "a"), (13, "a")}, "c": {(1, "asked"), (5, "asked"), (3, "b")}}
    assert {n: {tuple(r) for r in df.collect()} for n, df in left.items()} == {
        "a": {(100,), (101,)}, "b": {(10, 100), (11, 101)}, "c": {(2, 11, 101), (4, None, None)}}
    left, gone = CH.propagate_deletes(t, keys, {})
    assert all(df.count() == 0 for df in gone.values()) and left["c"].count() == 5
    with pytest.raises(ValueError, match="circle"):
        CH.delete_order(["a", "b"], [CH.ForeignKey("a", "x", "b", True), CH.ForeignKey("b", "x", "a", True)])
