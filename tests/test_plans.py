"""Plan checks: broadcast label join, pruning and pushdown at the scan, no Python in
the JVM-only queries."""

import pytest

import __spark_entry__ as E
from hirelens.plans.registry import QUERIES

D = "/root/testdata/sf0.001"
PYTHON_OK = {"top_matches", "resume_intake_checks", "resume_append", "tfidf_vectors", "stream_weekly_trends",
             "corpus_csv_roundtrip", "window_vectors"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_join_is_broadcast(spark):
    assert "BroadcastHashJoin" in _plan(E.queries()["job_skill_lists"](spark, D))


def test_scan_prunes_columns(spark):
    p = _plan(E.queries()["job_skill_lists"](spark, D))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p


def test_filter_pushed_to_scan(spark):
    p = _plan(E.queries()["trend_upsert"](spark, D))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_OK))
def test_no_python_nodes(spark, name):
    p = _plan(E.queries()[name](spark, D))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p, (name, node)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - {"stream_weekly_trends", "stream_weekly_restarted"}))
def test_no_cross_products(spark, name):
    p = _plan(E.queries()[name](spark, D))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in p, (name, node)


def test_corpus_cleans_each_text_once(spark):
    import re

    from hirelens.functions.text import KEPT_RUN
    p = E.queries()["corpus_final"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(re.escape(KEPT_RUN), p)) == 1


def test_posting_texts_are_shuffled_once(spark):
    """The scrapes of a job stay where the join with the labels put them."""
    from hirelens.operators.corpus import keep_first
    from hirelens.sources import adapters as A
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        p = _plan(keep_first(A.postings(spark, D)))
    finally:
        spark.conf.set(key, before)
    with_text = [line for line in p.splitlines() if "FileScan" in line and "text:string" in line]
    assert len(with_text) == 1
    # documents, the labels made distinct: no third exchange for keep-first
    assert p.count("Exchange hashpartitioning") == 2, p
