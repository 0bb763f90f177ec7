"""The stages of the corpus pipeline: each on what its predecessor kept."""

import corpus_pipeline as P
from hirelens.llm.common import materialize
from hirelens.sources.tables import read_table
from tests.llm import helpers as H


def test_stages(spark, sf, documents):
    docs = documents
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf), name)
        assert after.dtypes == documents.dtypes, name
        kept[name] = (docs.toPandas(), after.toPandas())
        docs = after
    before, after = kept["line_dedup"]
    gone = H.later_lines(list(zip(before.doc_id, before.text)), 25)
    assert len(gone) == sum(len(H.lines_with_words(t)) for t in before.text) - sum(
        len(H.lines_with_words(t)) for t in after.text)
    before, after = kept["near_dedup"]
    assert set(after.doc_id) == {c for _, c in H.components(list(zip(before.doc_id, before.text)), 5).values()}
    before, after = kept["mix"]
    assert set(after.doc_id) <= set(before.doc_id)
    before, after = kept["toxicity"]
    labels = read_table(spark, sf, "labels").toPandas().set_index("doc_id").toxic
    lost = set(before.doc_id) - set(after.doc_id)
    assert sum(labels.get(i, 1) == 0 for i in lost) <= 2  # learned from some 60 rows

    packed = P.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(docs.toPandas().doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_take_odd_and_empty_tables(spark, sf):
    for rows in (H.ODD, []):
        docs = H.table(spark, rows)
        for name, stage in P.STAGES:
            docs = materialize(stage(spark, docs, sf), name)
        if not rows:
            assert docs.count() == 0


def test_stages_pass_clashing_columns(spark, sf):
    docs = H.clashing(H.table(spark))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        stage(spark, docs, sf).collect()
