"""Near-duplicates and line dedup against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from hirelens.llm import line_dedup, near_dup
from hirelens.llm.components import components
from tests.llm import helpers as H


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(documents, width):
    want = H.components([(r.doc_id, r.text) for r in documents.collect()], width)
    rows = near_dup.near_duplicates(documents, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def family(seed=0):
    """Texts around one base: chains, near misses and singles, so that keys hold many classes."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 8, 12])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        out.append((i, " ".join(w)))
    return out


def test_families_with_many_components(spark, monkeypatch):
    rows = family()
    want = H.components(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for large, block in ((512, 2048), (6, 7)):  # once in small blocks, so that every path runs
        monkeypatch.setattr(near_dup, "FAMILY", large)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = near_dup.near_duplicates(docs, 2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 10


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dup.SYMBOLS)
        b = a.copy()
        b[rng.choice(near_dup.SYMBOLS, near_dup.MAX_DISTANCE, replace=False)] += 1
        keys = near_dup._keys(np.stack([a, b % (1 << 16)]))
        assert set(keys[0]) & set(keys[1])
        first = near_dup._first_shared_key(a[None], (b % (1 << 16))[None])[0]
        assert first in set(keys[0]) & set(keys[1])


def test_near_duplicates_odd_rows(spark):
    rows = near_dup.near_duplicates(H.clashing(H.table(spark)), 2).collect()
    assert len(rows) == len(H.ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert by[4][0].n_shingles == 1
    assert by[6][0].component_id == 5 and not by[6][0].kept
    assert [r.component_id for r in by[7]] == [7, 7]
    assert [r.component_id for r in by[None]] == [None, None]
    assert near_dup.near_duplicates(H.table(spark, []), 2).collect() == []


def test_keep_one_keeps_one_of_each_group(spark, documents):
    want = {c for _, c in H.components([(r.doc_id, r.text) for r in documents.collect()], 5).values()}
    left = near_dup.keep_one(documents)
    assert left.columns == documents.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(want)
    odd = near_dup.keep_one(H.clashing(H.table(spark))).collect()
    assert sorted((r.doc_id for r in odd), key=str) == sorted([1, 2, 3, 4, 5, 7, 8, None], key=str)


def test_components_of_a_long_chain(spark):
    n = 60
    links = pd.DataFrame({"a": list(range(n)), "b": [*range(1, n), n]}).sample(frac=1, random_state=1)
    links = pd.concat([links, pd.DataFrame({"a": [100, 102], "b": [101, 101]})])
    got = {r.id: r.component for r in components(spark.createDataFrame(links)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("least", [25, 6])
def test_line_dedup_equals_brute_force(documents, least):
    rows = {r.doc_id: r.text for r in documents.collect()}
    gone = H.later_lines(rows.items(), least)
    for r in line_dedup.line_dedup(documents, least).collect():
        own = {p for d, p in gone if d == r.doc_id}
        left = [x for i, x in enumerate(H.lines_with_words(rows[r.doc_id])) if i not in own]
        assert (r.n_removed, H.lines_with_words(r.text)) == (len(own), left)


def test_line_dedup_on_random_lines(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a b", "c d e", "f", "", "g h i j"]) for _ in range(rng.randrange(30))))
            for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (3, 9, 20):
        gone = H.later_lines(rows, least)
        got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs, least).collect()}
        assert got == {i: sum(d == i for d, _ in gone) for i, _ in rows}


def test_line_dedup_odd_rows(spark):
    docs = H.clashing(H.table(spark))
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(H.ODD)
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0, None: 0, 8: 0}
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, 7, None, None, 8], key=str)
    assert line_dedup.line_dedup(H.table(spark, [])).collect() == []


def test_short_common_lines_stay_and_passages_go(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"A short line.\nown {i} text {i * 7}\n{passage}") for i in range(5)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {
        0: rows[0][1], **{i: f"A short line.\nown {i} text {i * 7}" for i in range(1, 5)}}
