import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelens.llm import common
from tests.llm.helpers import lower, words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é.\n\t\x0b", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_hashes_name_words(texts):
    named = {}
    for w in common.hash_docs(texts):
        for i in range(w.n):
            own = words(lower(texts[w.first + i]))
            hashes = w.hashes[w.bounds[i]:w.bounds[i + 1]].tolist()
            assert len(own) == len(hashes)
            for a, h in zip(own, hashes):
                assert named.setdefault(a, h) == h
    assert len(set(named.values())) == len(named)


def test_long_texts_are_hashed_whole():
    long = " ".join(f"w{i}" for i in range(120_000))
    assert len(long) > 2 * common._SEGMENT
    parts = list(common.hash_docs(["w1 w2", long, "z" * 600_000, "w3"]))
    assert [int(n) for w in parts for n in np.diff(w.bounds)] == [2, 120_000, 1, 1]
    whole = np.concatenate([w.hashes for w in parts])
    assert whole[0] == whole[2 + 1] and whole[-1] == whole[2 + 3]


def test_punctuation_can_end_words():
    [a] = common.hash_docs(["trash, Trash%%% trash"], punctuation=False)
    assert len(set(a.hashes.tolist())) == 1
