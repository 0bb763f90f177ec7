import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelens.llm import packing
from tests.llm.helpers import ODD, clashing, table


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_those_of_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    own = packing._encoder(packing.default_vocabulary()).encode_ordinary(text)
    assert own == t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def contract():
    """As the contract calls it: added tokens inside a text are ids of their own."""
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endof", " ", "\n"]))))
def test_added_tokens_are_ids_of_their_own(contract, parts):
    text = "".join(parts)
    assert packing.encode(text, packing.default_vocabulary()) == contract(text)


def test_rows_with_an_added_token(spark, contract):
    text = "a <|endoftext|> b"
    assert contract(text) == [64, 220, 50256, 275]
    row, = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.length == 5
    assert row.ids_crc32 == zlib.crc32(np.array([*contract(text), 0], "<u4").tobytes())


@pytest.mark.parametrize("text", [
    " " * 1_000_100, "a" + "\n" * 2_000_000 + "b", "a <|endoftext|>" + "\u3000\t" * 600_000 + " b"])
def test_very_long_white_space(contract, text):
    assert packing.encode(text, packing.default_vocabulary()) == contract(text)


def test_every_long_run_is_seen():
    n = packing.SPACES
    assert all(packing._spacious("x" * at + " " * (2 * n) + "x") for at in (0, 1, n - 1, n, n + 1))
    assert not packing._spacious(" " * (n - 1)) and not packing._spacious("x " * 2 * n)


def test_rows_with_very_long_white_space(spark, contract):
    text = "a" + " " * 1_500_000 + "b"
    rows = packing.pack_documents(spark.createDataFrame([(1, text), (2, "c")], "doc_id long, text string")).toPandas()
    check(rows)
    assert rows[rows.doc_id == 1].length.sum() == len(contract(text)) + 1


def check(rows: pd.DataFrame, size=packing.SIZE):
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        assert s.length.sum() <= size
    for _, s in rows.drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        s = s.sort_values("piece")
        assert s.piece.tolist() == list(range(len(s)))
        assert s.start.tolist() == [0, *np.cumsum(s.length)[:-1]]
        assert (s.length[1:] == size).all()


def test_round_trip(documents, reference):
    rows = packing.pack_documents(documents).toPandas()
    check(rows)
    by_doc = {k: g.sort_values("piece") for k, g in rows.groupby("doc_id")}
    for d in documents.collect():
        ids = np.array([*reference(d.text or ""), 0], "<u4")
        pieces = by_doc[d.doc_id]
        assert pieces.length.sum() == len(ids)
        assert pieces.ids_crc32.tolist() == [zlib.crc32(ids[s:s + n].tobytes())
                                             for s, n in zip(pieces.start, pieces.length)]
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / packing.SIZE + 1


def test_odd_rows(spark):
    rows = packing.pack_documents(clashing(table(spark))).toPandas()
    assert (rows.groupby("sequence_id").length.sum() <= packing.SIZE).all()
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    assert (rows.doc_id.isna() & (rows.piece == 0)).sum() == 2
    assert (rows[rows.piece == 0].shape[0]) == len(ODD)
    assert rows[rows.doc_id.isin([1, 2])].length.tolist() == [1, 1]
    assert packing.pack_documents(table(spark, [])).collect() == []


def test_sum_of_squares_takes_the_best_gap():
    rng = np.random.default_rng(3)
    size = 40
    lengths = rng.integers(1, 40, 300)
    bins, offsets = packing.sum_of_squares(lengths, size)
    gaps = []
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        def squares(change):
            after = list(gaps)
            change(after)
            return sum(after.count(g) ** 2 for g in range(1, size))
        choices = [squares(lambda a: a.append(size - n))]
        choices += [squares(lambda a, i=i: a.__setitem__(i, a[i] - n)) for i, g in enumerate(gaps) if g >= n]
        if b == len(gaps):
            gaps.append(size)
        assert o == size - gaps[b]
        gaps[b] -= n
        assert gaps[b] >= 0
        assert sum(gaps.count(g) ** 2 for g in range(1, size)) == min(choices)


def test_many_blocks_meet(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 3000)
    items = spark.createDataFrame(pd.DataFrame({"item": np.arange(3000), "length": lengths}))
    rows = packing.pack(items, block=100, fan=4).toPandas()
    assert sorted(rows["item"]) == list(range(3000))
    rows["length"] = lengths[rows["item"]]
    for _, s in rows.groupby("sequence"):
        s = s.sort_values("at")
        assert s["at"].tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert rows.sequence.nunique() <= 1.05 * lengths.sum() / 2048 + 1  # tiny blocks leave more open
