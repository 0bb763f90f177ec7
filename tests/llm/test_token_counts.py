"""Token counts against the library run on whole texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelens.llm import token_counts as tc
from tests.llm.helpers import ODD, clashing, table


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tc.default_vocabulary())
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


def expected(rows, library, limit=tc.LIMIT):
    return sorted(((r[0] is not None, r[0]), len((r[1] or "").encode()), library(r[1]), library(r[1]) > limit)
                  for r in rows)


def got(df):
    return sorted(((r.doc_id is not None, r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def by_pieces(text, split):
    return sum(n * len(split.tokenizer.encode(p, add_special_tokens=False))
               for p, n in split.frequencies(text).items())


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.one_of(st.text(max_size=20), st.sampled_from(
    ["<|endoftext|>", "<|endof", " ", "\n", "'ll", "'s", "՘", "\U000323b0", " ", "x" * 40]))))
def test_sum_over_pieces(library, parts):
    text = "".join(parts)
    assert by_pieces(text, tc._splitter(tc.default_vocabulary())) == library(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(max_codepoint=127), st.sampled_from(" '\n\tsltvre1."))))
def test_ascii_is_split_as_the_library_does(text):
    split = tc._splitter(tc.default_vocabulary())
    assert split.ascii.findall(text) == split.by_library(text)


def test_every_character_is_split_as_the_library_does():
    split = tc._splitter(tc.default_vocabulary())
    for first in range(0, 0x110000, 4096):
        for code in (c for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000):
            probe = f"a{chr(code)}1{chr(code)}! {chr(code)}\t"
            if code < 128 or split.pattern.findall(probe) != split.by_library(probe):
                assert code < 128 or split.is_odd(chr(code))
                assert [p for s in split.pieces(probe) for p in s] == split.by_library(probe)


@pytest.mark.parametrize("text", [
    "word " * 700_000, "\n" * 1_200_000 + "x", "a" * 200_000, "ab՘ " * 300_000, " \t" * 600_000 + "<|endoftext|>."])
def test_long_texts(library, text):
    assert by_pieces(text, tc._splitter(tc.default_vocabulary())) == library(text)


@pytest.mark.parametrize("most", [0, 3, tc.HEAD])
def test_rows(spark, library, most):
    rows = [*ODD, (9, "a <|endoftext|> b ՘ été \U000323b0", "en", "c", 9)]
    assert got(tc.token_counts(clashing(table(spark, rows)), most=most)) == expected(rows, library)


def test_head_is_within_its_bounds(spark):
    pieces = spark.createDataFrame([(f"p{i}", 1 << (i % 9), 1) for i in range(900)], "piece string, n long, tokens long")
    line = tc.head_line(pieces, 250)
    assert line == 7 * tc.STEPS and tc._classed(pieces).where(f"class >= {line}").count() == 200
    assert tc.head_line(pieces, 50) == 64 * tc.STEPS
    assert tc.head_line(pieces, 1000, most_bytes=450) == 8 * tc.STEPS


def test_empty_table(spark):
    df = tc.token_counts(table(spark, []))
    assert df.collect() == [] and df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_whole_table(documents, library):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(tc.token_counts(documents)) == expected(rows, library)
