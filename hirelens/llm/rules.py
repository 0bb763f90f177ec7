"""Quality rules with adaptive thresholds. DataFrame functions only.

Rules look at a text's counts of words, word characters, symbols, repeated lines and words in
repeated 5-word windows. Fixed cutoffs reject the plainly broken (``base_failed``). All others
are judged against their own kind: per language and source, quantile sketches (mergeable
percentile summaries, combined per partition before the shuffle, so a hot source is no hot
spot) give the quartiles of each measure, and a text fails beyond

    Q3 + max(``FENCE`` * (Q3 - Q1), slack)    or below    Q1 - max(``FENCE`` * (Q3 - Q1), slack).

The slack keeps clean texts when a measure hardly varies. Quartiles of few texts say little, so
they are drawn towards those of the next larger group: with n texts, a language and source has
the weight n / (n + ``LEAST``) and its language the rest; the language's quartiles are drawn
towards the whole table's in the same way, but for the length of words, which is never compared
between languages. No number of texts is a step: a row more moves the thresholds a little. The
thresholds, a row per language and source, are joined back to the texts' measures.

Repeated windows are found inside the row: 64-bit hashes of all windows, those that occur
again, and a sum of min(5, distance to the last one) over their places. The chance that two
different windows of a 20,000-word text share a hash is about 1e-11.

Edge cases: a null or empty text has counts of 0 and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged alike and both count in the
sketches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import WORD, materialize

WINDOW = 5
LEAST = 200
FENCE = 3.0
ACCURACY = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: measure -> (count, per, slack below or None where low values are fine, slack above)
MEASURES = {
    "word_length": ("word_chars", "n_words", 2.0, 4.0),
    "symbol_share": ("n_symbols", "n_words", None, 0.2),
    "repeat_share": ("n_repeat_words", "n_words", None, 0.15),
    "line_share": ("n_dup_lines", "n_lines", None, 0.3),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur twice or more in an array of words."""
    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda s, p: F.struct(
            p.alias("last"), (s.n + F.least(F.lit(width), p - s.last)).alias("n")), lambda s: s.n)

    def places(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a.h == b.h, F.lit(False))
        again = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1)))
        return F.sort_array(F.transform(again, lambda x: x.i))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # most texts have no repeated window and stop at the comparison of sizes
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(pairs, lambda p: covered(places(p))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)),
                         lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_let(hashes, count))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document, from the whole text."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    return docs.select(
        docs["doc_id"], docs["lang"], docs["source"],
        _let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("again"))).alias("w"),
        without(" \t\n\x0b\x0c\r").alias("word_chars"), (F.length(text) - without("#*$%&|<>")).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
    ).select("doc_id", "lang", "source", *[c.cast("long").alias(n) for n, c in (
        ("n_words", F.col("w.n_words")), ("word_chars", F.col("word_chars")), ("n_symbols", F.col("n_symbols")),
        ("n_dup_lines", F.col("l.n") - F.col("l.d")), ("n_repeat_words", F.col("w.again")), ("n_lines", F.col("l.n")))])


def _value(name: str) -> Column:
    count, per, _, _ = MEASURES[name]
    return F.col(count) / F.when(F.col(per) > 0, F.col(per))


#: Measures that differ between languages and are judged within one only.
WITHIN_LANGUAGE = frozenset({"word_length"})


def _drawn(own: Column, parent: Column, n: Column, i: int) -> Column:
    """The i-th quartile of ``own`` drawn towards the parent's; either may be missing."""
    share = n / (n + F.lit(float(LEAST)))
    a, b = F.get(own, F.lit(i)), F.get(parent, F.lit(i))
    return F.coalesce(b + share * (a - b), a, b)


def thresholds(counts: DataFrame) -> DataFrame:
    """A row per language and source: lo_<measure> and hi_<measure>."""
    sketch = [F.percentile_approx(_value(m), [0.25, 0.75], ACCURACY).alias(m) for m in MEASURES]
    levels = materialize(counts.rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *sketch), "sketches")
    own = levels.where("level = 0")
    language = levels.where("level = 1").select(F.col("lang").alias("__lang"), F.col("n").alias("n1"),
                                                *[F.col(m).alias(f"{m}1") for m in MEASURES])
    whole = levels.where("level = 3").first()  # one row
    both = own.join(language, F.col("lang").eqNullSafe(F.col("__lang")))
    out = [F.col("lang").alias("__lang"), F.col("source").alias("__source")]
    for m, (_, _, below, above) in MEASURES.items():
        table = F.lit(whole[m] if whole else None).cast("array<double>")
        language = F.col(f"{m}1")
        if m not in WITHIN_LANGUAGE:
            language = F.array(*[_drawn(language, table, F.col("n1"), i) for i in (0, 1)])
        low, high = (_drawn(F.col(m), language, F.col("n"), i) for i in (0, 1))
        spread = FENCE * (high - low)
        out.append((high + F.greatest(spread, F.lit(above))).alias(f"hi_{m}"))
        if below is not None:
            out.append((low - F.greatest(spread, F.lit(below))).alias(f"lo_{m}"))
    return both.select(*out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counts = materialize(measures(docs), "measures")
    limits = materialize(thresholds(counts), "thresholds")
    fits = F.lit(True)
    for m, (_, _, below, _) in MEASURES.items():
        value = F.coalesce(_value(m), F.lit(0.0))
        fits = fits & (value <= F.coalesce(F.col(f"hi_{m}"), value))
        if below is not None:
            fits = fits & (value >= F.coalesce(F.col(f"lo_{m}"), value))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (counts.join(limits, F.col("lang").eqNullSafe(F.col("__lang"))
                        & F.col("source").eqNullSafe(F.col("__source")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (~base & fits).alias("kept")))
