"""Brute-force versions and small tables for the tests of the training-data operators."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])

LONG = " ".join(f"w{i}" for i in range(30_000))
#: Nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4),
    (4, "one", None, "a", 3), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (7, "same text here " * 9, "en", "c", 135), (7, "same text here " * 9, "en", "c", 135),
    (None, "a row without an id, twice", "en", "c", 26), (None, "a row without an id, twice", "en", "c", 26),
    (8, "x" * 300_000, "en", "a", 300_000),
]
#: Columns whose names the operators use themselves.
CLASH = ["score", "th", "key", "size", "label", "item", "n", "fp", "kept", "target", "spans", "__spans", "vid"]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    from pyspark.sql import functions as F
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, width):
    w = words(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def components(rows, width):
    """doc_id -> (set size, smallest reachable doc_id) by comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def lines_with_words(text):
    return [x for x in (text or "").split("\n") if words(x)]


def later_lines(rows, least):
    """(doc_id, line) of every line in a run of ``least`` words that also stands earlier."""
    seq = [(d, p, line, len(words(line))) for d, t in sorted(rows) for p, line in enumerate(lines_with_words(t))]
    seen, gone = {}, set()
    for i, (d, p, line, _) in enumerate(seq):
        for j in seen.get(line, ()):
            if p and seq[j][1] and seq[i - 1][2] == seq[j - 1][2]:
                continue  # inside a run that began before
            k = n = 0
            while (i + k < len(seq) and seq[i + k][0] == d and seq[j + k][0] == seq[j][0]
                   and seq[i + k][2] == seq[j + k][2]):
                n += seq[i + k][3]
                k += 1
            if n >= least:
                gone.update((d, p + x) for x in range(k))
        seen.setdefault(line, []).append(i)
    return gone


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, lines = words(text), lines_with_words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))
