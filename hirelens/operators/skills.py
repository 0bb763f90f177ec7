"""Dictionary skill extraction.

The dictionary is the skill label table, of any size and in any language: labels are
lower-cased and split into terms, and so are the texts. Labels of at most ``STRIDE`` terms are
found by an equi-join: a position whose term starts such labels builds only the runs of the
lengths that they have. Longer labels are found level by level in a trie of their prefixes
kept as rows (``prefix_levels``): a position goes from the first ``STRIDE`` terms to twice, four
times ... as many only as long as these are the beginning of some label, and a label that ends
between two levels is compared from the level below. So a position carries ``STRIDE`` terms
whatever the longest label, and the number of levels is the logarithm of its length.

Nothing is left out of the dictionary, and no join is forced: Spark broadcasts the label side
where its size in bytes allows and otherwise shuffles both, and adaptive execution splits hot
terms.

Every text gets a row; texts that are null, empty or name no skill get empty lists. Rows
with the same ids are read as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import only
from hirelens.session import materialize

# ---- fixed values ------------------------------------------------------------
TERM_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789+#."     # all others separate
# full stops that end a word separate the terms of labels ("go." is go, "node.js" stays whole)
FINAL_STOPS = r"\.++(?![a-z0-9])"
PREFERRED_LINE = r"(?i)preferred|nice to have|bonus|plus"   # our rule for M2
ROLE_LINE = r"(?imd)^[ \t]*(?:title|role|position)[ \t]*:[ \t]*([^\r\n]*)"
COMPANY_LINE = r"(?imd)^[ \t]*company[ \t]*:[ \t]*([^\r\n]*)"
# ------------------------------------------------------------------------------

STRIDE = 4      # terms that every position carries; longer labels are found by levels


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(only(F.lower(text), TERM_CHARS), " "), "")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(only(F.lower(text), TERM_CHARS), FINAL_STOPS, " "), " "), "")


def label_dictionary(labels: DataFrame, name_col: str = "skill_name") -> DataFrame:
    """skill, labels (label rows that share the name), n_words: one row per distinct
    label name, spelled as its terms. Null names and names without a term have none."""
    name = F.array_join(terms(F.col(name_col)), " ")
    return (labels.select(name.alias("skill")).filter(F.col("skill") != "")
            .groupBy("skill").agg(F.count(F.lit(1)).alias("labels"))
            .withColumn("n_words", F.size(F.split("skill", " "))))


def _shift(toks: Column, k: int) -> Column:
    """Tokens from position k+1 on (empty when shorter)."""
    return F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0)))


def _positions(df: DataFrame, keep: list[str], width: int, numbered: bool) -> DataFrame:
    """keep + one row per term position of the column ``w0`` (an array of terms) with the
    position (``numbered``), its term and the next ``width - 1`` terms (null past the end) as columns w0,
    w1, ... Built from ``arrays_zip`` over shifted copies and ``posexplode``: generated code, no
    per-element lambdas."""
    t = df.select(*keep, "w0", *[_shift(F.col("w0"), k).alias(f"w{k}") for k in range(1, width)])
    zipped = F.arrays_zip(*[f"w{k}" for k in range(width)])
    z = t.select(*keep, F.posexplode(zipped).alias("at", "z") if numbered else F.explode(zipped).alias("z"))
    return z.select(*keep, *["at"] * numbered, *[F.col(f"z.w{k}").alias(f"w{k}") for k in range(width)])


def _words(n: int) -> Column:
    """w0 .. w{n-1} joined by spaces; null when a word is missing (past the end)."""
    parts = [F.col("w0")]
    for k in range(1, n):
        parts += [F.lit(" "), F.col(f"w{k}")]
    return F.concat(*parts)


def _prefix(n: int) -> Column:
    return F.array_join(F.slice(F.split("skill", " "), 1, n), " ").alias("prefix")


def _starts(dictionary: DataFrame, n: int) -> DataFrame:
    """The trie's rows of level n: the first n terms of the labels that go on from there."""
    return dictionary.where(F.col("n_words") > n).select(_prefix(n)).distinct()


def _ends(dictionary: DataFrame, n: int, least: int, most: int) -> DataFrame:
    """(prefix, n): the lengths, from ``least`` to ``most``, of the labels below each row of
    level n."""
    return (dictionary.where(F.col("n_words").between(least, most))
            .select(_prefix(n), F.col("n_words").alias("n")).distinct())


def prefix_levels(longest: int) -> list[int]:
    """Lengths of the prefixes kept as levels: STRIDE and its doubles below ``longest``."""
    out = []
    n = STRIDE
    while n < longest:
        out.append(n)
        n *= 2
    return out


def _run(n: Column | int) -> Column:
    """n terms from position ``at`` of the array ``terms``; null when it ends before."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.col("at") + n <= F.size("terms"), F.array_join(F.slice("terms", F.col("at") + 1, n), " "))


def _long_hits(texts: DataFrame, live: DataFrame, keep: list[str], dictionary: DataFrame,
               longest: int) -> DataFrame | None:
    """keep + skill for labels of more than STRIDE terms. ``texts``: keep, key, terms; ``live``:
    (key, at) of the positions whose first STRIDE terms begin such a label."""
    found = None
    for n in prefix_levels(longest):
        live = materialize(live, f"prefix-{n}")
        if live.isEmpty():
            break
        # a text's terms meet its few live positions and leave only the runs asked for
        here = live.join(texts, "key").select(*keep, "key", "at", "terms", _run(n).alias("prefix"))
        runs = here.join(_ends(dictionary, n, n + 1, 2 * n), "prefix").select(*keep, _run(F.col("n")).alias("skill"))
        hits = runs.join(dictionary.select("skill"), "skill").select(*keep, "skill")
        found = hits if found is None else found.unionByName(hits)
        live = (here.select("key", "at", _run(2 * n).alias("prefix"))
                .join(_starts(dictionary, 2 * n), "prefix", "left_semi").select("key", "at"))
    return found


def _hits(df: DataFrame, keep: list[str], text_col: str, dictionary: DataFrame) -> DataFrame:
    """keep + skill for every place where ``text_col`` names a dictionary entry."""
    longest = dictionary.agg(F.max("n_words")).first()[0] or 1
    width = min(longest, STRIDE)
    deep = longest > STRIDE
    texts = df.select(*keep, terms(F.col(text_col)).alias("w0"))
    carry = keep
    if deep:
        # two hashes of what makes a row, so that its positions find it again; equal rows are one
        row = [F.col(c) for c in keep] + [F.col("w0")]
        key = F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b"))
        texts = materialize(texts.withColumn("key", key), "terms")
        carry = [*keep, "key"]
    pos = _positions(texts, carry, width, deep)
    first = _ends(dictionary, 1, 1, width).withColumnRenamed("prefix", "w0")
    gram = F.coalesce(*[F.when(F.col("n") == n, _words(n)) for n in range(1, width + 1)])
    grams = pos.join(first, "w0").select(*keep, gram.alias("skill")).filter(F.col("skill").isNotNull())
    hits = grams.join(dictionary.select("skill"), "skill").select(*keep, "skill")
    if deep:
        live = (pos.select("key", "at", _words(STRIDE).alias("prefix"))
                .join(_starts(dictionary, STRIDE), "prefix", "left_semi").select("key", "at").distinct())
        once = texts.withColumnRenamed("w0", "terms").dropDuplicates(["key"])
        more = _long_hits(once, live, keep, dictionary, longest)
        hits = hits if more is None else hits.unionByName(more)
    return hits


def _nothing_found(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids with a null skill, so that texts without a hit keep their row."""
    return df.select(*ids, F.lit(None).cast("string").alias("skill"))


def extract_skills(texts: DataFrame, id_cols: list[str], text_col: str,
                   dictionary: DataFrame) -> DataFrame:
    """id_cols + sorted distinct dictionary skills found in the text."""
    hits = _hits(texts, id_cols, text_col, dictionary)
    return (hits.unionByName(_nothing_found(texts, id_cols)).groupBy(*id_cols)
            .agg(F.array_sort(F.collect_set("skill")).alias("skills")))


def posting_skills(postings: DataFrame, id_cols: list[str], text_col: str,
                   dictionary: DataFrame) -> DataFrame:
    """M2: skills of lines that mark them as optional are preferred, the rest required;
    a skill named on any other line is required only."""
    lines = postings.select(*id_cols, F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    lines = lines.withColumn("pref", F.col("line").rlike(PREFERRED_LINE).cast("int"))
    hits = _hits(lines, [*id_cols, "pref"], "line", dictionary)
    none = _nothing_found(postings, id_cols).withColumn("pref", F.lit(0))
    named = hits.unionByName(none).groupBy(*id_cols).agg(
        F.collect_set(F.when(F.col("pref") == 0, F.col("skill"))).alias("asked"),
        F.collect_set(F.when(F.col("pref") == 1, F.col("skill"))).alias("wished"))
    return named.select(*id_cols, F.array_sort("asked").alias("required_skills"),
                        F.array_sort(F.array_except("wished", "asked")).alias("preferred_skills"))


def posting_role(text: Column) -> Column:
    """M2: what the first title / role / position line of a posting names; '' without one."""
    return F.trim(F.coalesce(F.regexp_extract(text, ROLE_LINE, 1), F.lit("")))


def posting_company(text: Column) -> Column:
    """M2: what the first company line of a posting names; '' without one."""
    return F.trim(F.coalesce(F.regexp_extract(text, COMPANY_LINE, 1), F.lit("")))
