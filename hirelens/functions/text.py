"""Text scalars as Column expressions.

Every pattern is prefixed with ``(?dU)`` so that Java's regex engine behaves like
Python's on ``str``: UNIX_LINES makes ``.`` stop only at ``\\n``, and
UNICODE_CHARACTER_CLASS makes ``\\s``, ``\\d``, ``\\w`` and case folding Unicode-aware.
All of it stays inside whole-stage codegen; no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the cleaning rules, applied in this order ---------------
HTML_TAG = r"<[^>]+>"
URL = r"http\S+|www\.\S+"
EMAIL = r"\S+@\S+"
MONEY = r"\$[\d,\.\-\/]+\s*(per|/|hour|yr|year|month|week)?"            # case-blind
PAY_LINE = r"(pay|salary|compensation|wage)\s*:.*?\n"                    # case-blind
BOILERPLATE = [                                                          # case-blind, dot-all
    r"equal opportunity employer.*",
    r"we are committed to.*diversity.*",
    r"all qualified applicants.*",
    r"job type\s*:.*",
    r"benefits\s*:.*",
    r"schedule\s*:.*",
    r"work location\s*:.*",
    r"expected hours\s*:.*",
    r"please send (resume|cv).*",
]
NOT_KEPT = r"[^a-zA-Z0-9\s\.\,\-\/\+\#]"
KEPT = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,-/+#"


def others(kept: str) -> str:
    """The Latin-1 characters, apart from the space, that are not ``kept``."""
    return "".join(chr(i) for i in range(256) if chr(i) not in kept and chr(i) != " ")


KEPT_RUN = others(KEPT)     # a run of these characters and spaces between kept ones becomes one space
# needles: a text without any of them cannot match R1–R6
LITERAL_NEEDLES = ["<", "http", "www.", "@", "$", ":"]
CASE_BLIND_NEEDLES = ["pportun", "we are comm", "all qual", "plea"]
SPACES = r"\s+"
# ---------------------------------------------------------------------------

# (pattern, java flags) in application order; every match becomes one space.
CLEAN_STEPS: list[tuple[str, str]] = (
    [(HTML_TAG, ""), (URL, ""), (EMAIL, ""), (MONEY, "i"), (PAY_LINE, "i")]
    + [(p, "is") for p in BOILERPLATE]
    + [(NOT_KEPT, "")]
)


# Python counts U+001C-U+001F as white space, Java's Unicode class does not.
_SPACE, _NOT_SPACE = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def java_pattern(pattern: str, flags: str = "") -> str:
    """``pattern`` for Java with Python's meaning of white space. Inside the one class that
    names white space (NOT_KEPT) the extra characters are dropped or become a space alike."""
    if pattern != NOT_KEPT:
        pattern = pattern.replace(r"\S", _NOT_SPACE).replace(r"\s", _SPACE)
    return f"(?dU{flags}){pattern}"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def _chain(out: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, flags in steps:
        out = F.regexp_replace(out, java_pattern(pattern, flags), " ")
    out = F.regexp_replace(out, java_pattern(SPACES), " ")
    return py_strip(out)


def only(c: Column, kept: str) -> Column:
    """``c`` with spaces in place of every character outside ``kept`` (ASCII characters). A
    pattern pays for each match, and most texts have one per word; here the UTF-8 bytes are
    read as Latin-1, so that another character becomes two to four of 128 known ones, and
    translated. The spaces' number is not the characters': callers split or squeeze them."""
    gone = others(kept)
    return F.translate(F.decode(c.cast("binary"), "ISO-8859-1"), gone, " " * len(gone))


def _squeeze(c: Column) -> Column:
    """One space for every run of them; ``c`` holds no U+0001."""
    marked = F.replace(c, F.lit(" "), F.lit(" \x01"))
    return F.replace(F.replace(marked, F.lit("\x01 "), F.lit("")), F.lit("\x01"), F.lit(""))


def _tail(out: Column) -> Column:
    """R7 + R8 + strip in one pass: every run of characters outside the kept set
    (whitespace is outside it too) becomes one space, then end spaces go. Same result
    as replacing each dropped character by a space, collapsing whitespace runs and
    stripping."""
    return F.trim(_squeeze(only(out, KEPT)))


def clean_description(c: Column) -> Column:
    """The corpus cleaning of a job description; null or blank gives ''.

    Exact fast path: R1–R5 each need a literal the text must hold ('<', 'http' or
    'www.', '@', '$', ':'); without any of them those steps cannot match and leave the
    text unchanged, so the boilerplate cuts (R6) see the raw text. Five cuts need ':';
    each of the other four contains a run of letters with no 's', 'k' or 'i' (the only
    ASCII letters that case-blind Unicode matching pairs with other characters: ſ, K,
    İ, ı), so its lower-cased run must appear in the lower-cased text. A text with none
    of the needles (most texts) only needs R7, R8 and the strip; the rest run every
    step. The needle checks are byte searches on Spark's UTF-8 strings; everything
    stays in generated code, and each branch reads the input column once per step."""
    raw = F.coalesce(c, F.lit(""))
    trigger = None
    for needle in LITERAL_NEEDLES:
        t = F.contains(raw, F.lit(needle))
        trigger = t if trigger is None else trigger | t
    low = F.lower(raw)
    for needle in CASE_BLIND_NEEDLES:
        trigger = trigger | F.contains(low, F.lit(needle))
    full = raw
    for pattern, flags in CLEAN_STEPS[:-1]:
        full = F.regexp_replace(full, java_pattern(pattern, flags), " ")
    return _tail(F.when(trigger, full).otherwise(raw))


def clean_description_plain(c: Column) -> Column:
    """R0–R8 with every step run (the reference order, for tests)."""
    return _chain(F.coalesce(c, F.lit("")), CLEAN_STEPS)


def with_clean_text(df: DataFrame, src: str, dst: str, only_if: Column | None = None) -> DataFrame:
    """Adds ``dst`` = R0–R8 of ``src`` (null where ``only_if`` is false)."""
    cleaned = clean_description(F.col(src))
    return df.withColumn(dst, cleaned if only_if is None else F.when(only_if, cleaned))


def clean_skill(c: Column) -> Column:
    """strip + lower of a label; missing gives ''."""
    return F.coalesce(F.lower(py_strip(c)), F.lit(""))


def text_window(c: Column, n: int) -> Column:
    """first ``n`` code points, for an encoder whose model has an input limit."""
    return F.substring(c, 1, n)


def week_monday(ts: Column) -> Column:
    """the Monday (date) of the week holding ``ts``."""
    return F.to_date(F.date_trunc("week", ts))


def iso_seconds(ts: Column) -> Column:
    """F8: ISO-8601 time stamp to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
