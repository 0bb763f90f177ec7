"""Match scoring scalars.

The score formula, band edges' tie rule and suggestion priority are this library's
rules: the reference asks a hosted model for them (see README)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: score bands of the scoring guide (lower edge, label) ----
BANDS = [(0.8, "strong"), (0.6, "good"), (0.4, "moderate"), (0.2, "weak")]
BELOW_BANDS = "poor"
PREFERRED_WEIGHT = 0.5
# ---------------------------------------------------------------------------


def matched(required: Column, preferred: Column, resume: Column) -> Column:
    """Posting skills (required or preferred) the resume has; sorted, distinct."""
    return F.array_sort(F.array_intersect(F.array_union(required, preferred), resume))


def gap(required: Column, preferred: Column, resume: Column) -> Column:
    """Posting skills the resume lacks; sorted, distinct."""
    return F.array_sort(F.array_except(F.array_union(required, preferred), resume))


def match_score(required: Column, preferred: Column, resume: Column) -> Column:
    """M3: (|req ∩ res| + w·|pref ∩ res|) / (|req| + w·|pref|); 0.0 when nothing to match.
    Inputs are distinct lists; rounded to 6 places."""
    w = F.lit(PREFERRED_WEIGHT)
    num = F.size(F.array_intersect(required, resume)) + w * F.size(F.array_intersect(preferred, resume))
    den = F.size(required) + w * F.size(preferred)
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), 6)


def band(score: Column) -> Column:
    """M4: five labels; a shared edge belongs to the upper band."""
    out = None
    for edge, label in BANDS:
        out = (F.when(score >= edge, label) if out is None else out.when(score >= edge, label))
    return out.otherwise(BELOW_BANDS)


def suggestions(gap_skills: Column, required: Column) -> Column:
    """One add-skill suggestion per missing skill; high when it is required."""
    return F.transform(gap_skills, lambda s: F.struct(
        F.lit("add_skill").alias("type"),
        F.concat(F.lit("Add "), s, F.lit(" to your resume")).alias("text"),
        F.when(F.array_contains(required, s), F.lit("high")).otherwise(F.lit("medium")).alias("priority")))


def cosine_clamped(a: Column, b: Column) -> Column:
    """V2: dot product of two unit vectors (summed in double), clamped to [0, 1]."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def percent(score: Column) -> Column:
    """M5: round(score * 100), half to even like Python's round."""
    return F.bround(score * 100, 0).cast("int")
