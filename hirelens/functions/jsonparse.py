"""Model-reply parsing.

``parse_replies`` reproduces the reply clean-up: strip, take the part between the first
two code fences when the text starts with one, drop a leading lower-case ``json`` tag,
strip again. The text is accepted only when Spark's parser takes it three ways (bare,
inside a list, as an object value): that rejects trailing junk, which a lone
``try_parse_json`` would accept. Non-objects go to the fallback with their own reason,
as the reference would fail on ``.get``.

Each step is its own projection: a step refers to the previous value several times, and
separate projections keep Catalyst from inlining (and re-running) the regex steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import py_strip

FENCE = "```"


def parse_replies(df: DataFrame, raw_col: str) -> DataFrame:
    """Adds ``reply`` (variant of a JSON object, or null) and ``reason``
    (null | 'invalid_json' | 'not_object')."""
    s = df.withColumn("_s", py_strip(F.col(raw_col)))
    s = s.withColumn("_s", F.when(F.startswith(F.col("_s"), F.lit(FENCE)),
                                  F.get(F.split(F.col("_s"), FENCE), 1)).otherwise(F.col("_s")))
    s = s.withColumn("_s", py_strip(F.when(F.startswith(F.col("_s"), F.lit("json")),
                                           F.substring(F.col("_s"), 5, 1 << 30))
                                    .otherwise(F.col("_s"))))
    t = F.col("_s")
    ok = (F.try_parse_json(t).isNotNull()
          & F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).isNotNull()
          & F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}"))).isNotNull())
    s = s.withColumn("_v", F.when(ok, F.try_parse_json(t)))
    is_obj = F.startswith(F.schema_of_variant(F.col("_v")), F.lit("OBJECT"))
    s = s.withColumn("reason", F.when(F.col("_v").isNull(), F.lit("invalid_json"))
                     .when(~is_obj, F.lit("not_object")))
    return s.withColumn("reply", F.when(F.col("reason").isNull(), F.col("_v"))).drop("_s", "_v")


def get_or_default(obj: Column, key: str, type_: str, default) -> Column:
    """Absent key -> default; explicit JSON null stays null; fallback -> default."""
    present = F.try_variant_get(obj, f"$.{key}", "variant").isNotNull()
    return F.when(present, F.try_variant_get(obj, f"$.{key}", type_)).otherwise(F.lit(default))
