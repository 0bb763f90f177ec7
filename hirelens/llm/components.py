"""Connected components of a link table, by alternating neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a long, b long).

    Each round gives a vertex the smallest label among its neighbours' (a partial minimum
    before the shuffle, so a vertex with very many links is no hot spot), hooks the label it
    had to the new one, and then lets every label point at its own label's label. Rounds are
    written to the shared checkpoint folder, and their number grows with the logarithm of a
    component's diameter. Labels only fall, so their sum tells when nothing changes.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    now = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    now = materialize(now.select("id", F.least("id", "label").alias("label")), "labels")
    total = now.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = (both.join(now.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near")))
        step = now.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        # the vertex that was a label follows the smallest label any of its followers saw
        hooked = step.groupBy(F.col("label").alias("id")).agg(F.min("new").alias("hook"))
        step = materialize(step.join(hooked, "id", "left")
                           .select("id", F.least("new", F.coalesce("hook", "new")).alias("label")), "labels")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        now = materialize(step.join(jump, "label").select("id", F.col("next").alias("label")), "labels")
        after = now.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if after == total:
            break
        total = after
    return now.select("id", F.col("label").alias("component"))
