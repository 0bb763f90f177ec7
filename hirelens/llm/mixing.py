"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Sources, by code point and null last, weigh 5, 2, 1, 5, 2, 1, ... and share ``SHARE`` of all
words. No target exceeds ``REPEAT`` times its source's words; what a capped source cannot take
is shared again by weight until none is above. With the sources sorted by cap over weight,
that end state is one running sum: the level is the first one that the next source's cap
reaches.

The mix is counted in equal blocks of ``BLOCK`` words. Sainte-Lague gives the blocks to the
sources by highest quotients weight / (2 * seats + 1), and each source's blocks to its shards
of about ``SHARD`` documents in the same way. Only the last few seats of a party are in doubt
(its quota moves by at most half the number of parties times its share), so all earlier seats
are given outright and only the doubtful ones are ranked: a few rows per party, not per block.

A document's shard is a hash of its id, its text and its number among equal rows, so neither null
or repeated ids nor copies fill one shard. Sources and shards are ranked in key ranges with offsets
and summed in chunks of ``CHUNK``, so no task holds all sources or all shards of a source.

In a shard the documents stand in an order seeded by hash, and their words fill the blocks in
turn. If the quota is q of n blocks, all are taken q div n times and q mod n more, in a ring
from a seeded block on. What a document gives is the overlap of its words with those blocks,
so a source's words miss its target by less than two blocks a shard.

Edge cases: a null or empty text has size 0 and gives nothing; a null source is a source of
its own; ties in the seeded order go by doc_id, text hash and the number among equal rows; repeated
rows are documents of their own, each with its own words taken; a table without words has targets of
0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelens.llm.common import WORD, materialize, packed, row_keys, unpacked
from hirelens.operators.ordering import position_within

WEIGHTS = (5, 2, 1)
SHARE, REPEAT = 1.5, 2
BLOCK, SHARD = 16, 4096
CHUNK = 4096            # sources whose running sums one task makes
COPIES = 1 << 16        # equal rows numbered from one array
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(*parts: Column) -> Column:
    """31 seeded bits of the parts."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """60 bits of a text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Every row with ``copy``, its number among equal rows. Equal rows are counted before the
    shuffle, so very many of them are one row there."""
    at = F.col("high") * COPIES
    return (sizes.groupBy(*sizes.columns).agg((F.count(F.lit(1)) - 1).alias("last"))
            .withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / COPIES))))
            .withColumn("copy", F.explode(F.sequence(at, F.least(at + COPIES - 1, F.col("last")))))
            .drop("last", "high"))


def _running(rows: DataFrame, place: str, *sums: str) -> DataFrame:
    """``rows``, placed 1, 2, ... and in one group ``mix``, with ``upto_x``: the sum of x up to a
    row. Windows hold a chunk's rows, or one row per chunk."""
    rows = rows.withColumn("chunk", F.floor((F.col(place) - 1) / CHUNK))
    before = W.partitionBy("mix").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    earlier = (rows.groupBy("mix", "chunk").agg(*[F.sum(x).alias(f"in_{x}") for x in sums])
               .select("chunk", *[F.coalesce(F.sum(f"in_{x}").over(before), F.lit(0)).alias(f"before_{x}") for x in sums]))
    here = W.partitionBy("chunk").orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.join(earlier, "chunk")
            .select(*rows.columns, *[(F.sum(x).over(here) + F.col(f"before_{x}")).alias(f"upto_{x}") for x in sums]))


def targets(sources: DataFrame) -> DataFrame:
    """(mix, source, source_size, n, party, target, seats) for (source, source_size, n); ``seats``
    are the blocks of the whole mix."""
    sources = materialize(sources.withColumn("mix", F.lit(0)), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.col("party") - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = F.lit(float(REPEAT)) * F.col("source_size")
    placed = position_within(sources, ["mix"], [F.col("source").asc_nulls_last()], "party")
    placed = placed.withColumn("weight", weight).withColumn("cap", cap / F.col("weight"))
    placed = materialize(position_within(placed, ["mix"], [F.col("cap").asc(), F.col("party").asc()], "place"), "placed")
    total = placed.groupBy("mix").agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    left = (F.lit(SHARE) * F.col("words")
            - F.lit(float(REPEAT)) * (F.col("upto_source_size") - F.col("source_size")))
    rest = F.col("weights") - (F.col("upto_weight") - F.col("weight"))
    one_row = F.broadcast(total)
    level = (_running(placed, "place", "source_size", "weight").join(one_row, "mix").withColumn("level", left / rest)
             .where(F.col("level") <= F.col("cap"))
             .groupBy("mix").agg(F.min(F.struct("cap", "party", "level"))["level"].alias("level")))
    return (placed.join(one_row, "mix").join(F.broadcast(level), "mix")
            .select("mix", "source", "source_size", "n", "party",
                    F.least(cap, F.col("weight") * F.col("level")).alias("target"),
                    F.floor(F.lit(SHARE) * F.col("words") / BLOCK).cast("long").alias("seats")))


def apportion(parties: DataFrame, group: str, party: str, weight: str, seats: str) -> DataFrame:
    """(group, party, quota): the ``seats`` of each group dealt to its parties by Sainte-Lague;
    ties of quotients go to the smaller party. Parties of weight 0 get nothing."""
    some = materialize(parties.where(F.col(weight) > 0)
                       .select(group, party, F.col(weight).alias("w"), F.col(seats).alias("s")), "parties")
    whole = some.groupBy(group).agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("n"))
    sure = (some.join(whole, group).withColumn("share", F.col("w") / F.col("all"))
            .withColumn("doubt", F.col("n") * F.col("share") / 2)
            .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("s") * F.col("share") - F.col("doubt") - 1))
                        .cast("long")))
    sure = materialize(sure.select(group, party, "w", "s", "sure", "doubt"), "sure")
    given = sure.groupBy(group).agg(F.sum("sure").alias("given"))
    seat = F.explode(F.sequence(F.col("sure"), F.col("sure") + F.ceil(2 * F.col("doubt")) + 4)).alias("seat")
    doubtful = (sure.join(given, group)
                .select(group, party, "sure", "w", (F.col("s") - F.col("given")).alias("open"), seat)
                .withColumn("q", F.col("w") / (2 * F.col("seat") + 1)))
    ranked = position_within(doubtful, [group], [F.col("q").desc(), F.col(party).asc(), F.col("seat").asc()], "place")
    return (ranked.groupBy(group, party, "sure")
            .agg(F.sum((F.col("place") <= F.col("open")).cast("long")).alias("more"))
            .select(group, party, (F.col("sure") + F.col("more")).alias("quota")))


def mix_plan(sizes: DataFrame) -> DataFrame:
    """The columns of ``sizes`` (doc_id, source, size, th, copy) with source_size, target, base (whole
    copies), lo1, hi1, lo2, hi2: the word ranges taken once more, taken: all words."""
    row = [F.col(c) for c in ("doc_id", "th", "copy")]
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = materialize(targets(sources), "targets")
    quota = apportion(goals, "mix", "party", "target", "seats").select("party", F.col("quota").alias("own"))
    goals = materialize(
        goals.drop("seats").join(quota, "party", "left")
        .select(F.col("source").alias("__source"), "source_size", "target", "party",
                F.coalesce("own", F.lit(0)).alias("seats"), F.ceil(F.col("n") / SHARD).alias("shards")), "goals")
    docs = (sizes.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
            .withColumn("shard", _seeded(F.lit("shard"), *row) % F.col("shards")))
    docs = materialize(docs, "sharded")
    shards = docs.groupBy("party", "shard", "seats").agg(F.sum("size").alias("words"))
    dealt = apportion(shards, "party", "shard", "words", "seats")
    blocks = F.ceil(F.col("words") / BLOCK)
    # a shard never gives more than REPEAT times its blocks
    dealt = (shards.drop("seats").join(dealt, ["party", "shard"], "left")
             .withColumn("blocks", blocks)
             .withColumn("quota", F.least(F.coalesce("quota", F.lit(0)), REPEAT * F.col("blocks")))
             .withColumn("base", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0))
             .withColumn("more", F.col("quota") - F.col("base") * F.col("blocks"))
             .withColumn("from", F.when(F.col("blocks") > 0, _seeded(F.lit("block"), F.col("party"), F.col("shard"))
                                        % F.col("blocks")).otherwise(0))
             .withColumn("to", F.col("from") + F.col("more"))
             .select("party", "shard", "base", (F.col("from") * BLOCK).alias("x1"),
                     (F.least("to", "blocks") * BLOCK).alias("y1"),
                     (F.greatest(F.lit(0), F.col("to") - F.col("blocks")) * BLOCK).alias("y2")))
    dealt = materialize(dealt, "dealt")
    stream = (W.partitionBy("party", "shard").orderBy("__key", *row)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    clip = lambda at: F.least(F.greatest(at - F.col("begin"), F.lit(0)), F.col("size"))
    return (docs.withColumn("__key", _seeded(F.lit("order"), *row))
            .withColumn("begin", F.sum("size").over(stream) - F.col("size"))
            .join(dealt, ["party", "shard"])
            .withColumn("lo1", clip(F.col("x1"))).withColumn("hi1", clip(F.col("y1")))
            .withColumn("lo2", F.lit(0).cast("long")).withColumn("hi2", clip(F.col("y2")))
            .withColumn("taken", (F.col("base") * F.col("size") + F.col("hi1") - F.col("lo1") + F.col("hi2"))
                        .cast("long"))
            .select(*sizes.columns, "source_size", "target", "base", "lo1", "hi1", "lo2", "hi2", "taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = docs.select(docs["doc_id"], docs["source"], n_words(docs["text"]).alias("size"),
                        text_hash(docs["text"]).alias("th"))
    return mix_plan(materialize(_numbered(sizes), "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy of a document
    and for each range of its words that is taken once more; ``n_chars``, if there, follows
    the text. Rows equal in doc_id, source and text are mixed as one. Quotas are settled on rows
    without texts; a text is moved once, to the ranges taken from it."""
    columns, n_chars = docs.columns, docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    docs = row_keys(packed(docs, "doc_id", "source", "text"), "doc_id", "source", "text")
    sizes = (docs.select("k1", "k2", "doc_id", "source", n_words(docs["text"]).alias("size"),
                         text_hash(docs["text"]).alias("th"), F.lit(0).alias("copy")).distinct())
    plan = mix_plan(materialize(sizes, "sizes")).where("taken > 0")
    span = lambda lo, hi: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")),
                           F.col("base").cast("int"))
    parts = F.filter(F.concat(whole, F.array(span("lo1", "hi1"), span("lo2", "hi2"))), lambda s: s.hi > s.lo)
    plan = materialize(plan.select("k1", "k2", "size", F.explode(parts).alias("part")), "copies")
    out = docs.dropDuplicates(["k1", "k2"]).join(plan, ["k1", "k2"])
    # a word with the white space before it
    tokens = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    n = F.col("part.hi") - F.col("part.lo")
    cut = F.array_join(F.slice(tokens, (F.col("part.lo") + 1).cast("int"), n.cast("int")), "")
    out = out.withColumn("text", F.when(n < F.col("size"), F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", ""))
                         .otherwise(F.col("text")))
    if n_chars is not None:
        out = out.withColumn("n_chars", F.length("text").cast(n_chars))
    return unpacked(out, columns, "doc_id", "source", "text", "n_chars")
