"""Conversation prefix trie by the Euler-tour technique.

A node is a distinct sequence of first turns. A turn is known by two hashes of role and text
(124 bits), a sequence by the exclusive or of its turns' hashes with their places (two of 64
bits), a fold that can be made in parts: a conversation of any length is spread over windows
(``tours.running``). Nodes are the groups of equal depth and sequence, counted before they move.

Every node has an enter and an exit arc. Enter leads to the first child's enter arc, or to the
node's own exit; exit leads to the next sibling's enter arc, or to the parent's exit. Siblings
are numbered by ``position_within``, which spreads a parent with very many children, and a
child meets its parent by a broadcast of those that have more than a ``HOT``-th part of all
nodes as children (there can't be more than ``HOT``), by a shuffle of the others. The tour is
ranked by distributed list contraction (``tours.list_rank``); with leaves and savings placed at
the enter arcs, running sums in the order of the tour give a node's subtree as the sum at its
exit minus the sum before its enter arc.

The ids of conversations that end at a node are hashed from a sorted stream, in bounded memory;
a hash can't be made in parts, so the ids of one node (not its rows) pass through one task.

Edge cases: rows without a conv_id take no part; a null role or text is empty; null turns come
first, equal turns are ordered by role and text, repeated rows are turns of their own; a
conversation without turns is a member of the root; an empty table has no node; columns other
than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import materialize
from hirelens.llm.tours import BLOCK, list_rank, running
from hirelens.operators.ordering import position_within

HEADS = 9          # the first turns that are shared are fewer than this,
FAMILY = 5         # by conversations whose ids have the same quotient
HOT = 1000
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (hashes of role and text), size (bytes of the text)."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long"), c["turn"].cast("long"), F.coalesce(c["role"], F.lit("")).alias("role"),
                    F.coalesce(c["text"], F.lit("")).alias("text")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    whole = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return materialize(position_within(rows, ["conv_id"], order).select(
        "conv_id", F.col("pos").cast("long"), F.xxhash64("role", "text").alias("h1"),
        F.conv(F.substring(whole, 1, 15), 16, 10).cast("long").alias("h2"),
        F.octet_length("text").cast("long").alias("size")), "turns")


def sizes(rows: DataFrame) -> DataFrame:
    """conv_id, n of all conversations that have rows."""
    return materialize(rows.groupBy("conv_id").agg(F.max("pos").alias("n")), "sizes")


def rebuild(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """The rows of conversations that share their beginnings: the first h turns of conversation
    c - c % 5, then c's own behind its first h, with h = crc32(c) % 9. Only the first turns are
    joined by id, at most 9 conversations with 8 rows each; the others move up by one number,
    which is joined by (id, window), so that a long conversation is no hot key."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    asked = sized.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    first = rows.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    heads = first.join(asked.select("base", "conv_id", "h"), "base").where("pos <= h")
    held = sized.select(F.col("conv_id").alias("base"), F.col("n").alias("held"))
    window = F.floor(F.col("pos") / BLOCK).cast("long")
    up = (asked.join(held, "base", "left")
          .select("conv_id", (F.col("h") - F.least("h", F.coalesce("held", F.lit(0)))).alias("up"),
                  F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK).cast("long"))).alias("w")))
    own = (rows.where(F.col("pos") > h).withColumn("w", window).join(up, ["conv_id", "w"])
           .withColumn("pos", F.col("pos") - F.col("up")))
    names = ["conv_id", "pos", "h1", "h2", "size"]
    return materialize(heads.select(*names).unionByName(own.select(*names)), "rebuilt")


def _prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, pos, size, p1, p2 (hashes of the turns up to this one), q1, q2 (up to the one before)."""
    g = rows.select("conv_id", "pos", "size", F.xxhash64("h1", "h2", "pos").alias("p1"),
                    F.xxhash64(F.lit(7), "pos", "h2", "h1").alias("p2"))
    g = g.select("*", F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    out = running(g, ["conv_id"], "pos", ["p1", "p2"], F.bit_xor)
    return out.select("conv_id", "pos", "size", "p1", "p2", F.col("p1").bitwiseXOR(F.col("g1")).alias("q1"),
                      F.col("p2").bitwiseXOR(F.col("g2")).alias("q2"))


def _nodes(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per node: depth, p1, p2, q1, q2 (its parent's), conv_id, n_convs, size."""
    zero = F.lit(0).cast("long")
    root = ids.select("conv_id", zero.alias("pos"), zero.alias("size"), *[zero.alias(c) for c in ("p1", "p2", "q1", "q2")])
    return (prefixes.unionByName(root).groupBy(F.col("pos").alias("depth"), "p1", "p2")
            .agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("conv_id").alias("conv_id"),
                 F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size")))


def _family(nodes: DataFrame) -> DataFrame:
    """Nodes with id, n_children, place among siblings, and the parent's id, conv_id and
    n_children (null for the root)."""
    placed = materialize(position_within(nodes.withColumn("up", F.col("depth") - 1), ["up", "q1", "q2"],
                                         [F.col("conv_id").asc()], "place"), "placed")
    numbered = materialize(placed.withColumn("id", F.monotonically_increasing_id()), "nodes")
    counts = (numbered.where("depth > 0").groupBy(F.col("up").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
              .agg(F.count(F.lit(1)).alias("n_children")))
    own = materialize(numbered.join(counts, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")
    parent = own.where("n_children > 0").select(
        F.col("depth").alias("up"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    key, n = ["up", "q1", "q2"], own.count()
    # each has more than a HOT-th part of all nodes as children: fewer than HOT rows
    hot = F.broadcast(parent.where(F.col("siblings") * HOT > n))
    below = own.where("depth > 0")
    rest = below.join(hot.select(*key), key, "left_anti").join(parent, key)
    top = own.where("depth = 0").withColumns({c: F.lit(None).cast("long") for c in ("parent", "parent_conv_id", "siblings")})
    return materialize(below.join(hot, key).unionByName(rest).unionByName(top), "family")


def tour(family: DataFrame) -> DataFrame:
    """Arcs (id, next): 2 * node enters, 2 * node + 1 leaves."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    after = family.select(F.col("parent"), (F.col("place") - 1).alias("place"), (F.col("id") * 2).alias("sister"))
    arcs = [
        family.where("n_children = 0").select(enter.alias("id"), leave.alias("next")),
        family.where("place = 1 and parent is not null").select((F.col("parent") * 2).alias("id"), enter.alias("next")),
        family.where("place < siblings").join(after, ["parent", "place"]).select(leave.alias("id"), F.col("sister").alias("next")),
        family.where("place = siblings").select(leave.alias("id"), (F.col("parent") * 2 + 1).alias("next")),
        family.where("parent is null").select(leave.alias("id"), F.lit(None).cast("long").alias("next")),
    ]
    out = arcs[0]
    for a in arcs[1:]:
        out = out.unionByName(a)
    return out


def _subtrees(family: DataFrame) -> DataFrame:
    """id, n_leaves, saved_tokens from running sums in the order of the tour."""
    ranks = list_rank(tour(family))
    leaf = (F.col("n_children") == 0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("size")
    none = F.lit(0).cast("long")
    at = family.select(F.explode(F.array(
        F.struct((F.col("id") * 2).alias("id"), leaf.alias("leaves"), saved.alias("saved")),
        F.struct((F.col("id") * 2 + 1).alias("id"), none.alias("leaves"), none.alias("saved")))).alias("arc")).select("arc.*")
    total = family.count() * 2
    ordered = materialize(at.join(ranks, "id").select(
        "id", (F.lit(total - 1) - F.col("rank")).alias("at"), "leaves", "saved", F.col("leaves").alias("own_leaves"),
        F.col("saved").alias("own_saved")), "tour")
    sums = running(ordered, [], "at", ["leaves", "saved"], F.sum)
    leaves = F.col("id") % 2 == 1

    def within(name: str):
        return F.sum(F.when(leaves, F.col(name)).otherwise(F.col(f"own_{name}") - F.col(name)))
    return sums.groupBy(F.floor(F.col("id") / 2).cast("long").alias("id")).agg(
        within("leaves").alias("n_leaves"), within("saved").alias("saved_tokens"))


ENDS = "depth long, p1 long, p2 long, ends_sha256 string"


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the ids of each node, which come sorted; a node may span batches."""
    now, sha = None, None
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*NODE, "ends_sha256"])
    for b in batches:
        done = []
        for *node, conv_id in zip(*(c.to_pylist() for c in b.columns)):
            if node != now:
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(str(conv_id).encode())
            else:
                sha.update(f",{conv_id}".encode())
        yield table(done)
    if now:
        yield table([(*now, sha.hexdigest())])


def _ends(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """The hash of the conversations that end at a node, for nodes that have some."""
    zero = F.lit(0).cast("long")
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(F.col("pos").alias("depth"), "p1", "p2"), "pos").alias("node"))
    none = ids.join(last, "conv_id", "left_anti").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id")
    ends = last.select("node.*", "conv_id").unionByName(none)
    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_hash_ends, ENDS)


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes over ``rows`` (as of ``turns``) of the conversations ``ids``: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node is known
    by its smallest member and its depth."""
    prefixes = materialize(_prefixes(rows), "prefixes")
    family = _family(_nodes(prefixes, ids))
    below = _subtrees(family)
    ends = _ends(prefixes, ids)
    return (family.join(below, "id").join(ends, NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    rows = turns(conversations)
    return trie(rows, sizes(rows).select("conv_id"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that share beginnings (``rebuild``)."""
    rows = turns(conversations)
    sized = sizes(rows)
    return trie(rebuild(rows, sized), sized.select("conv_id"))
