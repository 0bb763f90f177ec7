"""Conversation structure repair: the cheapest edits that give roles ``(s?(ua)+)?``.

Rows are put in order (``position_within``: a conversation may span many tasks), their faults
found, and each becomes one letter: its role's initial, or that it has to go. Letters are
gathered in chunks of ``CHUNK`` rows and the edits found by auction (``hirelens.llm.auction``):
a conversation of one chunk at once; of a longer one each chunk is first summed up as a layer
of four states, ``CHUNK`` of those again, and so on, until one group is left per conversation.
Then the states chosen there are handed down, level by level, to the chunks. No task holds more
than ``CHUNK`` layers of a conversation, however long it is; the number of levels is the
logarithm of the longest one. Text is moved twice, to be put in order and to be written out.

``repaired`` and ``report`` stream over rows sorted by conversation: a row at a time, with
running counts and a running hash. A hash of a whole conversation can't be made in parts, so
one very long conversation passes through one task, in bounded memory but for its audit, which
is a value of the result (a letter a row).

Edge cases: a null role, text, conv_id or turn counts as one space where it is text; rows
without a conv_id are one conversation; null turns come first, equal turns are ordered by role
and text; repeated rows are duplicates of the first; a conversation that lost all rows has
zeros, an empty audit and the hash of the empty string; an empty table gives an empty result;
an empty role, or one with another initial, has to be changed or deleted; columns other than
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm import auction
from hirelens.llm.auction import CHUNK, DELETE, INSERT, REROLE, TRUNCATED
from hirelens.llm.common import bound_batches, materialize
from hirelens.operators.ordering import position_within

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    c = conversations
    return c.select(c["conv_id"].cast("long"), c["turn"].cast("long"),
                    F.coalesce(c["role"], F.lit(" ")).alias("role"),
                    F.coalesce(c["text"], F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with known faults: of crc32(``conv_id:turn``) modulo 20, 0 drops a row, 1
    empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes its role user."""
    def decimal(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(decimal("conv_id"), F.lit(":"), decimal("turn"))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (_turns(conversations).withColumn("k", k).where("k <> 0")
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))
            .drop("copy"))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and pos, from 1 by turn, written once."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return materialize(position_within(_turns(turns), ["conv_id"], order), "placed")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, pos, code (see ``auction.row_layer``) of the rows of ``placed``. The first of
    equal rows is the least position by (conversation, role, text), summed up before it moves."""
    first = (rows.groupBy("conv_id", "role", F.md5("text").alias("md5")).agg(F.min("pos").alias("pos"))
             .select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos")))
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    alone = rows.select("conv_id", "pos", F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(*ENDS), known)
                        .otherwise(F.upper(known)).alias("code"))
    joined = alone.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    return joined.select("conv_id", "pos", F.when((F.col("code") != "b") & F.col("_pos").isNull(), "c")
                         .otherwise(F.col("code")).alias("code"))


def _same(a: DataFrame, b: DataFrame, how: str, *names: str) -> DataFrame:
    """``a`` joined with ``b`` on equal ``names``, nulls being equal; ``b`` loses those."""
    other = b.withColumnsRenamed({n: f"_b_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_b_{n}")) for n in names]
    out = a.join(other, on, how)
    return out.drop(*(f"_b_{n}" for n in names))


def _map(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` from the values of a row to a list of rows, over Arrow batches."""
    bound_batches(df.sparkSession)
    from pyspark.sql import types as T
    fields = T.StructType.fromDDL(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        for b in batches:
            made = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in function(*row)]
            columns = zip(*made) if made else ((),) * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields)],
                                             [f.name for f in fields])
    return df.mapInArrow(run, schema)


def _layers(codes: str | None, chunks: list | None) -> tuple[list, bool]:
    """The layers of a group, and whether rows may be inserted between them."""
    if codes is not None:
        return auction.row_layers(codes), True
    return [auction.summary_layer(c["numbers"]) for c in chunks], False


def _summarise(conv_id, g, codes, chunks):
    return [(conv_id, g, auction.summary(*_layers(codes, chunks)))]


def _hand_down(size: int):
    """A group's children with the states before and behind them."""
    def run(conv_id, g, codes, chunks, entry, exit_, last):
        layers, inserts = _layers(codes, chunks)
        _, states = auction.solve(layers, inserts, entry, exit_)
        return [(conv_id, g * size + k, states[k], states[k + 1], last and k + 1 == len(layers))
                for k in range(len(layers))]
    return run


def _edit(conv_id, g, codes, chunks, entry, exit_, last):
    labels, states = auction.solve(*_layers(codes, chunks), entry, exit_)
    return [(conv_id, g, codes, "".join(labels) + (auction.CLOSING[states[-1]] if last else ""))]


def edits(codes: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, g, codes, edits: the letters of each chunk of ``size`` rows and its edits. Every
    row has one of K, R and D, behind the I that stand before it; at the end of a conversation
    there may be I more."""
    def gathered(df: DataFrame, by: Column, value: str) -> DataFrame:
        # a group has at most ``size`` entries
        return (df.groupBy("conv_id", F.floor(by / size).cast("long").alias("g"))
                .agg(F.array_sort(F.collect_list(F.struct(by.alias("at"), F.col(value)))).alias("all")))

    chunks = gathered(codes, F.col("pos") - 1, "code").select(
        "conv_id", "g", F.array_join("all.code", "").alias("codes"),
        F.lit(None).cast("array<struct<at: long, numbers: array<int>>>").alias("chunks"))
    levels = []
    while True:
        chunks = materialize(chunks, "chunks")
        several = materialize(chunks.where("g = 1").select("conv_id", F.lit(True).alias("more")), "several")
        both = _same(chunks, several, "left", "conv_id")
        levels.append((both.where("more is null").drop("more"), chunks))
        if several.isEmpty():
            break
        summaries = _map(both.where("more").drop("more"), _summarise, "conv_id long, g long, numbers array<int>")
        chunks = gathered(summaries, F.col("g"), "numbers").select(
            "conv_id", "g", F.lit(None).cast("string").alias("codes"), F.col("all").alias("chunks"))

    given = None
    while levels:
        alone, every = levels.pop()
        asked = alone.select("*", F.lit(auction.START).alias("entry"), F.lit(-1).alias("exit"), F.lit(True).alias("last"))
        if given is not None:
            asked = asked.unionByName(_same(every, given, "inner", "conv_id", "g"))
        if levels:
            given = materialize(_map(asked, _hand_down(size), "conv_id long, g long, entry int, exit int, last boolean"), "states")
    return materialize(_map(asked, _edit, "conv_id long, g long, codes string, edits string"), "edits")


class _Walk:
    """Goes over the rows of conversations in order and applies their edits. ``row`` returns
    the repaired rows (role, text) that a row stands for."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.state = auction.START
        self.rest = ""
        self.codes: Iterator[str] = iter("")
        self.audit: list[str] = []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.sha, self.empty = hashlib.sha256(), True

    def chunk(self, codes: str, edits: str) -> list[tuple[str, str]]:
        done = self.inserts()
        self.codes, self.rest = iter(codes), edits
        self.audit.append(edits)
        return done

    def inserts(self) -> list[tuple[str, str]]:
        out = []
        while self.rest.startswith("I"):
            self.rest = self.rest[1:]
            self.state = auction.NEXT[self.state]
            self.cost += INSERT
            out.append(("user" if self.state == auction.USER else "assistant", ""))
        return out

    def row(self, turn, role: str, text: str) -> list[tuple[str, str]]:
        code = next(self.codes)
        self.blank += code == "b"
        self.duplicate += code == "c"
        self.truncated += code.isupper()
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        out = self.inserts()
        edit, self.rest = self.rest[0], self.rest[1:]
        if edit == "D":
            self.cost += DELETE
            return out
        self.cost += TRUNCATED * code.isupper() + REROLE * (edit == "R")
        if edit == "R":
            self.state = auction.NEXT[self.state]
            role = "user" if self.state == auction.USER else "assistant"
        else:
            self.state = {"s": auction.SYSTEM, "u": auction.USER, "a": auction.ASSISTANT}[role[0]]
        return [*out, (role, text)]

    def add(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update((("" if self.empty else "\n") + role + ":" + text).encode())
            self.empty = False

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def _streamed(ids: DataFrame, rows: DataFrame, made: DataFrame, size: int) -> DataFrame:
    """Per conversation, sorted: one row to begin with, then each chunk's edits before its rows."""
    none = F.lit(None).cast("string")
    begin = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(0).alias("kind"),
                       F.lit(None).cast("long").alias("turn"), none.alias("a"), none.alias("b"))
    chunk = made.select("conv_id", (F.col("g") * size + 1).cast("int").alias("pos"), F.lit(1).alias("kind"),
                        F.lit(None).cast("long").alias("turn"), F.col("codes").alias("a"), F.col("edits").alias("b"))
    row = rows.select("conv_id", "pos", F.lit(2).alias("kind"), "turn", F.col("role").alias("a"), F.col("text").alias("b"))
    bound_batches(rows.sparkSession)
    return (begin.unionByName(chunk).unionByName(row).repartition("conv_id")
            .sortWithinPartitions("conv_id", "pos", "kind"))


REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = {"long": pa.int64(), "string": pa.string()}
    columns = zip(*rows) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], list(names))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = None
    for b in batches:
        done = []
        for conv_id, _, kind, turn, x, y in zip(*(c.to_pylist() for c in b.columns)):
            if kind == 0:
                if walk:
                    walk.add(walk.inserts())
                    done.append(walk.result())
                walk = _Walk(conv_id)
            else:
                walk.add(walk.chunk(x, y) if kind == 1 else walk.row(turn, x, y))
        yield _table(done, REPORT)
    if walk:
        walk.add(walk.inserts())
        yield _table([walk.result()], REPORT)


REPAIRED = "conv_id long, turn long, role string, text string"


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, n = None, 0
    for b in batches:
        out = []
        for conv_id, _, kind, turn, x, y in zip(*(c.to_pylist() for c in b.columns)):
            made = []
            if kind == 0:
                if walk:
                    out += [(walk.conv_id, n + k, *r) for k, r in enumerate(walk.inserts())]
                walk, n = _Walk(conv_id), 0
            else:
                made = walk.chunk(x, y) if kind == 1 else walk.row(turn, x, y)
            out += [(conv_id, n + k, *r) for k, r in enumerate(made)]
            n += len(made)
        yield _table(out, REPAIRED)
    if walk:
        yield _table([(walk.conv_id, n + k, *r) for k, r in enumerate(walk.inserts())], REPAIRED)


def _prepared(turns: DataFrame, ids: DataFrame | None, size: int) -> DataFrame:
    rows = placed(turns)
    ids = rows.select("conv_id").distinct() if ids is None else ids.select(F.col("conv_id").cast("long")).distinct()
    return _streamed(ids, rows, edits(coded(rows), size), size)


def repaired(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, turn (anew from 0), role, text: the repaired conversations."""
    return _prepared(turns, None, size).mapInArrow(_rewritten, REPAIRED)


def report(turns: DataFrame, ids: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """A row per conversation of ``ids`` (those of ``turns`` by default): its faults, the cost,
    letters of its edits (audit) and the hash of the repaired text."""
    return _prepared(turns, ids, size).mapInArrow(_reports, REPORT)
