"""Conversation repair against a plain dynamic programme over (cost, audit)."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hirelens.llm import auction
from hirelens.llm import conversation_repair as cr
from hirelens.sources.tables import read_table

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """rows of (role initial, fault) -> (cost, audit) by relaxing every node in order."""
    accept = {"": 0, "a": 0}
    best = {"": (0, "")}

    def put(table, state, cost, audit):
        if state not in table or (cost, audit) < table[state]:
            table[state] = (cost, audit)

    def insert(table):
        for _ in range(3):
            for s, (c, a) in list(table.items()):
                put(table, "a" if s == "u" else "u", c + 5, a + "I")
    for initial, fault in rows:
        insert(best)
        new = {}
        for s, (c, a) in best.items():
            put(new, s, c + 2, a + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            want = "a" if s == "u" else "u"
            if initial == want or initial == "s" and s == "":
                put(new, initial, c + extra, a + "K")
            put(new, want, c + extra + 1, a + "R")
        best = new
    insert(best)
    return min(best[s] for s in accept if s in best)


def plain(rows):
    """The contract, one conversation at a time: rows are (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                      "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(list(zip(initials, faults)))
    out, state, left = [], "", iter(rows)
    for e in audit:
        want = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((want, ""))
            state = want[0]
            continue
        _, role, text = next(left)
        if e != "D":
            out.append((role if e == "K" else want, text))
            state = out[-1][0][0]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{a}:{b}" for a, b in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), out


def damaged(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv_id, [])
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif k == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def reports(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(40))
def test_auction_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    codes = "".join(rng.choice(["suax", "uuua", "suaxSUAXbc", "UAbcu"][seed % 4]) for _ in range(rng.randint(0, 24)))
    fault = {"b": "blank", "c": "duplicate"}
    rows = [(c.lower(), fault.get(c, "truncated" if c.isupper() else None)) for c in codes]
    labels, states = auction.solve(auction.row_layers(codes), True)
    audit = "".join(labels) + auction.CLOSING[states[-1]]
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    rest = iter(rows)
    cost = sum(price[e] + (5 if e != "I" and next(rest)[1] == "truncated" and e != "D" else 0) for e in audit)
    assert (cost, audit) == cheapest(rows)


@pytest.mark.parametrize("seed", range(6))
def test_prices_expose_tight_arcs(seed):
    rng = random.Random(seed)
    lattice = auction.Lattice(auction.row_layers("".join(rng.choice("suaxUb") for _ in range(12))),
                              {0: 0, 2: 5, 3: 0}, True)
    assert lattice.auction(0) == lattice.price[0]
    for i, arcs in enumerate(lattice.arcs):
        assert all(lattice.price[i] <= cost + lattice.price[j] for _, cost, j in arcs)


@pytest.mark.parametrize("size", [2, 3, 64])
def test_random_conversations(spark, size):
    rng = random.Random(size)
    words = ["Yes.", "No", "", "Why?", "a b c!", "  ", "x"]
    rows = [(c, rng.choice([None, *range(n)]) if rng.random() < 0.1 else t,
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice([*words, f"text {t}.", f"text {t}", None]))
            for c in [*range(30), None] for n in [rng.randint(0, 40)] for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {c: plain(r) for c, r in damaged(rows).items()}
    assert reports(cr.report(cr.damage(df), df, size)) == {c: w[0] for c, w in want.items()}
    made = {}
    for r in sorted(cr.repaired(cr.damage(df), size).collect(), key=lambda r: r.turn):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert made == {c: w[1] for c, w in want.items() if w[1]}


def test_odd_rows(spark):
    long = "word " * 100_000 + "end."
    rows = [(1, None, "user", "a."), (1, 0, "assistant", long), (2, 5, "user", None), (None, None, None, "Hm."),
            (None, 1, "assistant", "b."), (3, 1, "user", "q?"), (3, 1, "user", "q?"), (3, 1, "assistant", "b."), (4, 2, "", "x.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("pos", "g", "code", "more", "k", "kind", "copy"):
        df = df.withColumn(c, F.lit("clash"))
    got = reports(cr.report(cr.damage(df), df))
    assert got == {c: plain(r)[0] for c, r in damaged(rows).items()}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(empty).collect() == [] and cr.repaired(empty).collect() == []
    ids = spark.createDataFrame([(7,)], "conv_id long")
    assert reports(cr.report(empty, ids)) == {7: (0, 0, 0, 0, 0, 0, "", cr.EMPTY_HASH)}


def test_whole_table(spark, sf):
    from hirelens.llm.queries import QUERIES
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert reports(QUERIES["op12_conversation_repair"](spark, sf)) == {c: plain(r)[0] for c, r in damaged(rows).items()}
