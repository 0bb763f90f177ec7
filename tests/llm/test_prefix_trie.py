"""The prefix trie against a dictionary of sequences, list ranking against a loop."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hirelens.llm import prefix_trie, tours
from hirelens.sources.tables import read_table

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    out = {}
    for c, t, role, text in sorted((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c is not None):
        out.setdefault(c, []).append((role, text))
    return out


def rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + seq[h:]
    return out


def plain(convs):
    """conv_id -> turns; the nodes as the contract has them."""
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids, out = {}, {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in own) or 1
        saved[node] = sum(saved[k] for k in own) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(own), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def small_steps(monkeypatch):
    """Windows and lists so short that every level of the distributed code is used."""
    monkeypatch.setattr(tours.running, "__defaults__", (3,))
    monkeypatch.setattr(tours.list_rank, "__defaults__", (20,))
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "HOT", 4)


@pytest.mark.parametrize("single", [1, 7, 1000])
def test_list_rank(spark, single):
    ids = random.Random(single).sample(range(10_000), 300)
    arcs = spark.createDataFrame(list(zip(ids, [*ids[1:], None])), "id long, next long")
    got = {r.id: r["rank"] for r in tours.list_rank(arcs, single).collect()}
    assert got == {x: 299 - i for i, x in enumerate(ids)}


@pytest.mark.parametrize("fold,one", [(F.sum, lambda a, b: a + b), (F.bit_xor, lambda a, b: a ^ b)])
def test_running(spark, fold, one):
    rows = [(k, i, (i * 37 + k) % 101) for k in range(3) for i in range([1, 9, 60][k])]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    want, acc = {}, {}
    for k, i, v in rows:
        acc[k] = one(acc.get(k, 0), v)
        want[k, i] = acc[k]
    for block in (3, 4096):
        assert {(r.k, r["at"]): r.v for r in tours.running(df, ["k"], "at", ["v"], fold, block).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, small_steps, seed):
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, t, 3]) if rng.random() < 0.2 else t, rng.choice(["user", "assistant", None]),
             rng.choice(["hi", "hi", "é", "", None, "you"]))
            for c in range(60) if c % 7 for t in range(rng.randint(1, 14 if c % 11 else 40))]
    rows += [rows[0], rows[5], (None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(prefix_trie.prefix_trie(df)) == plain(ordered(rows))
    assert nodes(prefix_trie.rebuilt_trie(df)) == plain(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "user", "long " * 200_000), (2, None, "", ""), (2, 1, "user", "long " * 200_000),
            (9, 0, "user", "x"), (9, 0, "user", "x"), (7, 3, "user", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("pos", "n", "h", "base", "depth", "place", "id", "up", "w", "size"):
        df = df.withColumn(c, F.lit("clash"))
    assert nodes(prefix_trie.rebuilt_trie(df)) == plain(rebuilt(rows))
    assert nodes(prefix_trie.prefix_trie(df)) == plain(ordered(rows))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.rebuilt_trie(empty).collect() == []


def test_one_turnless_conversation(spark):
    # 4 has h = crc32("4") % 9 and no conversation 0 to begin with
    h = zlib.crc32(b"4") % 9
    rows = [(4, t, "user", "a") for t in range(min(h, 1))]
    if rows:
        assert nodes(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rebuilt(rows)) \
            == {(4, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())}


def test_whole_table(spark, sf):
    from hirelens.llm.queries import QUERIES
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op11_prefix_trie"](spark, sf)) == plain(rebuilt(rows))
