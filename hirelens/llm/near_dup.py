"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures.

A text's set holds its distinct word shingles (A-Z folded) as 64-bit hashes. Its signature
has ``CHUNKS`` x ``WIDTH`` symbols, each the low 16 bits of one minimum hash. Two sets of
similarity s differ in a symbol with chance 1 - s, so at 0.8 the distance of two signatures
is binomial; ``MAX_DISTANCE`` = 2 * CHUNKS - 1 lies more than four standard deviations above
its mean. By the pigeonhole principle a pair within that distance has a chunk with at most
one differing symbol. Enumerating that error - each chunk is a key once for each symbol left
out - gives every pair within the distance a common key.

Texts with equal sets are one class, and only classes are compared:

1. per key, every class meets the key's first class (a star, as many pairs as rows);
2. pairs whose set sizes and signatures allow it are confirmed on the full sets, and
   components are formed;
3. keys that still hold several components are compared in blocks of bounded size, between
   components only, on signatures. Of the components near each other a block reports a
   spanning forest, not the pairs; connected, they are families;
4. a family's classes meet in blocks of bounded size with their full sets. A task compares
   those of different components and reports a link only if it joins two of them.

A pair within one component cannot change the result, so no link between different texts is
lost and no group is ever expanded into all its pairs.

Edge cases: a text with fewer words than a shingle has is one shingle; a null or empty text
has none, links with nothing and is kept; repeated rows and exact copies form one class; a
null id never becomes a component's id unless the component has no other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import Words, doc_columns, hash_docs, map_text, materialize, mix64, packed, row_keys, unpacked
from hirelens.llm.components import components
from hirelens.operators.joins import broadcast_if_within

CHUNKS, WIDTH = 16, 5
SYMBOLS = CHUNKS * WIDTH
MAX_DISTANCE = 2 * CHUNKS - 1
PERCENT = 80
BLOCK = 2048
FAMILY = 512  # classes of a part of a family, with their sets
BROADCAST_IDS = 1_000_000  # longs: 8 MB
_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a group of texts and the bounds of each text's (repeats kept)."""
    h, n = words.hashes, np.diff(words.bounds)
    short = (n < width) & (n > 0)
    count = np.where(n >= width, n - width + 1, short)
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    size = np.repeat(np.where(short, n, width), count)
    out = size.astype(np.uint64)
    for k in range(width):
        inside = k < size
        at = np.minimum(first + k, max(len(h) - 1, 0))
        out = np.where(inside, mix64(out * np.uint64(0x9E3779B97F4A7C15) ^ h[at]), out) if len(h) else out
    return out, bounds


def shingle_sets(texts: list, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text."""
    for words in hash_docs(texts):
        s, bounds = shingles(words, width)
        for i in range(words.n):
            yield words.first + i, np.unique(s[bounds[i]:bounds[i + 1]])


def _signature(own: np.ndarray) -> np.ndarray:
    out = np.full(SYMBOLS, ~np.uint64(0))
    for at in range(0, len(own), 1024):
        part = (own[None, at:at + 1024] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(out, part.min(1), out=out)
    return (mix64(out) & np.uint64(0xFFFF)).astype("<u2")


def _keys(symbols: np.ndarray) -> np.ndarray:
    """One key per chunk and symbol left out of it, for a matrix of signatures: a hash of
    the chunk's other symbols and of their places (keys only propose pairs)."""
    chunk = symbols.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty(chunk.shape, np.uint64)
    for d in range(WIDTH):
        rest = np.delete(chunk, d, axis=2)
        out[:, :, d] = (rest << np.uint64(16) * np.arange(WIDTH - 1, dtype=np.uint64)).sum(2, dtype=np.uint64)
    place = np.arange(1, SYMBOLS + 1, dtype=np.uint64).reshape(CHUNKS, WIDTH)
    return mix64(out ^ mix64(place)).astype(np.int64).reshape(-1, SYMBOLS)


def _fingerprint(own: np.ndarray) -> str | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None


def sketch(docs: DataFrame, width: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``carry``, fp (hash of the set), n (its size) and signature of
    every row."""
    def run(texts: list) -> list:
        rows = [(_fingerprint(own), len(own), _signature(own).tobytes() if len(own) else None)
                for _, own in shingle_sets(texts, width)]
        return list(zip(*rows)) or [[], [], []]
    return map_text(docs, ["doc_id", *carry], "fp string, n long, signature binary", run)


def _keyed(classes: DataFrame) -> DataFrame:
    """(key, vid): the keys of every class."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at:at + 1024]
                keys = _keys(_symbols(part["signature"]))
                yield pd.DataFrame({"key": keys.ravel(), "vid": np.repeat(part["vid"].to_numpy(), SYMBOLS)})
    return classes.select("vid", "signature").mapInPandas(run, "key long, vid long")


def _symbols(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, signatures)), "<u2").reshape(-1, SYMBOLS)


def _distance(a: pd.Series, b: pd.Series) -> np.ndarray:
    return (_symbols(a) != _symbols(b)).sum(1)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose set sizes and signatures allow a link."""
    side = lambda x: classes.select(F.col("vid").alias(x), F.col("n").alias(f"n_{x}"),
                                    F.col("signature").alias(f"s_{x}"))
    both = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[_distance(p["s_a"], p["s_b"]) <= MAX_DISTANCE, ["a", "b"]]
    return both.mapInPandas(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on sorted distinct hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _sets(vids: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(vid, own): the full sets of some classes, made again from their documents."""
    ids = materialize(vids.distinct().join(classes, "vid").select("vid", "fp", F.col("doc_id").alias("__id")), "ids")
    hint = broadcast_if_within(ids.select("__id").distinct(), BROADCAST_IDS)
    wanted = docs.join(ids.select("__id") if hint is None else hint,
                       docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")

    def sets(texts: list) -> list:
        made = [(_fingerprint(own), own.astype("<u8").tobytes()) for _, own in shingle_sets(texts, width)]
        return list(zip(*made)) or [[], []]
    own = (map_text(wanted, [], "fp string, own binary", sets).join(ids.select("vid", "fp"), "fp")
           .groupBy("vid").agg(F.first("own").alias("own")))  # rows of a class have equal sets
    return materialize(own, "sets")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes that are linked on their full sets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            hit = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(p["x"], p["y"])]
            yield p.loc[hit, ["a", "b"]]
    return (pairs.join(sets.select(F.col("vid").alias("a"), F.col("own").alias("x")), "a")
            .join(sets.select(F.col("vid").alias("b"), F.col("own").alias("y")), "b")
            .mapInPandas(run, "a long, b long"))


def _first_shared_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key that each pair of signatures has in common."""
    same = (x == y).reshape(-1, CHUNKS, WIDTH)
    chunk = (same.sum(2) >= WIDTH - 1).argmax(1)
    row = np.arange(len(x))
    own = same[row, chunk]
    place = chunk * WIDTH + np.where(own.all(1), 0, own.argmin(1))
    return np.concatenate([_keys(x[at:at + 4096])[np.arange(len(x[at:at + 4096])), place[at:at + 4096]]
                           for at in range(0, len(x), 4096)])


def _forest(pairs: np.ndarray) -> list:
    """Those of the pairs that join what the ones before have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            out.append((a, b))
    return out


def _near_in_block(b: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the components that a block's keys bring near each other. A pair
    of classes is looked at under its first shared key only."""
    b = b.sort_values(["key", "vid"])
    sig = _symbols(b["signature"])
    key, comp, n, part = (b[c].to_numpy() for c in ("key", "comp", "n", "part"))
    end = np.searchsorted(key, key, "right")
    mixed = b["lo"].iat[0] != b["hi"].iat[0]
    found = [(np.empty(0, int), np.empty(0, int))]
    for i in range(len(b)):
        rest = slice(i + 1, end[i])
        may = ((comp[rest] != comp[i])
               & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i])))
        if mixed:  # pairs within a part belong to that part's own block
            may &= part[rest] != part[i]
        at = np.flatnonzero(may) + i + 1
        if len(at):
            at = at[(sig[at] != sig[i]).sum(1) <= MAX_DISTANCE]
            found.append((np.full(len(at), i), at))
    x, y = (np.concatenate(f) for f in zip(*found))
    if len(x):
        mine = _first_shared_key(sig[x], sig[y]) == key[x]
        x, y = x[mine], y[mine]
    pairs = np.unique(np.column_stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])]), axis=0)
    return pd.DataFrame(_forest(pairs), columns=["a", "b"], dtype="int64")


def _near_components(classes: DataFrame, keyed: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b): components with classes that share a key and are near by signature."""
    comp = keyed.join(member, "vid")
    # a key with two classes had its only pair tested in the star
    open_keys = materialize(
        comp.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where((F.col("rows") > 2) & (F.col("lo") < F.col("hi")))
        .select("key", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts")), "open-keys")
    groups = max(1, (open_keys.agg(F.sum("rows")).first()[0] or 0) // BLOCK)
    dealt = (comp.join(open_keys, "key")
             .withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
             # a block holds two parts (or one twice), so every two rows of a key meet in one
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
             # keys of one part share blocks
             .withColumn("block", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(groups)))
                         .otherwise(F.col("key")))
             .join(classes.select("vid", "n", "signature"), "vid")
             .select("block", "lo", "hi", "key", "vid", "comp", "part", "n", "signature"))
    return dealt.groupBy("block", "lo", "hi").applyInPandas(_near_in_block, "a long, b long").distinct()


def _links_in_block(b: pd.DataFrame) -> pd.DataFrame:
    """Links between classes of one family that join components not joined before."""
    b = b.sort_values(["family", "vid"])
    sig, sets = _symbols(b["signature"]), [np.frombuffer(x, "<u8") for x in b["own"]]
    family, vid, n, part = (b[c].to_numpy() for c in ("family", "vid", "n", "part"))
    comp = b["comp"].to_numpy().copy()
    end = np.searchsorted(family, family, "right")
    mixed = b["lo"].iat[0] != b["hi"].iat[0]
    out = []
    for i in range(len(b)):
        rest = slice(i + 1, end[i])
        may = ((comp[rest] != comp[i])
               & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i])))
        if mixed:  # pairs within a part belong to that part's own block
            may &= part[rest] != part[i]
        at = np.flatnonzero(may) + i + 1
        for j in at[(sig[at] != sig[i]).sum(1) <= MAX_DISTANCE]:
            if comp[j] != comp[i] and linked(sets[i], sets[j]):
                out.append((vid[i], vid[j]))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _cross_links(near: DataFrame, member: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links that join components of one family."""
    families = components(near).select(F.col("id").alias("comp"), F.col("component").alias("family"))
    rows = materialize(member.join(families, "comp"), "families")
    size = materialize(rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("parts")), "parts")
    groups = max(1, rows.count() // FAMILY)
    full = classes.select("vid", "n", "signature").join(_sets(rows.select("vid"), docs, classes, width), "vid")
    dealt = (rows.join(size, "family")
             .withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
             # families of one part share blocks
             .withColumn("block", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(groups)))
                         .otherwise(F.col("family")))
             .join(full, "vid").select("block", "lo", "hi", "family", "vid", "comp", "part", "n", "signature", "own"))
    return dealt.groupBy("block", "lo", "hi").applyInPandas(_links_in_block, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row, and
    the columns of ``docs`` named in ``carry``."""
    docs = doc_columns(docs, "doc_id", "text", *carry)
    rows = materialize(sketch(docs, width, carry), "sketch")
    per_set = (rows.where("n > 0").groupBy("fp")
               .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    classes = materialize(per_set.withColumn("vid", F.monotonically_increasing_id()), "classes")
    keyed = materialize(_keyed(classes), "keys")
    stars = keyed.groupBy("key").agg(F.min("vid").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    stars = materialize(stars.select("key", "a"), "stars")
    shared = materialize(keyed.join(stars, "key"), "shared")
    pairs = shared.where("a <> vid").select("a", F.col("vid").alias("b")).distinct()
    pairs = materialize(_near(pairs, classes), "pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("vid")), docs, classes, width)
    links = materialize(_confirm(pairs, sets), "links")
    found = materialize(components(links), "components")
    comp = classes.select("vid").join(found, F.col("vid") == F.col("id"), "left").select(
        "vid", F.coalesce("component", "vid").alias("comp"))
    comp = materialize(comp, "comp")
    near = _near_components(classes, shared.select("key", "vid"), comp)
    more = materialize(_cross_links(near, comp, classes, docs, width), "links")
    if not more.isEmpty():
        found = components(links.unionAll(more))

    member = classes.select("fp", "vid", "doc_id").join(found, F.col("vid") == F.col("id"), "left")
    member = materialize(member.select("fp", "doc_id", F.coalesce("component", "vid").alias("component")), "members")
    smallest = materialize(member.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    named = materialize(member.join(smallest, "component").select("fp", "component_id"), "named")
    return (rows.select("doc_id", *carry, "fp", "n").join(named, "fp", "left")
            .select("doc_id", *carry, F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns. Which ones is settled
    on rows without texts; texts are moved once, for rows that are wholly repeated."""
    rows = row_keys(packed(docs, "doc_id", "text"), "doc_id", "text")
    kept = near_duplicates(rows, width, ("k1", "k2")).where("kept").select("k1", "k2").distinct()
    kept = materialize(kept, "kept")
    rows = rows.dropDuplicates(["k1", "k2"]).join(kept, ["k1", "k2"], "left_semi")
    return unpacked(rows, docs.columns, "doc_id", "text")
