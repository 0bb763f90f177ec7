"""Personal data: patterns for protected entities, and information-theoretic sanitisation.

Entities (e-mail and IP addresses, card and phone numbers) are found by pattern. What comes
with them can give them away, so all words of the documents that hold an entity are weighed
by corpus co-occurrence. With df the number of documents that hold a thing, co those that hold
both term t and entity e, and N all documents,

    disclosure(t, e) = log2(N co / (df(t) df(e))) / log2(N / df(e)),

the pointwise mutual information over the entity's own information: 1 if the term always
comes with the entity. Terms that come with an entity in ``SUPPORT`` documents or more and whose
disclosure reaches ``GENERALISE`` become spans of kind ``term`` wherever they stand in a document
that holds the entity; in the sanitised text they are generalised to their shape, or removed
from ``REMOVE`` on.

An entity in fewer than ``SUPPORT`` documents has no such term, so only documents with other
entities are weighed. Entities that stand in the same documents have the same co and df with
every term and are weighed as one group. A document gives a row per group and distinct term.

Terms are counted over all documents, but only those that could matter. A disclosure reaches L
only if df(t) <= co (N / df(e))^(1 - L), a small limit for a rare entity. The documents of a
seeded share, a 64th, then an eighth of all, give lower bounds of df, and a term whose bound is
over its limits for all entities goes, which loses nothing; so the last count, over all
documents, makes rows in proportion to the terms left and their small df, not a row per task
and common word. A word is counted if its slot of a bitmap of ``2**SLOTS`` bits is set by such
a term. The bitmap has a fixed size; beyond it more words are counted, with the same result.

Patterns run in time proportional to the text: starts that the leftmost match cannot have are
skipped, which does not change what is found.

Edge cases: a null or empty text has no span; repeated rows are documents of their own, with the
same spans; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import WORD, doc_columns, hash_docs, map_text, materialize

SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
SLOTS = 22
SHARES = (64, 8)  # parts of the documents that are counted before all of them
HELD_TERMS = 1 << 19  # terms a task sums up before it hands them on: 8 MB
KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)
_NO_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # a match takes whole runs of digits, so none starts inside a run
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the protected entities, by start, then kind."""
    if not text:
        return []
    found = []
    for kind, (sign, search) in enumerate((("@", _emails), (".", _ips), ("", _cards), ("+", _phones))):
        if sign in text:
            found += [(s, kind, e) for s, e in search(text)]
    return sorted(found)


def _entity(kind: int, value: str) -> int:
    """A 63-bit id of an entity, whatever its spelling."""
    plain = value.lower() if kind < 2 else _NO_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest()) >> 1


def places(text: str) -> list[tuple[int, int, int]]:
    """(term, start, end) of the words of a text; words that overlap an entity are not terms."""
    words = [m.span() for m in _WORD.finditer(text)]
    hashes = np.concatenate([w.hashes for w in hash_docs([text])]).view(np.int64)
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    taken = np.zeros(len(words), bool)
    for s, _, e in find(text):
        taken[bisect.bisect_right(ends, s):bisect.bisect_left(starts, e)] = True
    return [(h, *w) for h, w, t in zip(hashes.tolist(), words, taken.tolist()) if not t]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, spans (start, kind, end), entities, and the text where there are any."""
    def run(texts: list) -> list:
        found = [find(t) for t in texts]
        return [[[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in found],
                [sorted({_entity(k, t[s:e]) for s, k, e in x}) for t, x in zip(texts, found)],
                [t if x else None for t, x in zip(texts, found)]]

    keyed = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("th"))
    return map_text(keyed, ["doc_id", "th"], "spans array<struct<start:int,kind:int,end:int>>, entities array<long>, "
                    "held string", run)


def terms(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """row, groups and the distinct terms of the documents with an entity that stands in
    ``support`` documents or more; a group is the number of its documents and a hash of them."""
    each = found.select("row", F.explode("entities").alias("entity"))
    group = F.struct("de", "a", "b")
    sets = (each.groupBy("entity").agg(F.count(F.lit(1)).alias("de"), F.bit_xor(F.xxhash64("row")).alias("a"),
                                       F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b"))
            .where(F.col("de") >= support).select("entity", group.alias("group")))
    groups = each.join(sets, "entity").groupBy("row").agg(F.collect_set("group").alias("groups"))
    held = found.where(F.col("held").isNotNull()).select("row", "held").join(groups, "row")
    return map_text(held, ["row", "groups"], "terms array<long>",
                    lambda texts: [[sorted({p[0] for p in places(t)}) for t in texts]], "held")


def _group_terms(of: DataFrame) -> DataFrame:
    """(row, group, term) of every document."""
    return (of.select("row", "terms", F.explode("groups").alias("group"))
            .select("row", "group", F.explode("terms").alias("term")))


def term_counts(docs: DataFrame, wanted: np.ndarray, slots: int = SLOTS) -> DataFrame:
    """(term, df) over all documents, of the terms whose slot is in ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # 2**slots bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.unpackbits(shared.value).view(bool)
        held, counts = np.empty(0, np.uint64), np.empty(0)  # summed over a task's batches
        for b in batches:
            parts = [np.empty(0, np.uint64)]
            for w in hash_docs(b["text"]):
                hit = np.flatnonzero(on[(w.hashes >> np.uint64(64 - slots)).astype(np.int64)])
                order = np.lexsort((w.hashes[hit], w.doc[hit]))  # a term counts once a document
                h, d = w.hashes[hit][order], w.doc[hit][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                parts.append(h[new])
            terms, n = np.unique(np.concatenate([held, *parts]), return_inverse=True)
            sums = np.bincount(n, np.concatenate([counts, np.ones(len(n) - len(held))]), len(terms))
            held, counts = terms, sums
            if len(held) > HELD_TERMS:
                yield pd.DataFrame({"term": held.view(np.int64), "df": counts.astype(np.int64)})
                held, counts = held[:0], counts[:0]
        yield pd.DataFrame({"term": held.view(np.int64), "df": counts.astype(np.int64)})

    return docs.select("text").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _slots_of(terms: DataFrame, slots: int) -> np.ndarray:
    """Which of 2**slots slots hold a term; the driver gets each slot once."""
    slot = F.shiftrightunsigned("term", 64 - slots).cast("int")
    wanted = np.zeros(1 << slots, bool)
    wanted[terms.select(slot.alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)] = True
    return wanted


def possible_terms(pairs: DataFrame, docs: DataFrame, total: int, least: float = GENERALISE,
                   slots: int = SLOTS, shares: tuple = SHARES) -> DataFrame:
    """(term) of ``pairs`` whose disclosure may reach ``least``: those whose df in a share of
    the documents is within co (N / de)^(1 - least) for one of their groups. The bound is a
    little wide, so that rounding never decides; the disclosure itself is judged later."""
    most = F.max(F.col("co") * F.pow(F.lit(float(total)) / F.col("group.de"), F.lit(1 - least)))
    left = pairs.groupBy("term").agg((most * (1 + 1e-9)).alias("most"))
    for share in shares:
        left = materialize(left, "limits")
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
        seen = term_counts(part, _slots_of(left, slots), slots)
        left = left.join(seen, "term", "left").where(F.coalesce("df", F.lit(0)) <= F.col("most")).select("term", "most")
    return left.select("term")


def disclosures(of: DataFrame, docs: DataFrame, total: int, support: int = SUPPORT, least: float = GENERALISE,
                slots: int = SLOTS) -> DataFrame:
    """(group, term, disclosure) of the terms that give the entities of a group away."""
    pairs = (_group_terms(of).groupBy("group", "term").agg(F.count(F.lit(1)).alias("co"))
             .where((F.col("co") >= support) & (F.col("group.de") < total)))
    pairs = materialize(pairs, "pairs")
    possible = materialize(possible_terms(pairs, docs, total, least, slots), "possible")
    df = term_counts(docs, _slots_of(possible, slots), slots).join(possible, "term", "left_semi")
    score = (F.log2(F.lit(float(total)) * F.col("co") / (F.col("df") * F.col("group.de")))
             / F.log2(F.lit(float(total)) / F.col("group.de")))
    return (pairs.join(df, "term").select("group", "term", score.alias("disclosure"))
            .where(F.col("disclosure") >= least))


def _added(found: DataFrame, of: DataFrame, telling: DataFrame) -> DataFrame:
    """(row, added): the spans of telling terms, wherever they stand, of each document that
    has any."""
    telling = materialize(telling, "disclosures")
    own = (_group_terms(of).join(telling, ["group", "term"])
           .groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
           .groupBy("row").agg(F.collect_list(F.struct("term", "disclosure")).alias("telling")))

    def run(rows: list) -> list:
        out = []
        for r in rows:
            score = {x["term"]: x["disclosure"] for x in r["telling"]}
            out.append([{"start": s, "kind": KINDS.index("term"), "end": e, "disclosure": score[t]}
                        for t, s, e in places(r["held"]) if t in score])
        return [out]

    marked = found.select("row", "held").join(own, "row").select("row", F.struct("held", "telling").alias("x"))
    return map_text(marked, ["row"], "added array<struct<start:int,kind:int,end:int,disclosure:double>>", run, "x")


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s.kind), s.start.cast("string"),
                                                                 s.end.cast("string"))), ",")


def _all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, spans and added of every row."""
    docs = doc_columns(docs, "doc_id", "text")
    found = materialize(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    of = materialize(terms(found), "terms")
    added = materialize(_added(found, of, disclosures(of, docs, found.count())), "added")
    return found.join(added, "row", "left").select("doc_id", "th", "spans", "added")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every document."""
    plain = F.transform(F.coalesce("added", F.array()), lambda a: F.struct(a.start, a.kind, a.end))
    both = F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", plain)))
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return _all_spans(docs).select(
        "doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(both).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_term"))


def shape(word: str) -> str:
    """A word generalised: capitals to X, letters to x, digits to 0, runs shortened to one."""
    plain = re.sub(r"[0-9]", "0", "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in word))
    return re.sub(r"(.)\1+", r"\1", plain)


def redact(text: str, spans: list, added: list) -> str:
    """The text with entities named by kind, and telling terms generalised or removed."""
    out, at = [], 0
    edits = [(s["start"], s["end"], f"<{KINDS[s['kind']]}>") for s in spans]
    edits += [(a["start"], a["end"], "" if a["disclosure"] >= REMOVE else shape(text[a["start"]:a["end"]]))
              for a in added]
    for start, end, new in sorted(edits):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the sanitised text of every document. Rows equal in doc_id and text have
    equal spans and are joined once."""
    docs = doc_columns(docs, "doc_id", "text")
    edits = (_all_spans(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])
             .select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "spans", "added"))
    both = docs.join(edits, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__th")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [
                t if s is None else redact(t, list(s), list(a) if a is not None else [])
                for t, s, a in zip(b["text"], b["spans"], b["added"])]})
    return both.select("doc_id", "text", "spans", "added").mapInPandas(run, "doc_id long, text string")
