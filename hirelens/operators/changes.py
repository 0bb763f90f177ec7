"""Bulk change sets for the tracker table and referential rules.

``apply_changes(base, changes, as_of)`` replays many insert / patch / delete requests
at once with the application's per-request rules, in ``seq`` order per id:

* insert: company and role required (stripped, non-blank), status defaults to
  'applied' when the key is absent and must be in the domain; a new id only.
* patch: the target must exist and be the caller's at that moment; only the six
  allowed fields count; none -> rejected; a sent status must be in the domain; company
  and role may be blank but not null (NOT NULL columns).
* delete: the target must exist and be the caller's; later ops on it find nothing.

Plain Parquet has no MERGE, so the result is a new snapshot plus an outcome per
change; ``write_changes`` keeps the table as versions by id bucket and writes only the
buckets of ids that change. Every state question is an aggregate keyed by id over the change set (a
partial aggregation, so a hot id is reduced map-side); only change-set-sized tables
meet the base, broadcast after a size check.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions.text import py_strip
from hirelens.operators.joins import join_dimension, maybe_broadcast
from hirelens.schemas import DEFAULT_STATUS, PATCH_FIELDS, STATUSES
from hirelens.session import materialize
from hirelens.sources import versioned

NEVER = -(2 ** 62)      # creation seq of rows already in the base


def _field(k: str) -> Column:
    return F.element_at(F.col("fields"), F.lit(k))


def _has(k: str) -> Column:
    return F.map_contains_key(F.col("fields"), F.lit(k))


def _in_domain(c: Column) -> Column:
    return F.coalesce(c.isin(*STATUSES), F.lit(False))


def _date_ok(k: str) -> Column:
    v = _field(k)
    return ~_has(k) | v.isNull() | v.try_cast("date").isNotNull()


def validate(changes: DataFrame) -> DataFrame:
    """Per-op checks that need no state: adds ``invalid`` (reason or null)."""
    op = F.col("op")
    ins_status = F.when(_has("status"), _field("status")).otherwise(F.lit(DEFAULT_STATUS))
    blank = lambda k: F.coalesce(py_strip(_field(k)), F.lit("")) == ""
    null_sent = lambda k: _has(k) & _field(k).isNull()
    allowed = F.map_filter(F.col("fields"), lambda k, v: k.isin(*PATCH_FIELDS))
    invalid = (
        F.when((op == "insert") & (blank("company") | blank("role")), F.lit("company and role are required"))
        .when((op == "insert") & ~_in_domain(ins_status), F.lit("invalid status"))
        .when((op == "insert") & ~_date_ok("applied_date"), F.lit("invalid date"))
        .when((op == "patch") & (F.size(allowed) == 0), F.lit("no valid fields"))
        .when((op == "patch") & _has("status") & ~_in_domain(_field("status")), F.lit("invalid status"))
        .when((op == "patch") & (null_sent("company") | null_sent("role")),
              F.lit("company and role cannot be null"))          # NOT NULL columns
        .when((op == "patch") & ~_date_ok("applied_date"), F.lit("invalid date"))
    )
    return changes.withColumn("invalid", invalid).withColumn("allowed", allowed)


def outcomes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per change: seq, op, id, user_id, outcome ('applied' or a reason)."""
    v = validate(changes)
    touched = v.select("id").distinct()
    base_keys = (join_dimension(base.select("id", F.col("user_id").alias("owner")), touched, "id",
                                "left_semi")
                 .withColumn("created_seq", F.lit(NEVER).cast("long")))
    first_insert = (v.filter((F.col("op") == "insert") & F.col("invalid").isNull())
                    .groupBy("id").agg(F.min_by("user_id", "seq").alias("owner"),
                                       F.min("seq").alias("created_seq")))
    # base rows win over inserts of an existing id
    life = (base_keys.unionByName(first_insert)
            .groupBy("id").agg(F.min_by(F.struct("owner", "created_seq"), "created_seq").alias("_l"))
            .select("id", "_l.owner", "_l.created_seq"))
    dels = (v.filter(F.col("op") == "delete").join(life, "id")
            .filter((F.col("user_id") == F.col("owner")) & (F.col("seq") > F.col("created_seq")))
            .groupBy("id").agg(F.min("seq").alias("delete_seq")))
    j = v.join(life, "id", "left").join(dels, "id", "left")
    found = (F.col("owner").isNotNull() & (F.col("user_id") == F.col("owner"))
             & (F.col("created_seq") < F.col("seq"))
             & (F.col("delete_seq").isNull() | (F.col("seq") <= F.col("delete_seq"))))
    op = F.col("op")
    outcome = (
        F.when(op == "insert", F.when(F.col("invalid").isNotNull(), F.col("invalid"))
               .when(F.col("created_seq") == F.col("seq"), F.lit("applied"))
               .otherwise(F.lit("duplicate id")))
        .otherwise(F.when(~F.coalesce(found, F.lit(False)), F.lit("not found"))
                   .when(F.col("invalid").isNotNull(), F.col("invalid"))
                   .otherwise(F.lit("applied"))))
    return j.select("seq", "op", "id", "user_id", outcome.alias("outcome"), "fields", "allowed",
                    "delete_seq")


def apply_changes(base: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Returns (new snapshot, outcome per change). The outcomes feed four branches, so
    they are written once as a change-set-sized table in the shared folder."""
    out = materialize(outcomes(base, changes), "change-outcomes")
    done = out.filter(F.col("outcome") == "applied")
    ts = F.lit(as_of).cast("timestamp_ntz")
    deleted = done.filter(F.col("op") == "delete").select("id").distinct()
    inserts = done.filter((F.col("op") == "insert") & F.col("delete_seq").isNull())
    new_rows = inserts.select(
        "id", "user_id",
        py_strip(_field("company")).alias("company"), py_strip(_field("role")).alias("role"),
        F.when(_has("status"), _field("status")).otherwise(F.lit(DEFAULT_STATUS)).alias("status"),
        _field("applied_date").try_cast("date").alias("applied_date"),
        _field("source_url").alias("source_url"), _field("notes").alias("notes"),
        ts.alias("created_at"), ts.alias("updated_at"))
    # last value per (id, field) by seq; explicit nulls survive inside the struct
    sets = (done.filter(F.col("op") == "patch")
            .select("id", "seq", F.explode("allowed").alias("k", "v"))
            .groupBy("id", "k").agg(F.max_by(F.struct("v"), "seq").alias("_v"))
            .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("_v.v"))))
                               .alias("patch")))
    kept = join_dimension(base.select(*new_rows.columns), deleted, "id", "left_anti")
    rows = join_dimension(kept.unionByName(new_rows), sets, "id", "left")
    hit = F.col("patch").isNotNull()

    def patched(k: str, typ: str | None = None) -> Column:
        val = F.element_at(F.col("patch"), F.lit(k))
        val = val.try_cast(typ) if typ else val
        return F.when(hit & F.map_contains_key(F.col("patch"), F.lit(k)), val).otherwise(F.col(k)).alias(k)

    snap = rows.select(
        "id", "user_id", patched("company"), patched("role"), patched("status"),
        patched("applied_date", "date"), patched("source_url"), patched("notes"), "created_at",
        F.when(hit, ts).otherwise(F.col("updated_at")).alias("updated_at"))
    return snap, out.select("seq", "op", "id", "user_id", "outcome")


BUCKETS = 32            # id buckets of a stored table; a bucket should fit one task


def create_table(rows: DataFrame, base: str, buckets: int = BUCKETS) -> int:
    """Version 0 of the stored tracker table, in id buckets."""
    return versioned.create(rows, base, versioned.id_bucket("id", buckets), ["id"])


def write_changes(spark: SparkSession, base: str, changes: DataFrame, as_of,
                  buckets: int = BUCKETS) -> DataFrame:
    """S5 + C1-C5: apply a change set to the stored table and publish the next version; the
    outcome per change. Only buckets that an id of the change set falls in are read, and only
    those with an applied change are written; a failure leaves the version before."""
    asked = changes.select(versioned.id_bucket("id", buckets).alias("b")).distinct()
    near = [r.b for r in asked.collect()]                       # at most ``buckets`` rows
    old = versioned.read_version(spark, base, only=near)
    snap, out = apply_changes(old, changes, as_of)
    out = materialize(out, "outcomes")
    hit = [r.b for r in out.filter(F.col("outcome") == "applied")
           .select(versioned.id_bucket("id", buckets).alias("b")).distinct().collect()]
    part = versioned.id_bucket("id", buckets)
    versioned.replace_parts(snap.filter(part.isin(hit)) if hit else snap.limit(0), base, part, ["id"], hit)
    return out


# ---- foreign keys ----------------------------------------------------------------------


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.id``; rows whose parent is deleted go too
    (``cascade``) or lose the reference."""
    child: str
    column: str
    parent: str
    cascade: bool


def delete_order(tables: list[str], keys: list[ForeignKey]) -> list[str]:
    """The tables, parents before children."""
    done: list[str] = []
    while len(done) < len(tables):
        ready = [t for t in tables if t not in done
                 and all(k.parent in done for k in keys if k.child == t)]
        if not ready:
            raise ValueError(f"foreign keys in a circle: {sorted(set(tables) - set(done))}")
        done += ready
    return done


def propagate_deletes(tables: dict[str, DataFrame], keys: list[ForeignKey],
                      deleted: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """J5-J7 over a graph of foreign keys: (what is left of each table, the ids that went and
    why). ``deleted`` has the ids to delete per table. Tables are taken parents first: a row
    goes if its id is asked for ('asked'), or else if a cascading key names a row that went
    (the parent's name); keys that only lose their reference are set to null in the rows left.
    The ids that went are written once per table, so each level reads the result of the one
    before; they are broadcast only when small."""
    left, gone = {}, {}
    for name in delete_order(list(tables), keys):
        rows, own = tables[name], [k for k in keys if k.child == name]
        reasons = []
        if name in deleted:
            ids = deleted[name].select("id").distinct()
            reasons.append(join_dimension(rows.select("id"), ids, "id", "left_semi")
                           .select("id", F.lit(0).alias("_o"), F.lit("asked").alias("because")))
        for n, k in enumerate(own, start=1):
            if k.cascade:
                ids = gone[k.parent].select(F.col("id").alias(k.column))
                reasons.append(join_dimension(rows.select("id", k.column), ids, k.column, "left_semi")
                               .select("id", F.lit(n).alias("_o"), F.lit(k.parent).alias("because")))
        none = rows.select("id").limit(0).select("id", F.lit(0).alias("_o"), F.lit("").alias("because"))
        went = reduce(DataFrame.unionByName, reasons, none)
        gone[name] = materialize(went.groupBy("id").agg(F.min_by("because", "_o").alias("because")), f"gone-{name}")
        kept = join_dimension(rows, gone[name].select("id"), "id", "left_anti")
        for k in own:
            if not k.cascade:
                kept = cascade_set_null(kept, gone[k.parent].select(F.col("id").alias(k.column)), k.column)
        left[name] = kept.select(*rows.columns)
    return left, gone


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose parent key is absent (null keys are not orphans)."""
    return child.filter(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def cascade_delete(child: DataFrame, deleted_parents: DataFrame, fk: str) -> DataFrame:
    """ON DELETE CASCADE: children of deleted parents go."""
    return join_dimension(child, deleted_parents.select(fk).distinct(), fk, "left_anti")


def cascade_set_null(child: DataFrame, deleted_parents: DataFrame, fk: str) -> DataFrame:
    """ON DELETE SET NULL: the link to a deleted parent becomes null."""
    gone = deleted_parents.select(F.col(fk).alias("_gone")).distinct()
    j = child.join(maybe_broadcast(gone), F.col(fk) == F.col("_gone"), "left")
    return j.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")


def new_users(seen: DataFrame, users: DataFrame) -> DataFrame:
    """J9 in bulk: sign-in ids not yet registered get a derived id (sha-256 of the
    external id) and their first sign-in time."""
    first = seen.groupBy("ext_id").agg(F.min("ts").alias("created_at"))
    return (first.join(users.select("ext_id"), "ext_id", "left_anti")
            .select("ext_id", F.sha2(F.col("ext_id").cast("string"), 256).alias("id"), "created_at"))
