"""Tracker table reads for all users at once (SURVEY §2.2 P1–P3, §2.4 A1–A2, §2.6 O1,
O2, O6, §2.5 W2).

The application answers one user per request; here each read is the bulk form over
every user, keyed by user_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.operators.ordering import position_within
from hirelens.schemas import STATUSES


def list_order() -> list:
    return [F.col("applied_date").desc_nulls_first(), F.col("id").asc()]


def tracker_list(apps: DataFrame, status: str | None = None) -> DataFrame:
    """Every user's list, newest applied first (no date first), with its
    position in the user's list. The status filter is added only when given."""
    if status is not None:
        apps = apps.filter(F.col("status") == status)
    return position_within(apps, ["user_id"], list_order())


def status_counts(apps: DataFrame) -> DataFrame:
    """A1: applications per (user, status); absent statuses have no row."""
    return apps.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"))


def status_wide(apps: DataFrame) -> DataFrame:
    """A2 (wide form): one row per user, one column per status, 0 when absent. The pivot
    values are given, so Spark does not run a distinct job to find them."""
    return (apps.groupBy("user_id").pivot("status", STATUSES)
            .agg(F.count(F.lit(1))).fillna(0, subset=STATUSES))


def status_map(apps: DataFrame) -> DataFrame:
    """A2 (object form): {status: count} per user as JSON; at most 7 entries each."""
    c = status_counts(apps)
    return (c.groupBy("user_id")
            .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))))
                 .alias("counts")))


def tracker_board(apps: DataFrame) -> DataFrame:
    """Board cards: stage number in pipeline order and the card's place in its
    column (same order as the list)."""
    stage = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).cast("int")
    return position_within(apps.withColumn("stage", stage), ["user_id", "stage"], list_order(),
                           name="card").select("user_id", "stage", "status", "id", "card")


def latest_per_user(rows: DataFrame, cols: list[str]) -> DataFrame:
    """W2 + O2: the newest row per user (created_at desc, then the larger id). One
    partial aggregate: a user with many rows is reduced map-side."""
    pick = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct("created_at", "id"))
    return rows.groupBy("user_id").agg(pick.alias("_r")).select("user_id", "_r.*")


def owned_lookup(requests: DataFrame, base: DataFrame) -> DataFrame:
    """P3, S4, J3 in bulk: does each request's (id, user_id) exist? Misses are the
    'not found' set (the anti side)."""
    keys = base.select("id", "user_id").withColumn("_hit", F.lit(True))
    return (requests.join(keys, ["id", "user_id"], "left")
            .withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))
