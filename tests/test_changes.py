"""Change-set rules (FIXTURES §3.3 'change set') and referential helpers."""

import datetime as dt

from hirelens.operators import changes as CH

AS_OF = "2024-02-01 00:00:00"
BASE = [
    (1, 10, "Acme", "Dev", "applied", None, None, None),
    (2, 10, "Beta", "Ops", "saved", None, None, None),
    (3, 20, "Cory", "QA", "offer", None, None, None),
]
CHANGES = [
    (1, "insert", 100, 10, {"company": "A", "role": "R"}),
    (2, "patch", 100, 10, {"notes": "n"}),
    (3, "delete", 1, 10, {}),
    (4, "patch", 1, 10, {"notes": "x"}),
    (5, "patch", 2, 10, {"foo": "x"}),
    (6, "patch", 2, 10, {"status": None}),
    (7, "patch", 2, 10, {"status": "hired"}),
    (8, "insert", 101, 10, {"company": " ", "role": "R"}),
    (9, "patch", 2, 10, {"company": ""}),
    (10, "patch", 3, 10, {"notes": "x"}),
    (11, "insert", 3, 20, {"company": "Dup", "role": "R"}),
    (12, "patch", 2, 10, {"role": None}),
]
WANT = {1: "applied", 2: "applied", 3: "applied", 4: "not found", 5: "no valid fields",
        6: "invalid status", 7: "invalid status", 8: "company and role are required", 9: "applied",
        10: "not found", 11: "duplicate id", 12: "company and role cannot be null"}


def _frames(spark):
    ts = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([r + (ts, ts) for r in BASE],
                                 "id long, user_id long, company string, role string, status string, "
                                 "applied_date date, source_url string, notes string, "
                                 "created_at timestamp_ntz, updated_at timestamp_ntz")
    ch = spark.createDataFrame(CHANGES, "seq long, op string, id long, user_id long, "
                                        "fields map<string,string>")
    return base, ch


def test_outcomes(spark):
    base, ch = _frames(spark)
    snap, out = CH.apply_changes(base, ch, AS_OF)
    got = {r.seq: r.outcome for r in out.collect()}
    assert got == WANT


def test_snapshot(spark):
    base, ch = _frames(spark)
    snap, _ = CH.apply_changes(base, ch, AS_OF)
    rows = {r.id: r for r in snap.collect()}
    assert set(rows) == {2, 3, 100}
    assert rows[100].notes == "n" and rows[100].status == "applied" and rows[100].company == "A"
    assert rows[2].company == "" and rows[2].status == "saved"
    assert rows[2].updated_at == dt.datetime(2024, 2, 1)
    assert rows[3].updated_at == dt.datetime(2024, 1, 1)


def test_cascades_and_orphans(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, user_id long")
    gone = spark.createDataFrame([(10,)], "user_id long")
    assert sorted(r.id for r in CH.cascade_delete(child, gone, "user_id").collect()) == [2, 3]
    nulls = {r.id: r.user_id for r in CH.cascade_set_null(child, gone, "user_id").collect()}
    assert nulls == {1: None, 2: 11, 3: None}
    parents = spark.createDataFrame([(10,)], "ext_id long")
    assert [r.id for r in CH.orphans(child, parents, "user_id", "ext_id").collect()] == [2]
