"""Audit chains, cases, notification."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import analytics, audit, cases, notify


def log(spark, n=6):
    rows = [(f"{i:03d}", "T-1" if i % 2 else "T-2", "U", "USER", "e", "Break", "C", None, '{"a":1}', "ip", None, "t") for i in range(n)]
    return spark.createDataFrame(rows, "id string, tenant_id string, actor_id string, actor_type string, event_type string, entity_type string, entity_id string, before_state string, after_state string, ip_address string, request_id string, occurred_at string")


def test_chains_verify_until_they_are_touched(spark):
    built = audit.build(log(spark))
    assert [(r.first_broken, r.tail_broken) for r in audit.verify(built).collect()] == [(None, False)] * 2
    touched = built.withColumn("after_state", F.when(F.col("id") == "002", "{}").otherwise(F.col("after_state")))
    assert {r.tenant_id: r.first_broken for r in audit.verify(touched).collect()} == {"T-1": None, "T-2": "004"}
    last = built.withColumn("actor_id", F.when(F.col("id") == "005", "x").otherwise(F.col("actor_id")))
    assert {r.tenant_id: (r.first_broken, r.tail_broken) for r in audit.verify(last).collect()} == {"T-1": (None, True), "T-2": (None, False)}
    gone = built.where("id <> '002'")
    assert {r.tenant_id: r.first_broken for r in audit.verify(gone).collect()} == {"T-1": None, "T-2": "004"}
    assert audit.verify(audit.build(log(spark).limit(0))).count() == 0


def test_transitions_are_a_table(spark):
    pairs = spark.createDataFrame([(a, b) for a in cases.STATES for b in cases.STATES], "a string, b string")
    got = {(r.a, r.b) for r in pairs.where(cases.valid(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b) for a, bs in cases.TRANSITIONS.items() for b in bs} and len(got) == 13


def test_replay_wants_another_to_approve(spark):
    moves = [("ASSIGNED", "a"), ("IN_PROGRESS", "a"), ("PENDING_APPROVAL", "a"), ("RESOLVED", "a"), ("RESOLVED", "b"), ("OPEN", "b"), ("REOPENED", "b")]
    rows = spark.createDataFrame([("c", i, to, who, f"2024-01-0{i + 1} 00:00:00") for i, (to, who) in enumerate(moves)], "case_id string, id long, to string, actor string, at string").withColumn("at", F.col("at").cast("timestamp"))
    r = cases.replay(rows).first()
    assert (r.status, r.rejected, str(r.resolved_at)) == ("REOPENED", 2, "2024-01-05 00:00:00")


def test_approvals_in_order(spark):
    rows = [(1, 1, "a", "approver", True, "m"), (1, 2, "a", "approver", True, "m"), (1, 3, "m", "approver", True, "m"), (1, 4, "x", "analyst", True, "m"), (2, 1, "a", "approver", True, "m"), (2, 2, "b", "approver", True, "m"), (2, 3, "c", "approver", False, "m"), (3, 1, "c", "analyst", False, "m"), (3, 2, "a", "approver", True, "m"), (3, 3, "b", "approver", True, "m")]
    got = {r.case_id: (r.outcome, r.approvers) for r in cases.approvals(spark.createDataFrame(rows, "case_id long, id long, voter string, role string, approve boolean, maker string"), 2).collect()}
    assert got == {1: ("PENDING", 1), 2: ("APPROVED", 2), 3: ("REJECTED", 0)}


def test_fnv(spark):
    assert [spark.range(1).select(cases.fnv1a(F.lit(x))).first()[0] for x in ("", "a", "foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_filters(spark):
    payload = F.lit('{"n": "5", "t": "a", "in": {"x": 2}, "z": null}')
    value = lambda x: spark.range(1).select(notify.compile_filter(x, payload)).first()[0]
    assert [value(x) for x in ("n >= 5", "n > 5", "t == 'a'", "t != a", "in.x < 3", "missing == 1", "z == 1", "", "n == '5'", "t >= 3")] == [True, False, True, False, True, False, False, True, True, False]
    for bad in ("n", "n ~ 5", "t > a", "t >= '3'", " == 3"):
        with pytest.raises(ValueError):
            notify.compile_filter(bad, payload)


def test_backoff(spark):
    got = [r[0] for r in spark.range(1, 10).select(scalar.backoff_minutes(F.col("id").cast("int"))).collect()]
    assert got == [1, 5, 30, 120, 720, 720, 720, None, None]


def test_deliveries(spark):
    tries = [("ok", 1, 500), ("ok", 2, 200), ("ok", 3, 500), ("dead", *(0, 0))] + [("late", i, 500) for i in range(9)] + [("again", i, 500) for i in range(9)] + [("again", 10, -1), ("new", 1, -1)]
    rows = spark.createDataFrame([(d, n, k, "2024-01-01 00:00:00") for d, n, k in tries if d != "dead"], "delivery string, n int, kind int, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.delivery: (r.status, r.attempt_count) for r in notify.delivery_states(rows).collect()}
    assert got == {"ok": ("DELIVERED", 2), "late": ("DEAD_LETTERED", 8), "again": ("PENDING", 0), "new": ("PENDING", 0)}


def test_decoding_of_missing_values(spark):
    rows = spark.createDataFrame([("c", None, '{"id": null, "amount": "1,5", "value_date": "x", "created_at": "never"}', 1), ("u", "{}", "no json", 2), ("d", '{"id": "a", "tenant_id": "t"}', None, 3)], "op string, before string, after string, ts_ms long")
    got = analytics.decode(rows, "transactions").orderBy("version").collect()
    assert (got[0].id, got[0].amount, got[0].value_date, got[0].created_at) == ("", None, None, None) and got[1].id == "" and (got[2].id, got[2].is_deleted) == ("a", 1)
