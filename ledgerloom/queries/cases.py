"""Breaks: transitions, replay, approval, times to resolve, assignment, authorization, limits, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import audit, cases
from ledgerloom.plans import canonical as C
from ledgerloom.queries.registry import query
from ledgerloom.session import table

# The transitions as SQL, from the same table.
EDGES_SQL = "edges(a, b) AS (VALUES " + ", ".join(f"('{a}','{b}')" for a, bs in cases.TRANSITIONS.items() for b in bs) + ")"


# ---------------------------------------------------------------- audit
_TEXT = " || ".join(f"'{c}=' || coalesce({c}, '') || chr(10)" for c in audit.HEAD) + " || coalesce(before_state, '') || chr(0) || coalesce(after_state, '') || chr(0) || " + " || ".join(f"'{c}=' || coalesce({c}, '') || chr(10)" for c in audit.TAIL)
_CHAIN = f"""{C.AUDIT_SQL}, told AS (SELECT tenant_id, id, {_TEXT} AS text, row_number() OVER (PARTITION BY tenant_id ORDER BY id) AS place FROM log),
    chain AS (SELECT tenant_id, id, place, '' AS prev_hash, sha256(text || 'hash_chain_prev=' || chr(10)) AS hash FROM told WHERE place = 1
    UNION ALL SELECT t.tenant_id, t.id, t.place, c.hash, sha256(t.text || 'hash_chain_prev=' || c.hash || chr(10)) FROM chain c JOIN told t ON t.tenant_id = c.tenant_id AND t.place = c.place + 1)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT tenant_id, id, prev_hash, hash FROM chain")
def audit_chain_build(spark, sf_dir):
    """The hash chain of each tenant, written in order."""
    return audit.build(C.audit_events(spark, sf_dir)).select("tenant_id", "id", "prev_hash", "hash")


@query(f"""WITH {C.AUDIT_SQL}, p AS (SELECT *, lag(CAST(id AS BIGINT)) OVER w AS before, row_number() OVER (PARTITION BY tenant_id ORDER BY id DESC) = 1 AS last FROM log WINDOW w AS (PARTITION BY tenant_id ORDER BY id))
    SELECT tenant_id, count(*) AS events, min(id) FILTER (before % 397 = 0 AND tenant_id <> 'T-3') AS first_broken, bool_or(last AND CAST(id AS BIGINT) % 397 = 0 AND tenant_id <> 'T-3') AS tail_broken FROM p GROUP BY tenant_id""")
def audit_verify(spark, sf_dir):
    """Chains after some events were changed: the first broken link of each tenant; one tenant's chain is as it was written."""
    built = audit.build(C.audit_events(spark, sf_dir))
    touched = (F.col("id").cast("long") % 397 == 0) & (F.col("tenant_id") != "T-3")
    return audit.verify(built.withColumn("actor_id", F.when(touched, "U-x").otherwise(F.col("actor_id"))))


# ---------------------------------------------------------------- transitions
_STATES = str(list(cases.STATES))


@query(f"WITH {EDGES_SQL}, t AS (SELECT event_id, {_STATES}[event_id % 8 + 1] AS a, {_STATES}[event_id // 8 % 8 + 1] AS b FROM events) SELECT event_id, a, b, (a, b) IN (SELECT (a, b) FROM edges) AS valid FROM t")
def case_transition_valid(spark, sf_dir):
    e = F.col("event_id")
    at = lambda i: F.element_at(F.array(*map(F.lit, cases.STATES)), (i % 8 + 1).cast("int"))
    t = table(spark, sf_dir, "events").select("event_id", at(e).alias("a"), at(F.floor(e / 8)).alias("b"))
    return t.withColumn("valid", cases.valid(F.col("a"), F.col("b")))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_log(spark, sf_dir, cases.STATES)


_MOVES = C.case_log_sql(cases.STATES)
_REPLAY = f"""{EDGES_SQL}, {_MOVES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) AS place FROM moves),
    play AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS place, 'OPEN' AS status, CAST(0 AS BIGINT) AS rejected, CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS VARCHAR) AS asked FROM moves
    UNION ALL SELECT case_id, place, CASE WHEN ok THEN to_state ELSE status END, rejected + CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok AND to_state IN ('RESOLVED', 'WRITTEN_OFF') THEN moved_at ELSE resolved_at END, CASE WHEN ok AND to_state = 'PENDING_APPROVAL' THEN actor ELSE asked END
        FROM (SELECT r.case_id, r.place, r.to_state, r.actor, r.moved_at, p.status, p.rejected, p.resolved_at, p.asked,
            e.a IS NOT NULL AND NOT (p.status = 'PENDING_APPROVAL' AND r.to_state IN ('RESOLVED', 'WRITTEN_OFF') AND r.actor IS NOT DISTINCT FROM p.asked) AS ok
            FROM play p JOIN ranked r ON r.case_id = p.case_id AND r.place = p.place + 1 LEFT JOIN edges e ON e.a = p.status AND e.b = r.to_state)),
    final AS (SELECT * FROM play QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY place DESC) = 1)"""


@query(f"WITH RECURSIVE {_REPLAY} SELECT case_id, status, rejected FROM final")
def case_replay(spark, sf_dir):
    """Each case's status after its moves in order; moves that the state or the approval does not allow are rejected."""
    return cases.replay(_log(spark, sf_dir)).select("case_id", "status", "rejected")


@query(f"WITH RECURSIVE {_REPLAY} SELECT case_id, resolved_at FROM final")
def case_resolved_at(spark, sf_dir):
    """The last time that each case reached a final state; reopening keeps it."""
    return cases.replay(_log(spark, sf_dir)).select("case_id", F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"))


@query(f"WITH {_MOVES} SELECT case_id, arg_max(actor, id) AS requester FROM moves WHERE to_state = 'PENDING_APPROVAL' GROUP BY case_id")
def approval_requester(spark, sf_dir):
    return cases.approval_requesters(_log(spark, sf_dir))


@query(f"WITH {_MOVES}, r AS (SELECT case_id, arg_max(actor, id) AS maker FROM moves WHERE to_state = 'PENDING_APPROVAL' GROUP BY case_id) SELECT id, actor, actor <> maker AS allowed FROM moves JOIN r USING (case_id) WHERE to_state IN ('RESOLVED', 'WRITTEN_OFF')")
def maker_checker(spark, sf_dir):
    """Whether those who would resolve a case are others than the one who asked for approval."""
    log = _log(spark, sf_dir)
    finals = log.where(F.col("to").isin(*cases.FINAL)).join(cases.approval_requesters(log), "case_id")
    decided = cases.allowed(F.lit("case.approve"), F.lit("approver"), F.col("actor"), F.col("requester"), F.lit(None), F.lit(None))
    return finals.select("id", "actor", decided.alias("allowed"))


_VOTES = """votes AS (SELECT user_id % 50 AS case_id, event_id AS id, 'U-' || (user_id % 9) AS voter, CASE event_type WHEN 'click' THEN 'analyst' WHEN 'view' THEN 'recon_manager' ELSE 'approver' END AS role, NOT (event_type = 'error' AND event_id % 40 = 0) AS approve, 'U-' || (user_id % 50 % 9) AS maker FROM events WHERE event_id % 20 < 3),
    counted AS (SELECT case_id, min(id) AS id FROM votes WHERE approve AND role IN ('approver', 'tenant_admin', 'recon_manager') AND voter <> maker GROUP BY case_id, voter), ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) AS place FROM counted),
    stops AS (SELECT case_id, min(id) AS stop FROM votes WHERE NOT approve GROUP BY case_id)"""


@query(f"""WITH {_VOTES} SELECT c.case_id, CASE WHEN min(r.id) FILTER (place = 3) IS NOT NULL AND (max(stop) IS NULL OR min(r.id) FILTER (place = 3) < max(stop)) THEN 'APPROVED' WHEN max(stop) IS NOT NULL THEN 'REJECTED' ELSE 'PENDING' END AS outcome,
    count(r.id) FILTER (place <= 3 AND (stop IS NULL OR r.id < stop)) AS approvers FROM (SELECT DISTINCT case_id FROM votes) c LEFT JOIN ranked r ON r.case_id = c.case_id LEFT JOIN stops s ON s.case_id = c.case_id GROUP BY c.case_id""")
def approval_outcome(spark, sf_dir):
    """Approved by three others who may, before the first refusal; rejected; or pending."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    name = lambda x: F.concat(F.lit("U-"), x % 9)
    role = F.when(kind == "click", "analyst").when(kind == "view", "recon_manager").otherwise("approver")
    votes = table(spark, sf_dir, "events").where(e % 20 < 3).select((u % 50).alias("case_id"), e.alias("id"), name(u).alias("voter"), role.alias("role"), (~((kind == "error") & (e % 40 == 0))).alias("approve"), name(u % 50).alias("maker"))
    return cases.approvals(votes, required=3)


@query("SELECT event_id AS case_id, unnest(generate_series(1, CAST(floor(epoch(TIMESTAMP '2024-01-08' - date_trunc('second', ts)) / 86400) AS BIGINT))) AS reminder FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-07'")
def approval_reminders(spark, sf_dir):
    """A reminder for every day that an approval waits."""
    asked = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("case_id"), F.col("ts").cast("timestamp").alias("asked_at"))
    return cases.reminders(asked, F.lit("2024-01-08").cast("timestamp")).withColumn("reminder", F.col("reminder").cast("long"))


_HOURS = "CASE priority WHEN 'HIGH' THEN 4 WHEN 'LOW' THEN 72 ELSE 24 END"
_NOW = "TIMESTAMP '2000-06-01'"


@query(f"SELECT id, CASE WHEN {_NOW} >= opened_at + to_hours({_HOURS}) THEN 'break.sla_breached' WHEN {_NOW} >= opened_at + to_minutes({_HOURS} * 45) THEN 'break.sla_warning' END AS event, CASE WHEN {_NOW} >= opened_at + to_hours({_HOURS}) AND status = 'IN_PROGRESS' THEN 'ESCALATED' ELSE status END AS status FROM cases WHERE status NOT IN ('RESOLVED','WRITTEN_OFF')", cases=True)
def sla_events(spark, sf_dir):
    """Warnings at three quarters of the time, breaches, and the escalation of those that may be."""
    return cases.sla_events(C.cases(spark, sf_dir), F.lit("2000-06-01").cast("timestamp"))


@query(f"WITH {EDGES_SQL} SELECT id, CASE WHEN (status, 'ASSIGNED') IN (SELECT (a, b) FROM edges) THEN 'ASSIGNED' ELSE status END AS status, (status, 'ASSIGNED') IN (SELECT (a, b) FROM edges) AS succeeded, CASE WHEN (status, 'ASSIGNED') NOT IN (SELECT (a, b) FROM edges) THEN 'no move from ' || status || ' to ASSIGNED' END AS reason FROM cases", cases=True)
def bulk_transition(spark, sf_dir):
    """A transition of many cases at once, with each one's success."""
    return cases.bulk(C.cases(spark, sf_dir), "ASSIGNED", "U-1")[0]


@query("SELECT 'break.bulk_transitioned' AS event_type, 'U-1' AS actor_id, 'ASSIGNED' AS \"to\", count(*) FILTER (status = 'OPEN') AS succeeded, count(*) FILTER (status <> 'OPEN') AS failed FROM cases HAVING count(*) FILTER (status = 'OPEN') > 0", cases=True)
def bulk_audit(spark, sf_dir):
    """The one audit event of a bulk transition."""
    return cases.bulk(C.cases(spark, sf_dir), "ASSIGNED", "U-1")[1]


@query("SELECT id, root_cause, true AS valid, root_cause = 'Fraud/Investigation' AS odd FROM cases", cases=True)
def root_cause_check(spark, sf_dir):
    """Root causes of the list; others are not valid."""
    other = F.when(F.col("root_cause") == "Fraud/Investigation", F.col("root_cause")).otherwise(F.lower("root_cause"))
    return C.cases(spark, sf_dir).select("id", "root_cause", cases.valid_root_cause(F.col("root_cause")).alias("valid"), cases.valid_root_cause(other).alias("odd"))


_FNV = "list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query(f"SELECT id, CASE WHEN tenant_id IN ('T-1', 'T-2') THEN 'U-' || tenant_id || '-' || ({_FNV} % (CASE tenant_id WHEN 'T-1' THEN 5 ELSE 3 END)) ELSE 'unassigned-pool' END AS assignee FROM cases", cases=True)
def auto_assign(spark, sf_dir):
    """Breaks dealt to their tenants' teams by the hash of their ids; without a team, or with an empty one, to the pool."""
    teams = [(t, [f"U-{t}-{i}" for i in range(n)]) for t, n in (("T-1", 5), ("T-2", 3), ("T-3", 0))]
    return cases.auto_assign(C.cases(spark, sf_dir), spark.createDataFrame(teams, "tenant_id string, team_members array<string>"))


_ROLE = "CASE user_id % 5 WHEN 0 THEN 'auditor' WHEN 1 THEN 'approver' WHEN 2 THEN 'tenant_admin' WHEN 3 THEN 'analyst' ELSE 'recon_manager' END"


@query(f"""SELECT event_id, {_ROLE} AS role, CASE user_id % 5 WHEN 0 THEN false WHEN 3 THEN false ELSE user_id <> event_id % 150 END AS approve, CASE WHEN user_id % 5 IN (2, 4) THEN user_id <> event_id % 150 ELSE false END AS activate,
    user_id % 5 IN (2, 4) OR user_id % 5 = 3 AND event_id % 3 = user_id % 3 AS act, false AS other FROM events""")
def authz_decision(spark, sf_dir):
    """Who may approve, activate and act: certain roles, never the maker, and analysts of their own unit."""
    e, u = F.col("event_id"), F.col("user_id")
    role = F.element_at(F.array(*map(F.lit, ("auditor", "approver", "tenant_admin", "analyst", "recon_manager"))), (u % 5 + 1).cast("int"))
    decide = lambda action: cases.allowed(F.lit(action), role, u, e % 150, e % 3, u % 3)
    return table(spark, sf_dir, "events").select("event_id", role.alias("role"), *[decide(a).alias(n) for n, a in (("approve", "case.approve"), ("activate", "rule.activate"), ("act", "case.act"), ("other", "case.delete"))])


_REQUESTS = "SELECT event_id AS request_id, 'T-' || (user_id % 3) AS tenant_id, event_type AS method, CASE WHEN event_id % 5 > 0 THEN 'key-' || (event_id % 700) ELSE '' END AS idempotency_key, CASE WHEN event_id % 11 = 0 THEN props ELSE 'same' END AS body FROM events"


@query(f"""WITH q AS ({_REQUESTS}), h AS (SELECT *, method || chr(0) || body AS m, first_value(request_id) OVER w AS first, first_value(method || chr(0) || body) OVER w AS fm FROM q WINDOW w AS (PARTITION BY tenant_id, idempotency_key ORDER BY request_id))
    SELECT request_id, CASE WHEN idempotency_key = '' OR first = request_id THEN 'RUN' WHEN m = fm THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM h""")
def request_idempotency(spark, sf_dir):
    """Requests under keys: the first runs, the same again replays, another conflicts."""
    e = F.col("event_id")
    requests = table(spark, sf_dir, "events").select(
        e.alias("request_id"), F.concat(F.lit("T-"), F.col("user_id") % 3).alias("tenant_id"), F.col("event_type").alias("method"), F.when(e % 5 > 0, F.concat(F.lit("key-"), e % 700)).otherwise("").alias("idempotency_key"),
        F.when(e % 11 == 0, F.col("props")).otherwise("same").alias("body"),
    )
    return cases.checked_requests(requests)


@query("SELECT event_id, 'T-' || (user_id % 10) AS tenant_id FROM events WHERE user_id % 10 < 7")
def api_key_tenant(spark, sf_dir):
    """Requests by the tenants of their API keys, of which only hashes are stored; unknown keys have none."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("key-"), F.col("user_id") % 10).alias("api_key"))
    tenants = spark.range(7).select(F.concat(F.lit("T-"), "id").alias("tenant_id"), F.sha2(F.concat(F.lit("key-"), F.col("id")), 256).alias("api_key_hash"))
    return cases.tenant_of(events, tenants)


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS place FROM events),
    b AS (SELECT user_id, event_id, t, place, CAST(36000 - 3600 AS BIGINT) AS held, true AS passed FROM r WHERE place = 1
    UNION ALL SELECT r.user_id, r.event_id, r.t, r.place, least(36000, b.held + r.t - b.t) - CASE WHEN least(36000, b.held + r.t - b.t) >= 3600 THEN 3600 ELSE 0 END, least(36000, b.held + r.t - b.t) >= 3600 FROM b JOIN r ON r.user_id = b.user_id AND r.place = b.place + 1)
    SELECT event_id, passed FROM b""")
def rate_limit(spark, sf_dir):
    """Requests that a bucket of ten tokens a user, refilled at one an hour, lets through."""
    return cases.token_bucket(table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t")), 10, 3600)
