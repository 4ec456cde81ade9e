"""The life of a break: transitions, replay, approval, times to resolve, assignment, authorization, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import sla_due, sla_warning
from ledgerloom.plans.canonical import ROOT_CAUSES

# The states and the transitions between them, those that need another's approval, and final states.
STATES = ("OPEN", "ASSIGNED", "IN_PROGRESS", "PENDING_APPROVAL", "ESCALATED", "RESOLVED", "WRITTEN_OFF", "REOPENED")
TRANSITIONS = {
    "OPEN": ("ASSIGNED",),
    "ASSIGNED": ("IN_PROGRESS", "ESCALATED"),
    "IN_PROGRESS": ("PENDING_APPROVAL", "RESOLVED", "ESCALATED"),
    "PENDING_APPROVAL": ("RESOLVED", "ASSIGNED", "WRITTEN_OFF"),
    "ESCALATED": ("ASSIGNED",),
    "RESOLVED": ("REOPENED",),
    "WRITTEN_OFF": ("REOPENED",),
    "REOPENED": ("ASSIGNED",),
}
APPROVED = {("PENDING_APPROVAL", "RESOLVED"), ("PENDING_APPROVAL", "WRITTEN_OFF")}
FINAL = ("RESOLVED", "WRITTEN_OFF")
# Roles that may do an action, and whether the maker is barred; the pool for breaks without a team; hours between reminders.
POLICY = {"case.approve": (("approver", "tenant_admin", "recon_manager"), True), "rule.activate": (("tenant_admin", "recon_manager"), True), "case.act": (("recon_manager", "tenant_admin"), False)}
NOBODY = "unassigned-pool"
REMINDER_HOURS = 24


def valid(before: Column, after: Column) -> Column:
    """Whether the transition is allowed."""
    out = F.lit(False)
    for state, following in TRANSITIONS.items():
        out = F.when(before == state, after.isin(*following)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def valid_root_cause(cause: Column) -> Column:
    return F.coalesce(cause.isin(*ROOT_CAUSES), F.lit(False))


def replay(log: DataFrame) -> DataFrame:
    """``case_id, status, rejected, resolved_at`` from (case_id, id, to, actor, at), folded in order of id in one streaming pass per task.

    A move that the state does not allow, or an approval by the one who asked for it, is rejected. ``resolved_at``
    is the last time a final state was reached; reopening keeps it.
    """
    columns = ["case_id", "status", "rejected", "resolved_at"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, status, rejected, resolved, asked, out = None, "OPEN", 0, None, None, []
        for frame in frames:
            for c, to, actor, at in zip(frame["case_id"], frame["to"], frame["actor"], frame["at"], strict=True):
                if c != case:
                    if case is not None:
                        out.append((case, status, rejected, resolved))
                    case, status, rejected, resolved, asked = c, "OPEN", 0, None, None
                if to not in TRANSITIONS.get(status, ()) or ((status, to) in APPROVED and actor == asked):
                    rejected += 1
                    continue
                if to == "PENDING_APPROVAL":
                    asked = actor
                resolved = at if to in FINAL else resolved
                status = to
            yield pd.DataFrame(out, columns=columns).astype({"resolved_at": "Int64"})
            out = []
        if case is not None:
            yield pd.DataFrame([(case, status, rejected, resolved)], columns=columns).astype({"resolved_at": "Int64"})

    rows = log.select("case_id", "id", "to", "actor", F.unix_micros("at").alias("at")).repartition("case_id").sortWithinPartitions("case_id", "id")
    kind = log.schema["case_id"].dataType.simpleString()
    done = rows.mapInPandas(fold, f"case_id {kind}, status string, rejected long, resolved_at long")
    return done.withColumn("resolved_at", F.timestamp_micros("resolved_at"))


def approval_requesters(log: DataFrame) -> DataFrame:
    """``case_id, requester``: who last asked for approval, from (case_id, id, to, actor)."""
    return log.where("to = 'PENDING_APPROVAL'").groupBy("case_id").agg(F.max_by("actor", "id").alias("requester"))


def approvals(votes: DataFrame, required: int = 1) -> DataFrame:
    """``case_id, outcome, approvers`` from (case_id, id, voter, role, approve, maker), votes in order of id.

    Approved when ``required`` different voters, whose role may approve and who are not the maker, have approved; the
    first refusal before that ends it as REJECTED. Votes that do not count change nothing; else PENDING.
    """
    required = max(1, required)
    may = allowed(F.lit("case.approve"), F.col("role"), F.col("voter"), F.col("maker"), F.lit(None), F.lit(None))
    first = votes.where(F.col("approve") & may).groupBy("case_id", "voter").agg(F.min("id").alias("id"))
    counted = first.groupBy("case_id").agg(F.slice(F.array_sort(F.collect_list("id")), 1, required).alias("ids"))
    stops = votes.where(~F.col("approve")).groupBy("case_id").agg(F.min("id").alias("stop"))
    all_cases = votes.select("case_id").distinct().join(counted, "case_id", "left").join(stops, "case_id", "left")
    reached = F.when(F.size("ids") == required, F.element_at("ids", -1))
    early = F.size(F.filter(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: F.coalesce(i < F.col("stop"), F.lit(True))))
    outcome = F.when(reached.isNotNull() & (F.col("stop").isNull() | (reached < F.col("stop"))), "APPROVED").when(F.col("stop").isNotNull(), "REJECTED").otherwise("PENDING")
    return all_cases.select("case_id", outcome.alias("outcome"), early.cast("long").alias("approvers"))


def reminders(asked: DataFrame, as_of: Column) -> DataFrame:
    """``case_id, reminder``: one row for each reminder due by ``as_of`` of approvals (case_id, asked_at) that are pending."""
    due = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("asked_at")) / (REMINDER_HOURS * 3600)).cast("int")
    return asked.where(due >= 1).select("case_id", F.explode(F.sequence(F.lit(1), due)).alias("reminder"))


def sla_events(cases: DataFrame, as_of: Column) -> DataFrame:
    """``id, event, status``: the last event due by ``as_of`` of each case that is not final; a breach escalates where the state allows it."""
    opened, priority = F.col("opened_at"), F.col("priority")
    breached = as_of >= sla_due(opened, priority)
    event = F.when(breached, "break.sla_breached").when(as_of >= sla_warning(opened, priority), "break.sla_warning")
    status = F.when(breached & valid(F.col("status"), F.lit("ESCALATED")), "ESCALATED").otherwise(F.col("status"))
    return cases.where(~F.col("status").isin(*FINAL)).select("id", event.alias("event"), status.alias("status"))


def bulk(cases: DataFrame, to: str, actor: str) -> tuple[DataFrame, DataFrame]:
    """A transition of many cases: each one's (id, status, succeeded, reason), and one audit event if any succeeded."""
    fine = valid(F.col("status"), F.lit(to))
    each = cases.select("id", F.when(fine, to).otherwise(F.col("status")).alias("status"), fine.alias("succeeded"), F.when(~fine, F.concat(F.lit("no move from "), "status", F.lit(f" to {to}"))).alias("reason"))
    counts = each.agg(F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed")).where("succeeded > 0")
    event = counts.select(F.lit("break.bulk_transitioned").alias("event_type"), F.lit(actor).alias("actor_id"), F.lit(to).alias("to"), "succeeded", "failed")
    return each, event


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a string's or a binary's bytes, within the JVM."""
    digits = F.filter(F.split(F.regexp_replace(F.hex(text.cast("binary")), "(..)", "$1,"), ","), lambda x: x != "")
    step = lambda h, x: F.pmod((h.bitwiseXOR(F.conv(x, 16, 10).cast("long"))) * F.lit(16777619), F.lit(4294967296))
    return F.aggregate(digits, F.lit(2166136261).cast("long"), step)


def auto_assign(cases: DataFrame, teams: DataFrame, key: Column | None = None) -> DataFrame:
    """``id, assignee``: a member of the tenant's team by the hash of the break's id, always the same one.

    ``teams`` has (tenant_id, team_members) of the active routing; a tenant without one or with an empty team has the common pool.
    """
    held = cases.join(teams, "tenant_id", "left")
    team = F.when(F.size("team_members") > 0, F.col("team_members")).otherwise(F.array(F.lit(NOBODY)))
    return held.select("id", F.element_at(team, (fnv1a(F.col("id") if key is None else key) % F.size(team) + 1).cast("int")).alias("assignee"))


def allowed(action: Column, role: Column, user: Column, maker: Column, unit: Column, own_unit: Column) -> Column:
    """The decision of the policy; without a rule that allows, it is no."""
    out = F.lit(False)
    for name, (roles, barred) in POLICY.items():
        out = F.when(action == name, role.isin(*roles) & (user != maker if barred else F.lit(True))).otherwise(out)
    return F.coalesce(out, F.lit(False)) | F.coalesce((action == "case.act") & (role == "analyst") & (unit == own_unit), F.lit(False))


def token_bucket(requests: DataFrame, capacity: int, seconds_a_token: int) -> DataFrame:
    """``event_id, passed`` of (user_id, event_id, t): a bucket for each user, folded in order of time.

    A bucket holds ``capacity`` tokens and gets one back every ``seconds_a_token``; what it holds is counted in seconds, so no fraction is lost.
    """
    full = capacity * seconds_a_token

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held, last = None, full, 0
        for frame in frames:
            passed = []
            for u, t in zip(frame["user_id"], frame["t"], strict=True):
                if u != user:
                    user, held, last = u, full, t
                held, last = min(full, held + (t - last)), t
                passed.append(held >= seconds_a_token)
                held -= seconds_a_token * passed[-1]
            yield pd.DataFrame({"event_id": frame["event_id"], "passed": passed})

    rows = requests.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return rows.mapInPandas(fold, "event_id long, passed boolean")


def checked_requests(requests: DataFrame) -> DataFrame:
    """``request_id, outcome`` of (request_id, tenant_id, method, idempotency_key, body): RUN for the first of a key, REPLAY for the same
    request again, CONFLICT for another body under a key that is taken. Requests without a key always RUN."""
    from ledgerloom.functions.scalar import sha_parts

    hashed = requests.withColumn("h", sha_parts(F.col("tenant_id"), F.col("method"), F.col("body")))
    first = hashed.where("idempotency_key <> ''").groupBy("tenant_id", "idempotency_key").agg(F.min(F.struct("request_id", "h")).alias("first"))
    out = hashed.join(first, ["tenant_id", "idempotency_key"], "left")
    outcome = F.when(F.col("first").isNull() | (F.col("request_id") == F.col("first.request_id")), "RUN").when(F.col("h") == F.col("first.h"), "REPLAY").otherwise("CONFLICT")
    return out.select("request_id", outcome.alias("outcome"))


def tenant_of(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests with the tenant of their API key; only the key's hash is stored (tenant_id, api_key_hash)."""
    hashed = requests.withColumn("api_key_hash", F.sha2("api_key", 256))
    return hashed.join(tenants.select("tenant_id", "api_key_hash"), "api_key_hash").drop("api_key", "api_key_hash")
