"""Change data capture: envelopes to rows, the latest version of each row, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the captured tables by how they are decoded.
TABLES = {
    "transactions": {"id": "text", "tenant_id": "text", "account_id": "text", "external_ref": "text", "amount": "amount", "currency": "text", "base_amount": "amount", "value_date": "day", "booking_date": "day", "counterparty_ref": "text", "side": "text", "source_mode": "text", "status": "text", "created_at": "time", "updated_at": "time"},
    "match_results": {"id": "text", "tenant_id": "text", "rule_id": "optional", "match_type": "text", "confidence_score": "score", "status": "text", "matched_at": "time", "created_at": "time"},
    "cases": {"id": "text", "tenant_id": "text", "account_id": "text", "break_type": "text", "root_cause_category": "text", "status": "text", "assigned_to": "text", "priority": "text", "sla_due_at": "optional_time", "opened_at": "time", "resolved_at": "optional_time", "created_at": "time"},
}
FINAL = ("RESOLVED", "WRITTEN_OFF")


def _decoded(kind: str, raw: Column) -> Column:
    """A JSON field's value: missing texts are empty, days count from 1970, times that are missing or at the epoch are null where optional."""
    if kind == "text":
        return F.coalesce(raw, F.lit(""))
    if kind == "optional":
        return F.nullif(raw, F.lit(""))
    if kind == "day":
        return F.date_add(F.lit("1970-01-01").cast("date"), raw.try_cast("int"))
    if kind in ("amount", "score"):
        return raw.try_cast("decimal(20,4)" if kind == "amount" else "decimal(4,3)")
    time = raw.try_cast("timestamp")
    return F.nullif(time, F.timestamp_seconds(F.lit(0))) if kind == "optional_time" else time


def decode(changes: DataFrame, table: str) -> DataFrame:
    """Typed rows of (op, before, after, ts_ms) envelopes, with ``version`` and ``is_deleted``; deletions carry what was before."""
    fields = TABLES[table]
    row = F.from_json(F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")), "struct<" + ", ".join(f"{c}: string" for c in fields) + ">")
    read = changes.select(F.col("ts_ms").alias("version"), F.when(F.col("op") == "d", 1).otherwise(0).alias("is_deleted"), F.explode(F.array(row)).alias("r"))
    return read.select(*[_decoded(kind, F.col(f"r.{c}")).alias(c) for c, kind in fields.items()], "version", "is_deleted")


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each (tenant, id), without deleted ones; an aggregate that combines before its shuffle."""
    others = [c for c in rows.columns if c not in ("tenant_id", "id", "version")]
    newest = rows.groupBy("tenant_id", "id").agg(F.max_by(F.struct("version", *others), "version").alias("r"))
    return newest.select("tenant_id", "id", "r.*").where("is_deleted = 0")


def within_ttl(rows: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    """Rows that are not older than the time they are kept."""
    return rows.where(F.col("created_at") >= F.add_months(as_of, -12 * years).cast("timestamp"))


def match_rate_states(results: DataFrame) -> DataFrame:
    """Partial states (count, sum of confidence) by tenant, rule, day and status of live match results; states of parts may be added up."""
    live = results.where("is_deleted = 0")
    return live.groupBy("tenant_id", "rule_id", F.to_date("matched_at").alias("day"), "status").agg(F.count("*").alias("n"), F.sum("confidence_score").alias("total"))


def match_rate(states: DataFrame, keys: tuple[str, ...] = ("tenant_id", "rule_id", "day", "status")) -> DataFrame:
    """Counts and average confidence from partial states."""
    out = states.groupBy(*keys).agg(F.sum("n").alias("match_count"), F.sum("total").alias("total"))
    return out.select(*keys, "match_count", (F.col("total").cast("double") / F.col("match_count")).alias("avg_confidence"))


def sla_compliance(cases: DataFrame) -> DataFrame:
    """Resolved cases by tenant, assignee, root cause and day: all, those after their due time, and mean seconds to resolve."""
    done = cases.where("is_deleted = 0 AND resolved_at IS NOT NULL")
    late = F.col("sla_due_at").isNotNull() & (F.col("resolved_at") > F.col("sla_due_at"))
    seconds = (F.unix_timestamp("resolved_at") - F.unix_timestamp("opened_at")).cast("double")
    keys = ["tenant_id", "assigned_to", "root_cause_category", F.to_date("resolved_at").alias("day")]
    return done.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(late).alias("breached"), F.avg(seconds).alias("seconds"))


def aging_bucket(days: Column) -> Column:
    return F.when(days < 1, "0-1d").when(days < 3, "1-3d").when(days < 7, "3-7d").when(days < 30, "7-30d").otherwise("30+d")


def breaks_aging(cases: DataFrame, as_of: Column) -> DataFrame:
    """Open cases by tenant, account and age in calendar days at ``as_of``."""
    live = cases.where((F.col("is_deleted") == 0) & ~F.col("status").isin(*FINAL))
    days = F.datediff(F.to_date(as_of), F.to_date("opened_at"))
    return live.groupBy("tenant_id", "account_id", aging_bucket(days).alias("bucket")).agg(F.count("*").alias("n"))
