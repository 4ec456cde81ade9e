"""Change data and the reports over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import analytics
from ledgerloom.plans import canonical as C
from ledgerloom.queries.registry import query


def _decoded(spark, sf_dir, name: str):
    return analytics.decode(C.changes(spark, sf_dir, name), name)


def _times(frame, *names: str):
    return frame.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(f"WITH {C.CHANGES_SQL['transactions']} SELECT * FROM decoded", money=("amount", "base_amount"))
def cdc_decode(spark, sf_dir):
    """Change envelopes of transactions as typed rows."""
    return _times(_decoded(spark, sf_dir, "transactions"), "created_at", "updated_at")


@query(f"WITH {C.CHANGES_SQL['match_results']} SELECT * FROM decoded", money=("confidence_score",))
def cdc_decode_results(spark, sf_dir):
    """Those of match results: an empty rule is none."""
    return _times(_decoded(spark, sf_dir, "match_results"), "matched_at", "created_at")


@query(f"WITH {C.CHANGES_SQL['cases']} SELECT * FROM decoded")
def cdc_decode_cases(spark, sf_dir):
    """Those of breaks: times at the epoch and missing ones are none."""
    return _times(_decoded(spark, sf_dir, "cases"), "sla_due_at", "opened_at", "resolved_at", "created_at")


@query(f"WITH {C.CHANGES_SQL['transactions']}, {C.LATEST_SQL} SELECT id, tenant_id, version, status, amount FROM latest", money=("amount",))
def cdc_latest(spark, sf_dir):
    return analytics.latest(_decoded(spark, sf_dir, "transactions")).select("id", "tenant_id", "version", "status", "amount")


_RATE = "SELECT tenant_id, rule_id, CAST(matched_at AS DATE) AS day, status, count(*) AS match_count, sum(confidence_score)::DOUBLE / count(*) AS avg_confidence FROM {0} WHERE is_deleted = 0 GROUP BY ALL"


@query(f"WITH {C.CHANGES_SQL['match_results']}, {C.LATEST_SQL} {_RATE.format('latest')}")
def match_rate_by_rule(spark, sf_dir):
    """Match results by tenant, rule, day and status, each in its latest version."""
    return analytics.match_rate(analytics.match_rate_states(analytics.latest(_decoded(spark, sf_dir, "match_results"))))


@query(f"WITH {C.CHANGES_SQL['match_results']} {_RATE.format('decoded')}")
def match_rate_per_event(spark, sf_dir):
    """The same with every version counted, as a view that is fed by each change does."""
    return analytics.match_rate(analytics.match_rate_states(_decoded(spark, sf_dir, "match_results")))


@query(f"WITH {C.CHANGES_SQL['match_results']} SELECT tenant_id, rule_id, count(*) AS match_count, sum(confidence_score)::DOUBLE / count(*) AS avg_confidence FROM decoded WHERE is_deleted = 0 GROUP BY ALL")
def agg_state_merge(spark, sf_dir):
    """Daily partial states, merged to states by rule."""
    return analytics.match_rate(analytics.match_rate_states(_decoded(spark, sf_dir, "match_results")), ("tenant_id", "rule_id"))


_HOURS = "CASE priority WHEN 'HIGH' THEN 4 WHEN 'LOW' THEN 72 ELSE 24 END"


@query(f"SELECT id, opened_at + to_hours({_HOURS}) AS due_at, opened_at + to_minutes({_HOURS} * 45) AS warn_at FROM cases", cases=True)
def sla_due(spark, sf_dir):
    opened, priority = F.col("opened_at"), F.col("priority")
    return C.cases(spark, sf_dir).select("id", scalar.sla_due(opened, priority).cast("timestamp_ntz").alias("due_at"), scalar.sla_warning(opened, priority).cast("timestamp_ntz").alias("warn_at"))


@query(f"WITH {C.CHANGES_SQL['cases']}, {C.LATEST_SQL} SELECT tenant_id, assigned_to, root_cause_category, CAST(resolved_at AS DATE) AS day, count(*) AS total, count(*) FILTER (sla_due_at IS NOT NULL AND resolved_at > sla_due_at) AS breached, avg(floor(epoch(resolved_at)) - floor(epoch(opened_at))) AS seconds FROM latest WHERE resolved_at IS NOT NULL GROUP BY ALL")
def sla_compliance(spark, sf_dir):
    return analytics.sla_compliance(analytics.latest(_decoded(spark, sf_dir, "cases")))


_AGE = "CASE WHEN days < 1 THEN '0-1d' WHEN days < 3 THEN '1-3d' WHEN days < 7 THEN '3-7d' WHEN days < 30 THEN '7-30d' ELSE '30+d' END"


@query(f"WITH {C.CHANGES_SQL['cases']}, {C.LATEST_SQL} SELECT tenant_id, account_id, {_AGE} AS bucket, count(*) AS n FROM (SELECT *, date_diff('day', CAST(opened_at AS DATE), DATE '2024-01-16') AS days FROM latest WHERE status NOT IN ('RESOLVED','WRITTEN_OFF')) GROUP BY ALL")
def breaks_aging(spark, sf_dir):
    return analytics.breaks_aging(analytics.latest(_decoded(spark, sf_dir, "cases")), F.lit("2024-01-16").cast("date"))


@query(f"WITH {C.CHANGES_SQL['cases']} SELECT id, version FROM decoded WHERE created_at >= TIMESTAMP '2024-01-10'")
def ttl_filter(spark, sf_dir):
    """Rows that are still kept three years after they were made."""
    return analytics.within_ttl(_decoded(spark, sf_dir, "cases"), F.lit("2027-01-10").cast("date")).select("id", "version")
