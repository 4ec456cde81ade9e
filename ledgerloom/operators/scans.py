"""Table scans: every one names its tenant; other filters apply where they are given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """One tenant's rows; a scan without a tenant is an error."""
    if not tenant:
        raise ValueError("a scan needs a tenant")
    return rows.where(F.col("tenant_id") == tenant)


def _given(rows: DataFrame, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def transactions(rows: DataFrame, tenant: str, account: str | None = None, status: str | None = None, currency: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """A tenant's transactions by any of account, status, currency and value dates (both ends included), by date."""
    out = _given(of_tenant(rows, tenant), account_id=account, status=status, currency=currency)
    out = out.where(F.col("value_date") >= F.lit(since).cast("date")) if since else out
    out = out.where(F.col("value_date") <= F.lit(until).cast("date")) if until else out
    return out.orderBy("value_date", "id")


def breaks(rows: DataFrame, tenant: str, status: str | None = None, assignee: str | None = None, account: str | None = None, priority: str | None = None) -> DataFrame:
    """A tenant's breaks by any of status, assignee, account and priority."""
    return _given(of_tenant(rows, tenant), status=status, assignee=assignee, account_id=account, priority=priority)


def load_window(day: str, margin: int = 3) -> tuple[str, str]:
    """The first and the last date, both included, that a partition of one day loads."""
    from datetime import date, timedelta

    at = date.fromisoformat(day)
    return (at - timedelta(days=margin)).isoformat(), (at + timedelta(days=1 + margin)).isoformat()


def partitions(rows: DataFrame, since: str | None = None) -> DataFrame:
    """``tenant_id, value_date, source_account, target_account``: pairs of accounts that have unmatched rows on a day.

    With ``since`` only days with a row that was updated then or later count (``updated_at``).
    """
    if since:
        rows = rows.where(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    u = rows.where("status = 'UNMATCHED'").select("tenant_id", "value_date", "account_id").distinct()
    a, b = (u.select("tenant_id", "value_date", F.col("account_id").alias(n)) for n in ("source_account", "target_account"))
    return a.join(b, ["tenant_id", "value_date"]).where("source_account < target_account")


def backfill_candidates(cases: DataFrame) -> DataFrame:
    """Breaks that are not final and that no workflow has yet."""
    return cases.where("status NOT IN ('RESOLVED','WRITTEN_OFF') AND workflow_id IS NULL")


#: Upper bounds of the sizes that the histogram of partitions tells apart; the last is the most that one partition should have.
SIZE_BOUNDS = (10, 100, 1_000, 10_000, 50_000)


def size_histogram(rows: DataFrame, bounds: tuple[int, ...] = SIZE_BOUNDS) -> DataFrame:
    """``up_to, n``: how many partitions (tenant, account, day) have at most so many rows, each counted once; -1 for larger ones."""
    sizes = rows.groupBy("tenant_id", "account_id", "value_date").agg(F.count("*").alias("size"))
    up_to = F.lit(-1)
    for b in sorted(bounds, reverse=True):
        up_to = F.when(F.col("size") <= b, b).otherwise(up_to)
    return sizes.groupBy(up_to.cast("long").alias("up_to")).agg(F.count("*").alias("n"))
