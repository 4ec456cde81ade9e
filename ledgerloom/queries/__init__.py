"""The engine's queries, and the SQL that checks them."""

from ledgerloom.queries import analytics, cases, events, ingestion, matching, streams  # noqa: F401 - they register their queries
from ledgerloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
