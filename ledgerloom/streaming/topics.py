"""The event topics: how they are parted and kept, and rows as their messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 24 * 3600 * 1000


@dataclass(frozen=True)
class Topic:
    name: str
    keys: tuple[str, ...]
    keep_ms: int
    partitions: int = 50


# The topics, the columns of their messages' keys, and how long they are kept (-1: compacted, for good).
TOPICS = {
    t.name: t
    for t in (
        Topic("ingestion.raw.default", ("tenant_id",), 7 * DAY),
        Topic("normalized.transactions.default", ("tenant_id", "account_id"), 30 * DAY),
        Topic("matching.results.default", ("tenant_id", "account_id"), 90 * DAY),
        Topic("case.events.default", ("tenant_id",), 365 * DAY),
        Topic("audit.events", ("tenant_id",), -1),
        Topic("webhook.outbox", ("tenant_id",), 7 * DAY),
        Topic("dlq.format_parse", ("tenant_id",), 90 * DAY),
        Topic("dlq.field_mapping", ("tenant_id",), 90 * DAY),
        Topic("dlq.validation", ("tenant_id",), 90 * DAY),
    )
}


def messages(rows: DataFrame, topic: str, payload: str = "payload") -> DataFrame:
    """``topic, key, value`` for a sink that routes by topic; messages of one key stay in order."""
    if topic not in TOPICS:
        raise ValueError(f"unknown topic {topic!r}")
    return rows.select(F.lit(topic).alias("topic"), F.concat_ws("|", *TOPICS[topic].keys).alias("key"), F.col(payload).alias("value"))


def dead_letters(quarantined: DataFrame) -> DataFrame:
    """Quarantined records (tenant_id, stage, reason, payload) as messages of their stages' topics; a stage without one has no message."""
    name = F.concat(F.lit("dlq."), "stage")
    known = quarantined.where(name.isin(*TOPICS))
    return known.select(name.alias("topic"), F.col("tenant_id").alias("key"), F.to_json(F.struct("reason", "payload")).alias("value"))


def kept_messages(messages: DataFrame, as_of_ms: int) -> DataFrame:
    """Messages (topic, key, at_ms, value) that are still there: not older than their topic keeps, or the last of a key where it is compacted."""
    limits = messages.sparkSession.createDataFrame([(t.name, t.keep_ms) for t in TOPICS.values()], "topic string, keep_ms long")
    held = messages.join(F.broadcast(limits), "topic")
    timed = held.where((F.col("keep_ms") >= 0) & (F.col("at_ms") >= F.lit(as_of_ms) - F.col("keep_ms"))).select("topic", "key", "at_ms", "value")
    last = held.where("keep_ms < 0").groupBy("topic", "key").agg(F.max_by(F.struct("at_ms", "value"), "at_ms").alias("m")).select("topic", "key", "m.*")
    return timed.unionByName(last)
