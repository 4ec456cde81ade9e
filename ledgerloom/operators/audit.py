"""The audit log's hash chain.

An event's hash covers its own fields and the hash that it stores of the event before it in its tenant's chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The hashed fields and their order.
HEAD = ("id", "tenant_id", "actor_id", "actor_type", "event_type", "entity_type", "entity_id")
TAIL = ("ip_address", "request_id", "occurred_at")


def head() -> Column:
    """What comes before the two states in the hashed text, as bytes; the states end in a zero byte each."""
    line = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
    state = lambda c: F.concat(F.coalesce(F.col(c), F.lit("")), F.lit("\x00"))
    return F.concat(*[line(c) for c in HEAD], state("before_state"), state("after_state"), *[line(c) for c in TAIL])


def event_hash(previous: Column) -> Column:
    """The hash of an event that stores ``previous``."""
    return F.sha2(F.concat(head(), F.lit("hash_chain_prev="), previous, F.lit("\n")), 256)


def verify(log: DataFrame) -> DataFrame:
    """``tenant_id, events, first_broken, tail_broken``: the first event whose stored ``prev_hash`` is not its predecessor's hash.

    Each hash covers what is stored, so the predecessor alone decides and no chain is followed. Hashes lie in ranges of tenant and id, however
    many a tenant has; a task compares neighbours of its range, and the ends of ranges are compared after that. Null if
    no link is broken. A change of the last event alone shows in no link; ``tail_broken`` tells it where the log has its own ``hash``.
    """
    own = event_hash(F.col("prev_hash"))
    stored = F.col("hash") if "hash" in log.columns else own
    hashed = log.select("tenant_id", "id", "prev_hash", own.alias("own"), stored.eqNullSafe(own).alias("right"))
    kind = log.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each tenant of a range its events, first and last link, and the first one broken within."""
        columns = ["tenant_id", "events", "first_id", "first_prev", "last_own", "last_right", "broken"]
        part = None
        for frame in frames:
            done = []
            for r in zip(frame["tenant_id"], frame["id"], frame["prev_hash"], frame["own"], frame["right"], strict=True):
                if part is None or part[0] != r[0]:
                    if part is not None:
                        done.append(part)
                    part = [r[0], 0, r[1], r[2], None, None, None]
                elif part[6] is None and r[2] != part[4]:
                    part[6] = r[1]
                part[1] += 1
                part[4], part[5] = r[3], r[4]
            yield pd.DataFrame(done, columns=columns)
        if part is not None:
            yield pd.DataFrame([part], columns=columns)

    ranges = hashed.repartitionByRange("tenant_id", "id").sortWithinPartitions("tenant_id", "id")
    ends = ranges.mapInPandas(run, f"tenant_id string, events long, first_id {kind}, first_prev string, last_own string, last_right boolean, broken {kind}")
    before = F.coalesce(F.lag("last_own").over(Window.partitionBy("tenant_id").orderBy("first_id")), F.lit(""))  # a few rows a tenant
    broken = F.when(~F.col("first_prev").eqNullSafe(before), F.col("first_id")).otherwise(F.col("broken"))
    linked = ends.withColumn("broken", broken)
    return linked.groupBy("tenant_id").agg(F.sum("events").alias("events"), F.min("broken").alias("first_broken"), (~F.max_by("last_right", "first_id")).alias("tail_broken"))


def build(log: DataFrame) -> DataFrame:
    """``log`` with ``prev_hash`` and ``hash``: each hash covers the one before, so a tenant's events are folded in order.

    The hashed text is made in the JVM; rows stream through a task sorted by tenant and id, which keeps one hash however long the chain is.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, last = None, ""
        for frame in frames:
            before, own = [], []
            for t, text in zip(frame["tenant_id"], frame["__text"], strict=True):
                last = last if t == tenant else ""
                tenant = t
                before.append(last)
                last = hashlib.sha256(f"{text}hash_chain_prev={last}\n".encode()).hexdigest()
                own.append(last)
            yield frame.drop(columns="__text").assign(prev_hash=before, hash=own)

    rows = log.withColumn("__text", head()).repartition("tenant_id").sortWithinPartitions("tenant_id", "id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    return rows.mapInPandas(fold, f"{schema}, prev_hash string, hash string")
