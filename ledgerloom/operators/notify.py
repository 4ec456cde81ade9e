"""Event notification: the catalogue, filters over payloads, subscriptions, signatures and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import MAX_ATTEMPTS, backoff_minutes, hmac_sha256

# Operators in the order they are looked for, the event catalogue, the kinds of incoming signature.
OPERATORS = (">=", "<=", "!=", "==", ">", "<")
CATALOGUE = (
    "transaction.ingested", "match.found", "match.auto_confirmed", "match.reconciliation_variance", "break.created", "break.assigned",
    "break.sla_warning", "break.sla_breached", "break.resolved", "case.approval_requested", "rule.activated",
)
SCHEMES = ("stripe", "adyen", "generic-hmac-sha256")


def catalogued(event_type: Column) -> Column:
    """Whether an event's type is in the catalogue."""
    return F.coalesce(event_type.isin(*CATALOGUE), F.lit(False))


def compile_filter(expression: str, payload: Column) -> Column:
    """``field OP value`` over a JSON payload: by number if both are numbers, else by text for == and !=.

    The value may be quoted, which makes it a text even if it looks like a number. A blank expression is true, a
    missing field never matches; an expression without an operator, or one that orders texts, is an error.
    """
    if not expression.strip():
        return F.lit(True)
    for op in OPERATORS:
        name, found, value = expression.partition(op)
        if found:
            break
    else:
        raise ValueError(f"no operator in {expression!r}")
    value, name = value.strip(), name.strip()
    if not name:
        raise ValueError(f"no field in {expression!r}")
    field = F.get_json_object(payload, "$" + "".join(f"['{p}']" for p in name.split(".")))
    by = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "!=": lambda a, b: a != b, "==": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}[op]
    try:
        wanted = float(value)
    except ValueError:
        wanted = None
    plain = F.lit(value.strip("'\""))
    text = by(field, plain) if op in ("==", "!=") else F.lit(False)
    if wanted is None:
        if op not in ("==", "!="):
            raise ValueError(f"{op} needs a number in {expression!r}")
        return F.coalesce(text, F.lit(False))
    number = field.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), by(number, F.lit(wanted))).otherwise(text), F.lit(False))


def fan_out(events: DataFrame, subscriptions: list[dict]) -> DataFrame:
    """``event_id, sub, status`` for each event and each active subscription that wants it.

    ``subscriptions`` (sub, active, types, filter) are a tenant's settings, compiled on the driver; one whose filter cannot be
    compiled is skipped, as are events outside the catalogue of a subscription's types. Events have (event_id, event_type, payload).
    """
    wanted = []
    for s in subscriptions:
        if not s["active"]:
            continue
        try:
            fits = compile_filter(s.get("filter") or "", F.col("payload"))
        except ValueError:
            continue
        wanted.append(F.when(F.col("event_type").isin(*s["types"]) & fits, s["sub"]))
    subs = F.array_compact(F.array(*wanted)) if wanted else F.array().cast("array<int>")
    return events.select("event_id", F.explode(subs).alias("sub")).withColumn("status", F.lit("PENDING"))


# ---------------------------------------------------------------- signatures
def sign(t: Column, body: Column, secret: Column) -> Column:
    """``t=..,v1=..`` over the time (seconds) and the body."""
    at = t.cast("string")
    return F.concat(F.lit("t="), at, F.lit(",v1="), hmac_sha256(secret, F.concat(at, F.lit("."), body)))


def verify(signature: Column, body: Column, secret: Column, now: Column, skew_seconds: int) -> Column:
    """Whether a signature is right and its time within the allowed distance of ``now`` (seconds)."""
    t = F.regexp_extract(signature, r"^t=(-?[0-9]+),v1=", 1)
    given = F.lower(F.regexp_extract(signature, r"^t=-?[0-9]+,v1=([0-9a-fA-F]+)$", 1))
    near = F.abs(now - t.try_cast("long")) <= skew_seconds
    return F.coalesce(near & (given == hmac_sha256(secret, F.concat(t, F.lit("."), body))), F.lit(False))


def verify_incoming(scheme: str, signature: Column, body: Column, secret: Column) -> Column:
    """Whether a delivery's signature fits its body; an unknown scheme or a signature that cannot be read never does.

    ``stripe`` has a time and any number of v1 parts over ``time.body``; the others are the hex digest of the body.
    """
    if scheme not in SCHEMES:
        return F.lit(False)
    if scheme != "stripe":
        return F.coalesce(F.lower(F.trim(signature)) == hmac_sha256(secret, body), F.lit(False))
    parts = F.split(signature, ",")
    value = lambda p: F.substr(p, F.instr(p, "=") + 1, F.char_length(p))
    given = F.transform(F.filter(parts, lambda p: p.startswith("v1=")), lambda p: F.lower(F.trim(value(p))))
    t = F.regexp_extract(signature, "(?s)^(?:.*,)?t=([^,]*)", 1)  # the last one; lambdas would be evaluated again wherever the time is used
    return F.coalesce(F.array_contains(given, hmac_sha256(secret, F.concat(t, F.lit("."), body))) & (t != ""), F.lit(False))


def delivery_key(delivery_id: Column, body: Column) -> Column:
    """SHA-256 of the delivery's id, a zero byte and the body, or of the body alone where there is no id."""
    return F.sha2(F.when(F.coalesce(delivery_id, F.lit("")) == "", body).otherwise(F.concat(delivery_id, F.lit("\x00"), body)), 256)


# ---------------------------------------------------------------- deliveries
def delivery_states(attempts: DataFrame) -> DataFrame:
    """``delivery, attempt_count, status, next_attempt_at`` from (delivery, at, n, kind): kind is a response status, or -1 for a redrive.

    Since its last redrive the first 2xx delivers, and the eighth failure is the last; before that the next attempt
    is due after the schedule's minutes. Attempts after a delivery count no more.
    """
    order = Window.partitionBy("delivery").orderBy("n")
    runs = attempts.withColumn("run", F.sum(F.when(F.col("kind") == -1, 1).otherwise(0)).over(order))
    last = runs.groupBy("delivery").agg(F.max("run").alias("run"))
    tries = runs.join(last, ["delivery", "run"]).withColumn("k", F.row_number().over(Window.partitionBy("delivery").orderBy("n")) - F.when(F.col("run") > 0, 1).otherwise(0))
    ok = F.col("kind").between(200, 299)
    hit = F.min(F.when(ok, F.col("k")))
    state = tries.groupBy("delivery").agg(hit.alias("hit"), F.max("k").alias("tried"), F.max_by("at", "n").alias("at"))
    count = F.least(F.coalesce("hit", "tried"), F.lit(MAX_ATTEMPTS))
    status = F.when(F.col("hit") <= MAX_ATTEMPTS, "DELIVERED").when(F.col("tried") >= MAX_ATTEMPTS, "DEAD_LETTERED").when(F.col("tried") > 0, "FAILED").otherwise("PENDING")
    out = state.select("delivery", count.cast("int").alias("attempt_count"), status.alias("status"), "at")
    due = F.when(F.col("status") == "FAILED", F.timestamp_seconds(F.unix_timestamp("at") + 60 * backoff_minutes(F.col("attempt_count"))))
    return out.select("delivery", "attempt_count", "status", due.alias("next_attempt_at"))


# ---------------------------------------------------------------- outbox
def outbox(rows: DataFrame, event_type: Column, aggregate: Column, payload: Column, topic: Column) -> DataFrame:
    """Outbox events ``aggregate_id, event_type, topic, payload, sent_at`` derived from rows."""
    return rows.select(aggregate.alias("aggregate_id"), event_type.alias("event_type"), topic.alias("topic"), payload.alias("payload"), F.lit(None).cast("timestamp").alias("sent_at"))


def relay(events: DataFrame, failed: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """``events`` (id, created_at, sent_at, ...) after a run of the relay: the oldest unsent ones get ``sent_at``, but those in ``failed`` (id).

    One event that cannot be sent does not hold up the others of its run.
    """
    turn = events.where("sent_at IS NULL").orderBy("created_at", "id").limit(limit).select("id").join(failed.select("id"), "id", "left_anti").withColumn("sent", F.lit(True))
    return events.join(turn, "id", "left").withColumn("sent_at", F.when(F.col("sent"), now).otherwise(F.col("sent_at"))).drop("sent")
