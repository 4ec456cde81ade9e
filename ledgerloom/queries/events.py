"""Notification: filters, subscriptions, signatures, deliveries, the outbox."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import notify
from ledgerloom.plans import canonical as C
from ledgerloom.queries.registry import query
from ledgerloom.session import table


@query("SELECT event_id, value >= 20 AS by_value, event_type <> 'click' AS by_type, false AS missing, event_type = '5' OR false AS by_text, true AS blank FROM events")
def event_filter(spark, sf_dir):
    """Filter expressions compiled over JSON payloads."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("value", "event_type")).alias("payload"))
    filters = {"by_value": "value >= 20", "by_type": "event_type != 'click'", "missing": "other == 1", "by_text": "event_type == '5'", "blank": " "}
    return e.select("event_id", *[notify.compile_filter(x, F.col("payload")).alias(n) for n, x in filters.items()])


@query("SELECT event_id, event_id % 3 = 0 AS listed FROM events")
def event_catalogue(spark, sf_dir):
    """Types of the catalogue, and others."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, F.element_at(F.array(*map(F.lit, notify.CATALOGUE)), (e % 11 + 1).cast("int"))).when(e % 3 == 1, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", notify.catalogued(kind).alias("listed"))


#: Subscriptions: wanted types, a filter; one is not active, one has a filter that cannot be compiled.
SUBSCRIPTIONS = [
    {"sub": 1, "active": True, "types": ["click", "error"], "filter": "value >= 20"},
    {"sub": 2, "active": True, "types": ["purchase"], "filter": ""},
    {"sub": 3, "active": False, "types": ["click", "view"], "filter": ""},
    {"sub": 4, "active": True, "types": ["view", "click"], "filter": "value ~ 3"},
    {"sub": 5, "active": True, "types": ["view"], "filter": "event_type != 'error'"},
]
_WANTED = "(event_type IN ('click','error') AND value >= 20 AND sub = 1) OR (event_type = 'purchase' AND sub = 2) OR (event_type = 'view' AND sub = 5)"


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_json(F.struct("value", "event_type")).alias("payload"))
    return notify.fan_out(events, SUBSCRIPTIONS)


@query(f"SELECT sub, count(*) AS n FROM events, (VALUES (1), (2), (5)) s(sub) WHERE {_WANTED} GROUP BY sub")
def subscription_match(spark, sf_dir):
    return _deliveries(spark, sf_dir).groupBy("sub").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, sub, 'PENDING' AS status FROM events, (VALUES (1), (2), (5)) s(sub) WHERE {_WANTED}")
def webhook_fanout(spark, sf_dir):
    """A delivery for each event and active subscription that wants it."""
    return _deliveries(spark, sf_dir)


# ---------------------------------------------------------------- signatures
def _hmac_sql(secret: str, body: str) -> str:
    """HMAC-SHA256 of a text in SQL, for a key that is known here."""
    key = secret.encode() if len(secret) <= 64 else hashlib.sha256(secret.encode()).digest()
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in key.ljust(64, b"\0")) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({body}))))"


SECRET = "a secret of the receiver"


@query(f"SELECT event_id, 't=' || floor(epoch(ts))::BIGINT || ',v1=' || {_hmac_sql(SECRET, chr(39) + chr(39) + ' || floor(epoch(ts))::BIGINT || ' + chr(39) + '.' + chr(39) + ' || props')} AS signature, event_id % 7 <> 0 AND event_id % 11 < 6 AS valid FROM events")
def hmac_verify(spark, sf_dir):
    """Signatures over times and payloads; changed payloads and times too far away do not verify."""
    e, t = F.col("event_id"), F.unix_timestamp("ts")
    signed = table(spark, sf_dir, "events").withColumn("signature", notify.sign(t, F.col("props"), F.lit(SECRET)))
    body = F.when(e % 7 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    valid = notify.verify(F.col("signature"), body, F.lit(SECRET), t + (e % 11) * 60 * F.when(e % 2 == 0, 1).otherwise(-1), 300)
    return signed.select("event_id", "signature", valid.alias("valid"))


@query(f"SELECT event_id, {_hmac_sql(SECRET * 4, 'props')} AS digest, event_id % 5 <> 0 AS generic, event_id % 5 <> 0 AS stripe, false AS other FROM events")
def webhook_signature(spark, sf_dir):
    """Incoming signatures: a hex digest of the body, and a time with several digests, one of which is right; under a long key."""
    e, key = F.col("event_id"), F.lit(SECRET * 4)
    body = F.when(e % 5 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    stripe = F.concat(F.lit("t="), e, F.lit(",v1=00,v1="), scalar.hmac_sha256(key, F.concat(e.cast("string"), F.lit("."), "props")), F.lit(",v0=1"))
    events = table(spark, sf_dir, "events").withColumns({"digest": scalar.hmac_sha256(key, F.col("props")), "stripe": stripe})
    check = lambda scheme, given: notify.verify_incoming(scheme, given, body, key)
    return events.select("event_id", "digest", check("generic-hmac-sha256", F.concat(F.lit(" "), F.upper("digest"))).alias("generic"), check("stripe", F.col("stripe")).alias("stripe"), check("none", F.col("digest")).alias("other"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN sha256(props) ELSE sha256(CAST(event_id AS VARCHAR) || chr(0) || props) END AS key FROM events")
def delivery_key(spark, sf_dir):
    given = F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", notify.delivery_key(given, F.col("props")).alias("key"))


# ---------------------------------------------------------------- deliveries
@query("SELECT event_id, event_id % 10 + 1 AS attempt, CASE WHEN event_id % 10 + 1 < 8 THEN [1, 5, 30, 120, 720][least(event_id % 10 + 1, 5)] * CAST(1.0 AS DOUBLE) END AS minutes, CASE WHEN event_id % 10 + 1 < 8 THEN [1, 5, 30, 120, 720][least(event_id % 10 + 1, 5)] * CAST(1.1 AS DOUBLE) END AS late FROM events")
def backoff_schedule(spark, sf_dir):
    """Minutes before the next attempt, none after the eighth, and with the largest jitter."""
    n = (F.col("event_id") % 10 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10 + 1).alias("attempt"), scalar.backoff_minutes(n).cast("double").alias("minutes"), F.round(scalar.backoff_minutes(n, F.lit(1.0)), 9).alias("late"))


_TRIES = "a AS (SELECT user_id AS delivery, event_id AS n, date_trunc('second', ts) AS tried_at, CASE WHEN event_id % 131 = 0 THEN -1 WHEN event_type = 'purchase' AND user_id % 3 <> 0 THEN 204 ELSE 500 END AS kind FROM events WHERE user_id % 2 = 0 OR event_id % 16 = 0)"


@query(f"""WITH {_TRIES}, r AS (SELECT *, coalesce(max(n) FILTER (kind = -1) OVER (PARTITION BY delivery), -1) AS since FROM a), t AS (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY n) AS k FROM r WHERE n > since),
    f AS (SELECT d.delivery, min(k) FILTER (kind BETWEEN 200 AND 299) AS hit, count(k) AS tried, arg_max(t.tried_at, t.n) AS tried_at FROM (SELECT DISTINCT delivery FROM a) d LEFT JOIN t ON t.delivery = d.delivery GROUP BY d.delivery),
    s AS (SELECT *, CASE WHEN hit <= 8 THEN 'DELIVERED' WHEN tried >= 8 THEN 'DEAD_LETTERED' WHEN tried > 0 THEN 'FAILED' ELSE 'PENDING' END AS status, CAST(least(coalesce(hit, tried), 8) AS INTEGER) AS attempt_count FROM f)
    SELECT delivery, attempt_count, status, CASE WHEN status = 'FAILED' THEN tried_at + to_minutes([1, 5, 30, 120, 720][least(attempt_count, 5)]) END AS next_attempt_at FROM s""")
def delivery_state(spark, sf_dir):
    """Deliveries after their attempts and redrives, and when the next attempt is due."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(e % 131 == 0, -1).when((F.col("event_type") == "purchase") & (u % 3 != 0), 204).otherwise(500)
    tries = table(spark, sf_dir, "events").where((u % 2 == 0) | (e % 16 == 0)).select(u.alias("delivery"), e.alias("n"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    return notify.delivery_states(tries).withColumn("next_attempt_at", F.col("next_attempt_at").cast("timestamp_ntz"))


# ---------------------------------------------------------------- outbox
@query("""WITH t AS (SELECT event_id FROM events WHERE event_id % 3 = 0 ORDER BY ts, event_id LIMIT 100)
    SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN ts WHEN event_id IN (SELECT event_id FROM t) AND event_id % 5 > 0 THEN TIMESTAMP '2024-02-01' END AS sent_at FROM events""")
def outbox_unsent(spark, sf_dir):
    """The outbox after one run of the relay: a hundred of the oldest unsent events, but those that could not be sent."""
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select(e.alias("id"), ts.alias("created_at"), F.when(e % 3 > 0, ts).alias("sent_at"))
    out = notify.relay(events, events.where("id % 5 = 0"), F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))


@query("SELECT CAST(event_id AS VARCHAR) AS aggregate_id, event_type, 'events.' || event_type AS topic, json_object('id', event_id, 'user', user_id) AS payload FROM events")
def outbox_events(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    return notify.outbox(table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id").cast("string"), payload, F.concat(F.lit("events."), "event_type")).drop("sent_at")


@query("SELECT 'C-' || o_orderkey AS aggregate_id, 'break.created' AS event_type, 'case.events.default' AS topic, json_object('amount', CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR)) AS payload FROM orders")
def break_events(spark, sf_dir):
    """The events of opened breaks."""
    rows = C.cases(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("amount_at_risk").cast("decimal(20,2)").cast("string").alias("amount")))
    return notify.outbox(rows, F.lit("break.created"), F.col("id"), payload, F.lit("case.events.default")).drop("sent_at")
