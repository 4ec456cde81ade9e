"""The domain's tables, derived from the supplied star schema, and the same as SQL for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table

# Currencies of the ledgers by nation, and the default root causes.
CURRENCIES = ("USD", "EUR", "GBP", "JPY")
ROOT_CAUSES = (
    "Timing Difference", "Data Entry Error", "Duplicate Transaction", "FX Rate Variance", "Missing Counterparty Statement",
    "System Interface Failure", "Fraud/Investigation", "Fee/Charge Discrepancy", "Unauthorized Transaction",
)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def source_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank transaction per order."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("S-"), "o_orderkey").alias("id"), F.concat(F.lit("T-"), "n_regionkey").alias("tenant_id"),
        F.concat(F.lit("BANK-"), "n_nationkey").alias("account_id"), F.col("o_totalprice").cast("decimal(20,4)").alias("base_amount"), F.col("o_orderdate").cast("date").alias("value_date"),
        F.concat(F.lit("REF"), "o_orderkey").alias("reference"), _pick(CURRENCIES, F.col("n_nationkey") % 4).alias("currency"),
    )


def target_ledger(source: DataFrame) -> DataFrame:
    """The ledger's view of the source: some rows are missing, some differ in amount, date or reference."""
    k = F.col("ord")
    return source.where(k % 17 != 0).select(
        "ord", F.concat(F.lit("L-"), k).alias("id"), "tenant_id", F.regexp_replace("account_id", "^BANK", "GL").alias("account_id"),
        (F.col("base_amount") + F.when(k % 13 == 0, F.lit("0.0100")).otherwise("0.0000").cast("decimal(20,4)")).cast("decimal(20,4)").alias("base_amount"),
        F.date_add("value_date", F.when(k % 11 == 0, 1).otherwise(0)).alias("value_date"), F.concat("reference", F.when(k % 7 == 0, "X").otherwise("")).alias("reference"), "currency",
    )


SOURCE_SQL = """src AS (
    SELECT CAST(o_orderkey AS BIGINT) AS ord, 'S-' || o_orderkey AS id, 'T-' || n_regionkey AS tenant_id, 'BANK-' || n_nationkey AS account_id, CAST(o_totalprice AS DECIMAL(20,4)) AS base_amount,
        CAST(o_orderdate AS DATE) AS value_date, 'REF' || o_orderkey AS reference, ['USD','EUR','GBP','JPY'][n_nationkey % 4 + 1] AS currency
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
TARGET_SQL = """tgt AS (
    SELECT ord, 'L-' || ord AS id, tenant_id, replace(account_id, 'BANK', 'GL') AS account_id, CAST(base_amount + CASE WHEN ord % 13 = 0 THEN 0.0100 ELSE 0.0000 END AS DECIMAL(20,4)) AS base_amount,
        CAST(value_date + CAST(CASE WHEN ord % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS value_date, reference || CASE WHEN ord % 7 = 0 THEN 'X' ELSE '' END AS reference, currency
    FROM src WHERE ord % 17 <> 0)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One break per order, with priority, status and times."""
    k = F.col("o_orderkey").cast("long")
    opened = F.col("o_orderdate").cast("timestamp")
    priority = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("MEDIUM")
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("OPEN")
    resolved = F.when(F.col("o_orderstatus") == "F", F.timestamp_seconds(F.unix_timestamp(opened) + (k % 100) * 3600))
    return table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.concat(F.lit("C-"), k).alias("id"), F.concat(F.lit("T-"), k % 5).alias("tenant_id"), F.concat(F.lit("ACC-"), k % 11).alias("account_id"), priority.alias("priority"),
        status.alias("status"), opened.alias("opened_at"), resolved.alias("resolved_at"), F.concat(F.lit("U-"), k % 7).alias("assignee"), _pick(ROOT_CAUSES, k % 9).alias("root_cause"),
        F.col("o_totalprice").cast("decimal(20,4)").alias("amount_at_risk"), F.when(k % 3 == 0, F.concat(F.lit("W-"), k)).alias("workflow_id"),
    )


CASES_SQL = """cases AS (
    SELECT CAST(o_orderkey AS BIGINT) AS ord, 'C-' || o_orderkey AS id, 'T-' || (o_orderkey % 5) AS tenant_id, 'ACC-' || (o_orderkey % 11) AS account_id,
        CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'MEDIUM' END AS priority,
        CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'OPEN' END AS status, CAST(o_orderdate AS TIMESTAMP) AS opened_at,
        CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 100 AS INTEGER)) END AS resolved_at, 'U-' || (o_orderkey % 7) AS assignee,
        [""" + ", ".join(f"'{x}'" for x in ROOT_CAUSES) + """][o_orderkey % 9 + 1] AS root_cause, CAST(o_totalprice AS DECIMAL(20,4)) AS amount_at_risk, CASE WHEN o_orderkey % 3 = 0 THEN 'W-' || o_orderkey END AS workflow_id
    FROM orders)"""


# ---------------------------------------------------------------- ingestion
def accounts(spark: SparkSession) -> DataFrame:
    """Eleven accounts for each of five tenants, in dollars or euros."""
    i, j = F.floor(F.col("id") / 11), F.col("id") % 11
    return spark.range(55).select(F.concat(F.lit("T-"), i).alias("tenant_id"), F.concat(F.lit("ACC-"), j).alias("account_id"), F.when((i + j) % 3 == 0, "EUR").otherwise("USD").alias("account_currency"))


ACCOUNTS_SQL = "accounts AS (SELECT 'T-' || (x // 11) AS tenant_id, 'ACC-' || (x % 11) AS account_id, CASE WHEN (x // 11 + x % 11) % 3 = 0 THEN 'EUR' ELSE 'USD' END AS account_currency FROM range(55) r(x))"
#: Writes of rates by tenant; some are written again, and not every tenant has each pair.
FX_WRITES = [
    (f"T-{i}", pair[:3], pair[3:], f"{rate * (1 + i / 100) * (1 + written / 50):.10f}", written)
    for i in range(5)
    for pair, rate, times in (("EURUSD", 1.08, 2), ("USDEUR", 0.92, 1), ("JPYUSD", 0.0067, 3), ("JPYEUR", 0.0062, 1))
    for written in range(1, times + 1)
    if not (pair == "JPYEUR" and i > 2)
]


def fx_writes(spark: SparkSession) -> DataFrame:
    columns = "tenant_id string, from_currency string, to_currency string, rate string, written int"
    return spark.createDataFrame(FX_WRITES, columns).withColumn("rate", F.col("rate").cast("decimal(20,10)"))


FX_SQL = "fx(tenant_id, from_currency, to_currency, rate, written) AS (SELECT * REPLACE (CAST(rate AS DECIMAL(20,10)) AS rate) FROM (VALUES " + ", ".join(repr(w) for w in FX_WRITES) + ") v(tenant_id, from_currency, to_currency, rate, written))"
_RAW_AMOUNT = "CASE WHEN o_orderkey % 5 = 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR), '.', ',') WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '  ' || CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) || ' ' ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) END"
RAW_SQL = f"""raw AS (SELECT CAST(o_orderkey AS BIGINT) AS k, {_RAW_AMOUNT} AS amount, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN '991340' ELSE strftime(o_orderdate, '%y%m%d') END AS date,
    CASE o_orderkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'C' WHEN 2 THEN ' d ' WHEN 3 THEN 'RC' WHEN 4 THEN 'DR' ELSE 'cr' END AS mark, CASE o_orderkey % 4 WHEN 0 THEN ' usd' WHEN 1 THEN 'EUR' WHEN 2 THEN 'xxx' ELSE 'Jpy ' END AS currency,
    'INV ' || o_orderkey || ' /REF' || o_custkey || '/' AS note, 'T-' || (o_orderkey % 5) AS tenant_id, 'ACC-' || (o_orderkey % 13) AS account_id, 'K-' || (o_orderkey % 3) AS connector_id, o_orderkey % 29 = 0 AS broken FROM orders)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records rendered from orders, some of them bad, with the JSON payload that a connector would deliver."""
    k = F.col("o_orderkey").cast("long")
    plain = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    amount = F.when(k % 5 == 0, F.replace(plain, F.lit("."), F.lit(","))).when(k % 7 == 0, "n/a").when(k % 11 == 0, F.concat(F.lit("  "), plain, F.lit(" "))).otherwise(plain)
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    out = table(spark, sf_dir, "orders").select(
        k.alias("k"), amount.alias("amount"), F.when(k % 31 == 0, F.lit(None)).when(k % 9 == 0, "991340").otherwise(F.date_format("o_orderdate", "yyMMdd")).alias("date"), pick(6, "D", "C", " d ", "RC", "DR", "cr").alias("mark"),
        pick(4, " usd", "EUR", "xxx", "Jpy ").alias("currency"), F.concat(F.lit("INV "), k, F.lit(" /REF"), "o_custkey", F.lit("/")).alias("note"),
        F.concat(F.lit("T-"), k % 5).alias("tenant_id"), F.concat(F.lit("ACC-"), k % 13).alias("account_id"), F.concat(F.lit("K-"), k % 3).alias("connector_id"), (k % 29 == 0).alias("broken"),
    )
    body = F.to_json(F.struct(F.struct("amount", "mark").alias("tx"), F.col("currency").alias("ccy"), "date", "note"))
    return out.withColumn("payload", F.when(F.col("broken"), F.concat(F.lit("not json "), "k")).otherwise(body))


#: How the payloads of ``raw`` are mapped.
MAPPING = """
source_format: orders
version: 1
mappings:
  - {target: transaction.amount, source: tx.amount, transform: [parse_decimal, apply_sign_from(tx.mark)]}
  - {target: transaction.currency, source: ccy, transform: [trim, uppercase, iso4217_validate]}
  - {target: transaction.value_date, source: date, transform: ['parse_date("YYMMDD")']}
  - {target: transaction.reference, source: note, transform: ['extract_regex("/REF([0-9]+)/")']}
  - {target: transaction.description, source: note, transform: [trim]}
"""


# ---------------------------------------------------------------- results of a stream
STREAM_SQL = """stream AS (SELECT ord, CASE ord % 10 WHEN 1 THEN ['S-' || ord, 'L-' || (ord + 1)] WHEN 2 THEN ['S-' || ord, 'L-' || ord, 'S-' || (ord + 1)] WHEN 3 THEN ['X-' || ord, 'L-' || (ord + 2)] ELSE ['S-' || ord, 'L-' || ord] END AS ids FROM tgt WHERE ord % 10 <> 0)"""


def stream_results(target: DataFrame) -> DataFrame:
    """What a stream has matched on its own: most as the batch does, some with other records, some alone."""
    k = F.col("ord")
    name = lambda side, at: F.concat(F.lit(f"{side}-"), at)
    ids = F.when(k % 10 == 1, F.array(name("S", k), name("L", k + 1))).when(k % 10 == 2, F.array(name("S", k), name("L", k), name("S", k + 1))).when(k % 10 == 3, F.array(name("X", k), name("L", k + 2)))
    return target.where(k % 10 != 0).select("ord", ids.otherwise(F.array(name("S", k), name("L", k))).alias("ids"))


DECISIONS_SQL = """decisions AS (SELECT 'S-' || ord || '>L-' || ord AS result_id, CASE ord % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' ELSE 'POSTPONE' END AS decision, CASE WHEN ord % 9 = 0 THEN '' ELSE 'U-' || (ord % 7) END AS actor FROM src WHERE ord % 4 <> 3)"""


def decisions(source: DataFrame) -> DataFrame:
    """Reviewers' decisions, on suggested results, on others, and on some that do not exist."""
    k = F.col("ord")
    return source.where(k % 4 != 3).select(
        F.concat(F.lit("S-"), k, F.lit(">L-"), k).alias("result_id"), F.when(k % 4 == 0, "CONFIRM").when(k % 4 == 1, "REJECT").otherwise("POSTPONE").alias("decision"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("U-"), k % 7)).alias("actor"),
    )


# ---------------------------------------------------------------- change data
def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def changes(spark: SparkSession, sf_dir: str, captured: str) -> DataFrame:
    """Change envelopes (op, before, after, ts_ms) of one captured table over the events; the version is the event's number."""
    e, u = F.col("event_id").cast("long"), F.col("user_id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    ts, day = F.col("ts").cast("timestamp"), (F.lit(19700) + e % 400).cast("string")
    rows = {
        "transactions": {"id": text("X-", e % 3000), "tenant_id": text("T-", e % 5), "account_id": text("ACC-", u % 11), "amount": F.col("value").cast("decimal(20,4)").cast("string"), "base_amount": (F.col("value") * 2).cast("decimal(20,4)").cast("string"), "currency": F.when(e % 6 != 0, "USD"), "value_date": day, "booking_date": day, "status": F.col("event_type"), "created_at": _time(ts)},
        "match_results": {"id": text("M-", e % 2000), "tenant_id": text("T-", e % 5), "rule_id": F.when(u % 7 == 0, "").when(u % 7 != 1, text("R-", u % 7)), "match_type": F.lit("ONE_TO_ONE"), "confidence_score": ((e % 1001) / 1000).cast("decimal(4,3)").cast("string"), "status": F.col("event_type"), "matched_at": _time(ts), "created_at": _time(ts)},
        "cases": {"id": text("C-", e % 1500), "tenant_id": text("T-", e % 5), "account_id": text("ACC-", u % 11), "break_type": F.lit("UNMATCHED"), "root_cause_category": F.when(u % 2 == 0, "Timing Difference"), "status": F.when(e % 3 == 0, "RESOLVED").when(e % 3 == 1, "OPEN").otherwise("ASSIGNED"), "assigned_to": text("U-", u % 7), "priority": F.lit("HIGH"), "sla_due_at": F.when(e % 4 == 0, "1970-01-01T00:00:00.000000Z").when(e % 4 != 1, _time(ts + F.expr("INTERVAL 4 HOURS"))), "opened_at": _time(ts), "resolved_at": F.when(e % 3 == 0, _time(F.timestamp_seconds(F.unix_timestamp(ts) + (e % 9) * 3600))), "created_at": _time(ts)},
    }[captured]
    row = F.to_json(F.struct(*[c.alias(n) for n, c in rows.items()]))
    op = F.when(e % 10 == 0, "d").when(e % 10 < 4, "u").otherwise("c")
    return table(spark, sf_dir, "events").select(op.alias("op"), F.when(op != "c", row).alias("before"), F.when(op != "d", row).alias("after"), e.alias("ts_ms"))


_DAY = "CAST(DATE '1970-01-01' + CAST(19700 + event_id % 400 AS INTEGER) AS DATE)"
CHANGES_SQL = {
    "transactions": f"""decoded AS (SELECT 'X-' || (event_id % 3000) AS id, 'T-' || (event_id % 5) AS tenant_id, 'ACC-' || (user_id % 11) AS account_id, '' AS external_ref, CAST(value AS DECIMAL(20,4)) AS amount, CASE WHEN event_id % 6 <> 0 THEN 'USD' ELSE '' END AS currency,
        CAST(value * 2 AS DECIMAL(20,4)) AS base_amount, {_DAY} AS value_date, {_DAY} AS booking_date, '' AS counterparty_ref, '' AS side, '' AS source_mode, event_type AS status, ts AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
        event_id AS version, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS is_deleted FROM events)""",
    "match_results": """decoded AS (SELECT 'M-' || (event_id % 2000) AS id, 'T-' || (event_id % 5) AS tenant_id, CASE WHEN user_id % 7 > 1 THEN 'R-' || (user_id % 7) END AS rule_id, 'ONE_TO_ONE' AS match_type, CAST((event_id % 1001) / 1000 AS DECIMAL(4,3)) AS confidence_score, event_type AS status, ts AS matched_at,
        ts AS created_at, event_id AS version, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS is_deleted FROM events)""",
    "cases": """decoded AS (SELECT 'C-' || (event_id % 1500) AS id, 'T-' || (event_id % 5) AS tenant_id, 'ACC-' || (user_id % 11) AS account_id, 'UNMATCHED' AS break_type, CASE WHEN user_id % 2 = 0 THEN 'Timing Difference' ELSE '' END AS root_cause_category,
        CASE event_id % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'OPEN' ELSE 'ASSIGNED' END AS status, 'U-' || (user_id % 7) AS assigned_to, 'HIGH' AS priority, CASE WHEN event_id % 4 > 1 THEN ts + INTERVAL 4 HOUR END AS sla_due_at, ts AS opened_at,
        CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + to_hours(CAST(event_id % 9 AS INTEGER)) END AS resolved_at, ts AS created_at, event_id AS version, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS is_deleted FROM events)""",
}
LATEST_SQL = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, id ORDER BY version DESC) AS place FROM decoded) WHERE place = 1 AND is_deleted = 0)"


# ---------------------------------------------------------------- logs
AUDIT_SQL = """log AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'T-' || (user_id % 20) AS tenant_id, 'U-' || user_id AS actor_id, 'USER' AS actor_type, event_type, 'Break' AS entity_type, 'C-' || (event_id % 50) AS entity_id,
    CASE WHEN event_id % 3 = 0 THEN '{"s":1}' END AS before_state, props AS after_state, '10.0.0.1' AS ip_address, CAST(NULL AS VARCHAR) AS request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM events)"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log, a chain for each tenant."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.lpad(e.cast("string"), 12, "0").alias("id"), F.concat(F.lit("T-"), F.col("user_id") % 20).alias("tenant_id"), F.concat(F.lit("U-"), "user_id").alias("actor_id"), F.lit("USER").alias("actor_type"), "event_type",
        F.lit("Break").alias("entity_type"), F.concat(F.lit("C-"), e % 50).alias("entity_id"), F.when(e % 3 == 0, '{"s":1}').alias("before_state"), F.col("props").alias("after_state"), F.lit("10.0.0.1").alias("ip_address"),
        F.lit(None).cast("string").alias("request_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"),
    )


def case_log(spark: SparkSession, sf_dir: str, states: tuple[str, ...]) -> DataFrame:
    """Moves that were asked for, in order of their ids; many are not allowed."""
    e, u = F.col("event_id"), F.col("user_id")
    to = F.element_at(F.array(*map(F.lit, states)), ((e * 7 + u * 3 + F.floor(e / 64)) % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("C-"), u % 97).alias("case_id"), e.alias("id"), to.alias("to"), F.concat(F.lit("U-"), u % 3).alias("actor"), F.col("ts").cast("timestamp").alias("at"))


def case_log_sql(states: tuple[str, ...]) -> str:
    return f"moves AS (SELECT 'C-' || (user_id % 97) AS case_id, event_id AS id, {list(states)}[(event_id * 7 + user_id * 3 + event_id // 64) % 8 + 1] AS to_state, 'U-' || (user_id % 3) AS actor, ts AS moved_at FROM events)"
