"""Sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import canonical as C
from ledgerloom.plans import rules
from ledgerloom.queries.matching import ledgers
from ledgerloom.queries.registry import query
from ledgerloom.session import delete_folder, kept, shared, table
from ledgerloom.sinks import tables
from ledgerloom.sources import connectors, files, mt940
from ledgerloom.streaming import jobs


# ---------------------------------------------------------------- files
@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(NULL AS VARCHAR) AS reason FROM nation UNION ALL SELECT '98', 'short', NULL, 'format_parse: wrong number of fields' UNION ALL SELECT '99', 'long', '1', 'format_parse: wrong number of fields'")
def scan_csv(spark, sf_dir):
    """Nations and two broken rows written as CSV and scanned as text."""
    folder = shared(spark, "csv")
    good = table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    lines = spark.createDataFrame([("n_nationkey,n_name,n_regionkey",)], "value string").unionAll(good).unionAll(spark.createDataFrame([("98,short",), ("99,long,1,2",)], "value string"))
    lines.coalesce(1).write.text(folder)
    return kept(files.scan_csv(spark, folder, ["n_nationkey", "n_name", "n_regionkey"]).drop("_corrupt_record"), folder)


@query("SELECT 'T-1' AS tenant_id, 'K-csv' AS connector_id, 'B-1' AS batch_id, 'csv' AS source_format, '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\"}' AS payload FROM nation")
def connector_fetch(spark, sf_dir):
    """Raw records of a registered connector."""
    folder = shared(spark, "csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(folder)
    source = connectors.create("csv", {"tenant_id": "T-1", "connector_id": "K-csv", "batch_id": "B-1", "path": folder})
    return kept(source.fetch(spark), folder)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of each nation's customers, rendered as text; some notes have no line, some lines no note or more lines."""
    k = F.col("c_custkey")
    number = F.replace(F.col("c_acctbal").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
    note = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("\n:86:?20note ?21"), k, F.when(k % 5 == 0, "\nmore").otherwise("")))
    line = F.concat(F.lit(":61:2401150116"), F.when(k % 4 == 0, "RC").when(k % 2 == 0, "C").otherwise("D"), number, F.lit("NTRFREF"), k, F.when(k % 7 == 0, "//BANK").otherwise(""), note)
    lines = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_nationkey", "c_custkey", line.alias("line"))
    # runs of keys are joined first, so that a statement is put together from few long texts
    joined = lambda key, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: x[text]), "\n")
    runs = lines.groupBy("c_nationkey", F.floor(k / 1000).alias("run")).agg(joined("c_custkey", "line").alias("lines"))
    whole = runs.groupBy("c_nationkey").agg(joined("run", "lines").alias("lines"))
    text = F.concat(
        F.lit(":20:ST"), "c_nationkey", F.lit("\r\n:25:ACC"), "c_nationkey", F.lit("\n:28C:1/1\n:60F:C240101EUR12,5\n:86:of the head\n"), "lines", F.lit("\n:61:odd\n:62M:D240131EUR7,\n-"),
    )
    return whole.select(F.col("c_nationkey").cast("long").alias("statement_id"), text.alias("message"))


_NOTE = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '?20note ?21' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || 'more' ELSE '' END END"
_ENTRIES = f"""SELECT c_nationkey, 'EUR' AS currency, '240115' AS value_date, '0116' AS entry_date, CASE WHEN c_custkey % 4 = 0 THEN 'RC' WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'D' END AS mark, CAST(CAST(c_acctbal AS DECIMAL(20,2)) AS DOUBLE) AS amount, 'NTRF' AS kind, 'REF' || c_custkey AS customer_ref,
    CASE WHEN c_custkey % 7 = 0 THEN 'BANK' END AS bank_ref, {{note}} AS note FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT DISTINCT c_nationkey, 'EUR', NULL, NULL, NULL, NULL, NULL, NULL, NULL, x FROM customer, (VALUES (''), ('of the head')) v(x) WHERE c_acctbal >= 0"""
_STRUCTURED = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'note ' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || 'more' ELSE '' END END"


@query("SELECT 'ST' || c_nationkey AS reference, 'ACC' || c_nationkey AS account, * EXCLUDE (c_nationkey) FROM (" + _ENTRIES.format(note=_NOTE) + ")")
def mt940_parse(spark, sf_dir):
    """Statement lines with their notes; a note without a line has a row, as has a line that cannot be read."""
    return mt940.parse(_statements(spark, sf_dir)).drop("statement_id", "number", "line", "details")


@query("SELECT c_nationkey AS statement, note FROM (" + _ENTRIES.format(note=_STRUCTURED) + ")")
def mt940_structured(spark, sf_dir):
    """Structured notes: the parts between two-digit codes."""
    return mt940.parse(_statements(spark, sf_dir), "structured").select(F.col("statement_id").cast("int").alias("statement"), "note")


@query("SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS statement_id, 'ST' || c_nationkey AS reference, 'ACC' || c_nationkey AS account, '1/1' AS number, 'C' AS opening_mark, '240101' AS opening_date, 'EUR' AS opening_currency, 12.5::DOUBLE AS opening_amount, 'D' AS closing_mark, '240131' AS closing_date, 'EUR' AS closing_currency, 7.0::DOUBLE AS closing_amount FROM customer WHERE c_acctbal >= 0")
def mt940_balances(spark, sf_dir):
    return mt940.balances(_statements(spark, sf_dir))


@query("SELECT reference, count(*) AS n, sum(amount) AS total FROM (SELECT 'ST' || c_nationkey AS reference, amount FROM (" + _ENTRIES.format(note=_NOTE) + ")) WHERE amount IS NOT NULL GROUP BY reference")
def scan_mt940(spark, sf_dir):
    """Statement files polled from a folder: the first poll reads them all, a second one nothing."""
    folder = shared(spark, "mt940")
    _statements(spark, sf_dir).select("statement_id", "message").write.partitionBy("statement_id").text(folder, lineSep="\n")
    source = connectors.create("mt940", {"tenant_id": "T-1", "connector_id": "K", "path": folder})
    raw = source.fetch(spark)
    again = connectors.create("mt940", {"tenant_id": "T-1", "connector_id": "K", "path": folder, "seen": source.checkpoint()}).fetch(spark)
    read = F.from_json("payload", "amount decimal(20,4), customer_ref string")
    rows = raw.unionAll(again).select(read.alias("p")).where("p.amount IS NOT NULL")
    refs = table(spark, sf_dir, "customer").select(F.concat(F.lit("REF"), "c_custkey").alias("ref"), F.concat(F.lit("ST"), "c_nationkey").alias("reference"))
    out = rows.join(refs, F.col("p.customer_ref") == F.col("ref")).groupBy("reference").agg(F.count("*").alias("n"), F.sum("p.amount").cast("double").alias("total"))
    return kept(out, folder)


_REQUESTS = "SELECT event_id AS request_id, ts, CASE WHEN event_id % 23 = 0 THEN 'GET' ELSE 'POST' END AS method, event_id % 17 = 0 AS forged, user_id % 50 AS who FROM events WHERE event_id % 4 = 0"


@query(f"""WITH RECURSIVE q AS ({_REQUESTS}), good AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY ts, request_id) AS place FROM q WHERE method = 'POST' AND NOT forged),
    f AS (SELECT request_id, who, place, ts AS last, true AS fresh FROM good WHERE place = 1 UNION ALL SELECT g.request_id, g.who, g.place, CASE WHEN g.ts - f.last >= INTERVAL 10 MINUTE THEN g.ts ELSE f.last END, g.ts - f.last >= INTERVAL 10 MINUTE FROM f JOIN good g ON g.who = f.who AND g.place = f.place + 1)
    SELECT q.request_id, CASE WHEN method <> 'POST' THEN 405 WHEN forged THEN 401 WHEN NOT fresh THEN 200 WHEN row_number() OVER (PARTITION BY fresh ORDER BY ts, request_id) > 1000 THEN 503 ELSE 202 END AS status FROM q LEFT JOIN f USING (request_id)""")
def webhook_receive(spark, sf_dir):
    """Requests at the receiver: wrong methods, forged signatures, deliveries that come again within ten minutes."""
    from ledgerloom.functions.scalar import hmac_sha256

    e = F.col("event_id")
    body = F.concat(F.lit("who "), F.col("user_id") % 50)
    signature = F.when(e % 17 == 0, F.lit("00")).otherwise(hmac_sha256(F.lit("k"), body))
    requests = table(spark, sf_dir, "events").where(e % 4 == 0).select(e.alias("request_id"), F.col("ts").cast("timestamp").alias("at"), F.when(e % 23 == 0, "GET").otherwise("POST").alias("method"), F.lit(None).cast("string").alias("delivery_id"), signature.alias("signature"), body.alias("body"))
    return connectors.received(requests, "generic-hmac-sha256", "k").select("request_id", "status")


# ---------------------------------------------------------------- streams
@query("SELECT event_id, sha256(CAST(event_id AS VARCHAR) || chr(0) || props) AS delivery_key FROM events")
def stream_dedup(spark, sf_dir):
    """Deliveries that all come twice, streamed to one of each."""
    from ledgerloom.operators.notify import delivery_key

    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), delivery_key(F.col("event_id").cast("string"), F.col("props")).alias("delivery_key"))
    return jobs.dedup(events.unionAll(events)).select("event_id", "delivery_key")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(20,4)))::DOUBLE AS total FROM events GROUP BY ALL")
def stream_match_rate(spark, sf_dir):
    """Counts and sums by day, added up from the partial rows of a stream's batches."""
    events = table(spark, sf_dir, "events").repartition(4)
    return jobs.incremental(events, ["event_type", F.to_date("ts").alias("day")], {"n": "count(*)", "total": "sum(CAST(value AS DECIMAL(20,4)))"})


#: A rule that a stream can only satisfy one way: references are unique.
BY_REFERENCE = """
rule:
  name: reference and date
  match_cardinality: ONE_TO_ONE
  keys:
    - {field: tenant_id}
    - {field: currency}
    - {field: reference}
    - {field: value_date, tolerance: {type: date_window, days: 1}}
  scoring:
    - {field: reference, method: exact, weight: 0.5}
    - {field: base_amount, method: numeric_closeness, weight: 0.5}
  thresholds: {auto_match: 0.9, suggest: 0.5}
  execution: {priority: 1, mode: [streaming]}
"""


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both ledgers as they arrive: by date, targets after sources."""
    s, t = ledgers(spark, sf_dir)
    both = s.withColumn("late", F.lit(0)).unionByName(t.withColumn("late", F.lit(1)))
    return both.withColumn("arrival", F.unix_date("value_date") * 2 + F.col("late"))


@query("SELECT t.id, s.id AS other_id, 1.0::DOUBLE AS score, 'reference and date' AS rule, 'AUTO_MATCHED_STREAMING' AS status FROM src s JOIN tgt t ON s.ord = t.ord WHERE s.reference = t.reference AND abs(s.base_amount - t.base_amount) <= 0.01", ledgers=True)
def stream_match(spark, sf_dir):
    """Arriving records matched with a pool by a rule: here every one has one partner at most, which has come before."""
    return jobs.pool_match(_arriving(spark, sf_dir), [rules.parse(BY_REFERENCE), rules.parse(rules.REFERENCE_ONLY)])


@query("SELECT user_id % 10 AS k, count(*) AS n, count(*) AS events FROM events GROUP BY 1")
def persist_and_emit(spark, sf_dir):
    """A stream whose batches write rows and their events together; both tables have all of them."""
    folder = shared(spark, "pair")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id").repartition(3)
    stream, source = jobs.stream_of(rows)
    split = lambda batch: {"rows": batch, "outbox": batch.select("event_id", F.lit("transaction.ingested").alias("event_type"))}
    tables.persist_stream(stream, folder, split).awaitTermination()
    kept_rows, events = (tables.read_batches(spark, folder, n) for n in ("rows", "outbox"))
    both = kept_rows.join(events.select("event_id", "event_type"), "event_id")
    out = both.groupBy((F.col("user_id") % 10).alias("k")).agg(F.count("*").alias("n"), F.count("event_type").alias("events"))
    out = kept(out, folder)
    delete_folder(spark, source)
    return out
