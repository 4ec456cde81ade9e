"""Ingestion functions, mapping, normalization, validation, deduplication, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import ingest, mapping, validation
from ledgerloom.plans import canonical as C
from ledgerloom.queries.matching import ledgers
from ledgerloom.queries.registry import query
from ledgerloom.session import table
from ledgerloom.sinks import tables

raw, RAW = C.raw, C.RAW_SQL
_DECIMAL = "TRY_CAST(replace(trim(amount), ',', '.') AS DECIMAL(20,2))"
_CODE = "CASE WHEN upper(trim(currency)) IN ('USD','EUR','JPY') THEN upper(trim(currency)) END"
_SIGNED = f"CASE WHEN upper(trim(mark)) LIKE 'D%' THEN -({_DECIMAL}) WHEN upper(trim(mark)) LIKE 'C%' THEN {_DECIMAL} END"
_PARSED = "TRY_CAST(CASE WHEN date[1:2] >= '69' THEN '19' ELSE '20' END || date[1:2] || '-' || date[3:4] || '-' || date[5:6] AS DATE)"


# ---------------------------------------------------------------- functions
@query(f"WITH {RAW} SELECT k, CAST({_DECIMAL} AS DOUBLE) AS value FROM raw")
def fn_parse_decimal(spark, sf_dir):
    return raw(spark, sf_dir).select("k", scalar.parse_decimal(F.col("amount")).alias("value"))


@query(f"WITH {RAW} SELECT k, CAST({_SIGNED} AS DOUBLE) AS value, CAST(CASE upper(trim(mark)) WHEN 'RC' THEN -({_DECIMAL}) ELSE {_SIGNED} END AS DOUBLE) AS with_reversals FROM raw")
def fn_apply_sign(spark, sf_dir):
    """Marks as they are read, and with the reversal marks that the plain form refuses."""
    amount = scalar.parse_decimal(F.col("amount"))
    return raw(spark, sf_dir).select("k", scalar.apply_sign(amount, F.col("mark")).alias("value"), scalar.apply_sign(amount, F.col("mark"), reversals=True).alias("with_reversals"))


@query(f"WITH {RAW} SELECT k, upper(note) AS value FROM raw")
def fn_upper(spark, sf_dir):
    return raw(spark, sf_dir).select("k", F.upper("note").alias("value"))


@query(f"WITH {RAW} SELECT k, trim(mark) AS value FROM raw")
def fn_trim(spark, sf_dir):
    return raw(spark, sf_dir).select("k", scalar.trim(F.concat(F.lit("\t "), "mark", F.lit(" \n"))).alias("value"))


@query(f"WITH {RAW} SELECT k, {_CODE} AS value FROM raw")
def fn_iso4217(spark, sf_dir):
    return raw(spark, sf_dir).select("k", scalar.iso4217(F.col("currency")).alias("value"))


@query(f"WITH {RAW} SELECT k, {_PARSED} AS value, make_timestamp(1999, 12, 31, CAST(k % 24 AS BIGINT), CAST(k % 60 AS BIGINT), 7.0) AS time FROM raw")
def fn_parse_date(spark, sf_dir):
    """Dates of two-digit years, and times of day."""
    k = F.col("k")
    text = F.concat(F.lit("31.12.1999 "), F.lpad(k % 24, 2, "0"), F.lit(":"), F.lpad(k % 60, 2, "0"), F.lit(":07"))
    return raw(spark, sf_dir).select("k", scalar.parse_date(F.col("date"), "YYMMDD").alias("value"), scalar.parse_timestamp(text, "DD.MM.YYYY HH:mm:ss").cast("timestamp_ntz").alias("time"))


@query(f"WITH {RAW} SELECT k, nullif(regexp_extract(note, '/REF([0-9]+)/', 1), '') AS value FROM raw")
def fn_extract_regex(spark, sf_dir):
    return raw(spark, sf_dir).select("k", scalar.extract_regex(F.col("note"), "/REF([0-9]+)/").alias("value"))


@query(f"WITH {RAW} SELECT k, 'tok_' || sha256('key' || chr(0) || note)[1:32] AS value, note AS again FROM raw")
def fn_tokenize(spark, sf_dir):
    """Tokens, and the values found again in the table of tokens."""
    rows = raw(spark, sf_dir).select("k", scalar.tokenize(F.col("note"), "key").alias("value"), "note")
    vault = rows.groupBy("value").agg(F.min("note").alias("again"))
    return rows.select("k", "value").join(vault, "value")


# ---------------------------------------------------------------- parse and map
@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query(f"WITH {RAW} SELECT k, CASE WHEN NOT broken THEN amount END AS amount, broken OR date IS NULL AS date_missing, true AS below_missing FROM raw")
def field_path(spark, sf_dir):
    """Values at dotted paths; any missing part makes the whole path missing."""
    at = lambda path: mapping.lookup(F.col("payload"), path)
    return raw(spark, sf_dir).select("k", at("tx.amount").alias("amount"), at("date").isNull().alias("date_missing"), at("tx.amount.cents").isNull().alias("below_missing"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records mapped by the specification."""
    rows = raw(spark, sf_dir).select("k", "tenant_id", "account_id", "connector_id", "payload")
    return mapping.apply(rows, mapping.parse(C.MAPPING))


_BAD = lambda target, what: f"'field_mapping: target \"transaction.{target}\": {what}'"
MAPPED = f"""{RAW}, parsed AS (SELECT k, tenant_id, account_id, connector_id, broken, note, CAST({_SIGNED} AS DECIMAL(20,4)) AS amount, {_CODE} AS currency, {_PARSED} AS value_date, {_DECIMAL} AS plain, date FROM raw),
    mapped AS (SELECT *, CASE WHEN broken THEN 'format_parse: not JSON' WHEN plain IS NULL THEN {_BAD("amount", 'transform "parse_decimal" failed')} WHEN amount IS NULL THEN {_BAD("amount", 'transform "apply_sign_from" failed')}
        WHEN currency IS NULL THEN {_BAD("currency", 'transform "iso4217_validate" failed')} WHEN date IS NULL THEN {_BAD("value_date", 'field "date" not found')} WHEN value_date IS NULL THEN {_BAD("value_date", 'transform "parse_date" failed')} END AS reason FROM parsed)"""
RATES = f"{C.FX_SQL}, rates AS (SELECT tenant_id, from_currency, to_currency, arg_max(rate, written) AS rate FROM fx GROUP BY ALL)"
NORMAL = f"""{MAPPED}, {RATES}, {C.ACCOUNTS_SQL}, joined AS (SELECT m.* EXCLUDE (reason), reason AS old, account_currency, CASE WHEN currency = account_currency THEN 1 ELSE rate END AS fx_rate
        FROM mapped m LEFT JOIN accounts a USING (tenant_id, account_id) LEFT JOIN rates r ON r.tenant_id = m.tenant_id AND from_currency = currency AND to_currency = account_currency),
    normal AS (SELECT *, CASE WHEN old IS NOT NULL THEN old WHEN account_currency IS NULL THEN 'normalization: no such account' WHEN fx_rate IS NULL THEN 'normalization: no fx rate ' || currency || '->' || account_currency END AS reason,
        CAST(amount * fx_rate AS DECIMAL(20,4)) AS base_amount, value_date AS booking_date, CASE WHEN amount < 0 THEN 'DEBIT' WHEN amount >= 0 THEN 'CREDIT' END AS side FROM joined)"""


def rates(spark: SparkSession) -> DataFrame:
    return tables.upsert_latest(C.fx_writes(spark), ("tenant_id", "from_currency", "to_currency"), "written").drop("written")


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped records in their accounts' currencies, with a reason where they cannot be."""
    return mapping.normalize(mapped(spark, sf_dir), C.accounts(spark), rates(spark))


#: Rules of the tenants: no negative debits for the first, some accounts only, a name that nobody knows.
BUSINESS = [{"rule": "amount_sign", "side": "DEBIT", "allow_negative": False}, {"rule": "account_allowlist", "allowed_account_ids": [f"ACC-{i}" for i in range(1, 11)]}]


@query(f"WITH {MAPPED} SELECT k, CASE WHEN NOT broken THEN amount END AS amount, CASE WHEN NOT broken THEN currency END AS currency, CASE WHEN NOT broken THEN value_date END AS value_date, reason FROM mapped", money=("amount",))
def map_fields(spark, sf_dir):
    """Fields by a specification in YAML, with the first error of each record."""
    return mapped(spark, sf_dir).select("k", F.col("amount").cast("decimal(20,4)"), "currency", "value_date", "reason")


@query(f"WITH {C.FX_SQL} SELECT tenant_id, from_currency, to_currency, arg_max(rate, written) AS rate FROM fx GROUP BY ALL", money=("rate",))
def fx_latest(spark, sf_dir):
    return rates(spark)


_SHOWN = "k, amount, currency, value_date, booking_date, base_amount, CAST(fx_rate AS DECIMAL(20,10)) AS fx_rate, side"


@query(f"WITH {NORMAL} SELECT {_SHOWN} FROM normal WHERE reason IS NULL", money=("amount", "base_amount", "fx_rate"))
def normalize_fx(spark, sf_dir):
    """Records in their accounts' currencies; those without an account or a rate are not among them."""
    return normal(spark, sf_dir).where("reason IS NULL").select("k", "amount", "currency", "value_date", "booking_date", "base_amount", "fx_rate", "side")


@query(f"WITH {NORMAL} SELECT account_currency, sum(base_amount)::DOUBLE AS total FROM normal WHERE reason IS NULL GROUP BY ALL")
def fx_convert(spark, sf_dir):
    return normal(spark, sf_dir).where("reason IS NULL").groupBy("account_currency").agg(F.sum("base_amount").alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 3 = user_id % 3 THEN CAST(event_id + user_id AS DOUBLE) + 0.25 END AS total, CAST(user_id + 0.5 AS DOUBLE) AS amount FROM events")
def money_add(spark, sf_dir):
    """Sums of amounts of one currency, none of two; amounts of units and billionths."""
    e, u = F.col("event_id"), F.col("user_id")
    a, b = scalar.money(e, F.lit(250_000_000)), scalar.money(u, F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", scalar.add_money(a, e % 3, b, u % 3).alias("total"), scalar.money(u, F.lit(500_000_000)).alias("amount"))


# ---------------------------------------------------------------- validate
_FIELDS = "SELECT k, CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'ZZZ' ELSE 'USD' END AS currency, CASE WHEN k % 5 > 0 THEN DATE '2024-01-01' END AS value_date, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'DEBIT' ELSE 'CREDIT' END AS side, CAST(k % 11 - 5 AS DECIMAL(20,4)) AS amount, 'ACC-' || (k % 13) AS account_id FROM raw"
_SCHEMA = "[CASE WHEN currency = '' THEN 'currency: required field is empty' WHEN currency NOT IN ('USD') THEN 'currency: not a known code: ' || currency END, CASE WHEN value_date IS NULL THEN 'value_date: required field is missing' END, CASE WHEN side = '' THEN 'side: required field is empty' END"
_SIGN = "CASE WHEN side = 'DEBIT' AND amount < 0 THEN 'amount_sign: negative amount on the DEBIT side: ' || amount END"
_LIST = "CASE WHEN account_id IN ('ACC-0', 'ACC-11', 'ACC-12') THEN 'account_allowlist: account is not in the list: ' || account_id END"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized fields with all kinds of faults."""
    k = F.col("k")
    return raw(spark, sf_dir).select(
        "k", F.when(k % 7 == 0, "").when(k % 7 == 1, "ZZZ").otherwise("USD").alias("currency"), F.when(k % 5 > 0, F.lit("2024-01-01").cast("date")).alias("value_date"), F.when(k % 4 == 0, "").when(k % 4 == 1, "DEBIT").otherwise("CREDIT").alias("side"),
        (k % 11 - 5).cast("decimal(20,4)").alias("amount"), F.concat(F.lit("ACC-"), k % 13).alias("account_id"), F.lit(None).cast("string").alias("reason"),
    )


@query(f"WITH {RAW}, f AS ({_FIELDS}) SELECT k, array_to_string(list_filter({_SCHEMA}], lambda x: x IS NOT NULL), '|') AS failures FROM f")
def validate_schema(spark, sf_dir):
    return fields(spark, sf_dir).select("k", F.array_join(validation.failures(), "|").alias("failures"))


@query(f"WITH {RAW}, f AS ({_FIELDS}), g AS (SELECT k, list_filter({_SCHEMA}, 'amount_sign: ' || {_SIGN}, 'account_allowlist: ' || {_LIST}, 'business_rule: unknown rule \"odd\"', 'amount_sign: invalid parameters: KeyError'], lambda x: x IS NOT NULL) AS l FROM f) SELECT k, 'validation failed: ' || array_to_string(l, '; ') AS reason FROM g")
def validate_all(spark, sf_dir):
    """All failures of each record; rules that cannot run are failures too."""
    return validation.validate(fields(spark, sf_dir), [*BUSINESS, '{"rule": "odd"}', {"rule": "amount_sign"}]).select("k", "reason")


@query(f"WITH {RAW}, f AS ({_FIELDS}) SELECT k, {_SIGN} AS reason, CAST(NULL AS VARCHAR) AS lenient, CASE WHEN side = 'CREDIT' AND amount < 0 THEN 'amount_sign: negative amount on the CREDIT side: ' || amount END AS credit FROM f")
def rule_amount_sign(spark, sf_dir):
    """A rule for debits, one that lets negative amounts pass, one for credits."""
    rule = lambda side, lenient=False: validation.amount_sign({"side": side, "allow_negative": lenient})
    return fields(spark, sf_dir).select("k", rule("DEBIT").alias("reason"), rule("DEBIT", True).alias("lenient"), rule("CREDIT").alias("credit"))


@query(f"WITH {RAW}, f AS ({_FIELDS}) SELECT k, {_LIST} AS reason, 'account_allowlist: account is not in the list: ' || account_id AS none_allowed FROM f")
def rule_allowlist(spark, sf_dir):
    none = validation.account_allowlist({"allowed_account_ids": []})
    return fields(spark, sf_dir).select("k", validation.account_allowlist(BUSINESS[1]).alias("reason"), none.alias("none_allowed"))


# ---------------------------------------------------------------- the whole pipeline
_STAGED = f"""{NORMAL}, staged AS (SELECT *, coalesce(reason, CASE WHEN {_SIGN} IS NOT NULL OR {_LIST} IS NOT NULL THEN 'validation failed: ' || array_to_string(list_filter(['amount_sign: ' || {_SIGN}, 'account_allowlist: ' || {_LIST}], lambda x: x IS NOT NULL), '; ') END) AS final FROM normal),
    keyed AS (SELECT *, regexp_extract(note, '/REF([0-9]+)/', 1) AS external_ref, sha256(tenant_id || chr(0) || connector_id || chr(0) || regexp_extract(note, '/REF([0-9]+)/', 1) || chr(0) || 'B-1') AS idempotency_key FROM staged WHERE final IS NULL),
    existing AS (SELECT DISTINCT idempotency_key FROM keyed WHERE k % 6 = 0),
    fresh AS (SELECT * FROM keyed WHERE idempotency_key NOT IN (SELECT idempotency_key FROM existing) QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY k) = 1)"""


def _ran(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = raw(spark, sf_dir).select(F.col("k").alias("record"), "tenant_id", "connector_id", "account_id", F.lit("B-1").alias("batch_id"), "payload")
    spec, known = mapping.parse(C.MAPPING), C.accounts(spark)
    before = ingest.run(rows, spec, known, rates(spark), BUSINESS)[0]
    # the keys that an earlier run has left: those of every sixth record, whichever record of a key comes first
    good = ingest.stages(rows, spec, known, rates(spark), BUSINESS).where("reason IS NULL AND record % 6 = 0")
    keys = good.select(ingest.idempotency_key(F.col("tenant_id"), F.col("connector_id"), F.col("reference"), F.col("batch_id")).alias("idempotency_key"))
    existing = before.select("idempotency_key").join(keys, "idempotency_key", "left_semi")
    return ingest.run(rows, spec, known, rates(spark), BUSINESS, existing)


@query(f"WITH {_STAGED} SELECT k AS record, tenant_id, account_id, idempotency_key, external_ref, note AS description, amount, currency, base_amount, CAST(fx_rate AS DECIMAL(20,10)) AS fx_rate, value_date, booking_date, side, 'UNMATCHED' AS status FROM fresh", money=("amount", "base_amount", "fx_rate"))
def canonicalize(spark, sf_dir):
    """Raw records through all stages to canonical transactions, without keys that are known and records of one key."""
    return _ran(spark, sf_dir)[0]


@query(f"WITH {_STAGED} SELECT tenant_id, connector_id, CASE WHEN final LIKE 'validation failed%' THEN 'validation' ELSE split_part(final, ':', 1) END AS stage, final AS reason, count(*) AS n FROM staged WHERE final IS NOT NULL GROUP BY ALL")
def quarantine_split(spark, sf_dir):
    """What went to quarantine, by stage and reason."""
    return _ran(spark, sf_dir)[1].groupBy("tenant_id", "connector_id", "stage", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {MAPPED} SELECT 'not json ' || k AS payload, reason FROM mapped WHERE broken AND tenant_id = 'T-1' AND connector_id = 'K-1' ORDER BY k DESC")
def quarantine_list(spark, sf_dir):
    """One connector's entries that were not JSON, the newest first."""
    rows = mapped(spark, sf_dir).where(F.startswith("reason", F.lit("format_parse")))
    entries = ingest.quarantined(rows).withColumn("created_at", F.regexp_extract("payload", "([0-9]+)$", 1).cast("long"))
    return ingest.quarantine_list(entries, "T-1", "K-1").select("payload", "reason")


@query("SELECT 'T-' || (user_id % 2) AS tenant_id, 'f' || (user_id % 3) AS source_format, max(event_id) AS version FROM events WHERE event_type <> 'error' GROUP BY ALL")
def active_spec(spark, sf_dir):
    """The newest active specification of each tenant and format."""
    u = F.col("user_id")
    specs = table(spark, sf_dir, "events").select(F.concat(F.lit("T-"), u % 2).alias("tenant_id"), F.concat(F.lit("f"), u % 3).alias("source_format"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "DRAFT").otherwise("ACTIVE").alias("status"))
    return mapping.active(specs).select("tenant_id", "source_format", "version")


# ---------------------------------------------------------------- keys
@query("SELECT id, sha256(tenant_id || chr(0) || account_id || chr(0) || reference || chr(0) || 'batch-1') AS key FROM src", ledgers=True)
def idempotency_key(spark, sf_dir):
    return C.source_ledger(spark, sf_dir).select("id", ingest.idempotency_key(F.col("tenant_id"), F.col("account_id"), F.col("reference"), F.lit("batch-1")).alias("key"))


_HASH = "sha256('amount' || chr(0) || regexp_replace(regexp_replace(CAST(base_amount AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || chr(0) || 'counterparty' || chr(0) || account_id || chr(0) || 'currency' || chr(0) || currency || chr(0) || 'description' || chr(0) || reference || chr(0) || 'value_date' || chr(0) || CAST(value_date AS VARCHAR) || chr(0))"
_ledger_hash = lambda: ingest.record_hash("base_amount", "account_id", "currency", "reference", "value_date")


@query(f"SELECT id, {_HASH} AS hash FROM src", ledgers=True)
def record_hash(spark, sf_dir):
    return C.source_ledger(spark, sf_dir).select("id", _ledger_hash().alias("hash"))


@query(f"SELECT id, CASE WHEN ord % 4 = 0 THEN {_HASH} ELSE reference END AS key FROM src", ledgers=True)
def natural_key(spark, sf_dir):
    """A record's reference, or its hash where that is null or empty."""
    k = F.col("ord")
    given = F.when(k % 8 == 0, "").when(k % 4 != 0, F.col("reference"))
    return C.source_ledger(spark, sf_dir).select("id", ingest.natural_key(given, _ledger_hash()).alias("key"))


@query("WITH b AS (SELECT reference AS key, ord, id FROM src UNION ALL SELECT replace(reference, 'X', ''), ord, id FROM tgt), known AS (SELECT reference AS key FROM src WHERE ord % 5 = 0) SELECT key, min(id) AS id FROM b WHERE key NOT IN (SELECT key FROM known) GROUP BY key", ledgers=True)
def dedup_batch(spark, sf_dir):
    """What a batch adds: the first record of each key that is not there yet."""
    s, t = ledgers(spark, sf_dir)
    both = s.select(F.col("reference").alias("key"), "id").unionAll(t.select(F.replace("reference", F.lit("X"), F.lit("")), "id"))
    return ingest.new_only(both, s.where("ord % 5 = 0").select(F.col("reference").alias("key")), "key", "id")


_FILES = "files AS (SELECT doc_id AS file_id, source AS account_id, sha256(coalesce(text, '')) AS checksum FROM documents), seen AS (SELECT DISTINCT account_id, checksum FROM files WHERE file_id % 10 = 3)"
_AGAIN = "(account_id, checksum) IN (SELECT (account_id, checksum) FROM seen) OR file_id > min(file_id) OVER (PARTITION BY account_id, checksum)"


@query(f"WITH {_FILES} SELECT file_id, CASE WHEN {_AGAIN} THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome, CASE WHEN {_AGAIN} THEN 'CORRECTION' ELSE 'ACCEPTED' END AS lenient FROM files")
def reupload_check(spark, sf_dir):
    """Files whose account has had the same content, under either policy."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("account_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    seen = files.where("file_id % 10 = 3")
    lenient = ingest.reuploads(files, seen, "CORRECTION").select("file_id", F.col("outcome").alias("lenient"))
    return ingest.reuploads(files, seen).select("file_id", "outcome").join(lenient, "file_id")


@query("SELECT event_id, props AS opened, CAST(NULL AS VARCHAR) AS wrong_key FROM events")
def aes_roundtrip(spark, sf_dir):
    """Payloads sealed and opened again; with another key they do not open."""
    events = table(spark, sf_dir, "events").select("event_id", tables.encrypted(F.col("props"), F.lit("0123456789abcdef")).alias("sealed"))
    return events.select("event_id", tables.decrypted(F.col("sealed"), F.lit("0123456789abcdef")).alias("opened"), tables.decrypted(F.col("sealed"), F.lit("fedcba9876543210")).alias("wrong_key"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'CLOSED' ELSE event_type END AS status FROM events")
def bulk_update(spark, sf_dir):
    """A status set for many ids at once."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"))
    return tables.update_status(events, events.where("event_id % 4 = 0"), "CLOSED", key="event_id")


@query("SELECT DISTINCT reference AS key, true AS may_exist FROM src WHERE ord % 3 = 0", ledgers=True)
def bloom_check(spark, sf_dir):
    """Keys that were put into a filter: all of them may exist."""
    known = C.source_ledger(spark, sf_dir).where("ord % 3 = 0")
    bits = ingest.bloom_bits(known, "reference", 100_000, 0.001)
    return ingest.may_exist(known, bits, "reference", 100_000, 0.001)
