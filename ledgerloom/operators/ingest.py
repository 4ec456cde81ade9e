"""The ingestion pipeline: parse, map, normalize, validate, deduplicate; what fails goes to quarantine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import mapping, validation


def record_hash(amount: str = "amount", counterparty: str = "counterparty", currency: str = "currency", description: str = "description", value_date: str = "value_date") -> Column:
    """SHA-256 over the names and values of the fields that make a record, in the order of the names; null values are empty."""
    parts = [("amount", scalar.decimal_text(F.col(amount))), ("counterparty", F.col(counterparty)), ("currency", F.col(currency)), ("description", F.col(description)), ("value_date", F.col(value_date).cast("string"))]
    return F.sha2(F.concat(*[x for name, c in parts for x in (F.lit(f"{name}\x00"), F.coalesce(c, F.lit("")), F.lit("\x00"))]), 256)


def natural_key(reference: Column, fallback: Column) -> Column:
    """A record's own reference, or what stands for it where that is null or empty."""
    return F.coalesce(F.nullif(reference, F.lit("")), fallback)


def idempotency_key(tenant: Column, connector: Column, natural: Column, batch: Column) -> Column:
    return scalar.sha_parts(tenant, connector, natural, batch)


def quarantined(records: DataFrame, payload: str = "payload") -> DataFrame:
    """``tenant_id, connector_id, stage, reason, payload`` of the records that have a reason; the stage is the reason's first part."""
    stage = F.when(F.startswith("reason", F.lit("validation failed")), "validation").otherwise(F.substring_index("reason", ":", 1))
    return records.where("reason IS NOT NULL").select("tenant_id", "connector_id", stage.alias("stage"), "reason", F.col(payload).alias("payload"))


def quarantine_list(entries: DataFrame, tenant: str, connector: str) -> DataFrame:
    """One connector's entries, the newest first; ``entries`` has ``created_at``."""
    return entries.where((F.col("tenant_id") == tenant) & (F.col("connector_id") == connector)).orderBy(F.col("created_at").desc())


def first_of_each(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record of each key, the first by ``order``; an aggregate, which combines before its shuffle."""
    kept = records.groupBy(key).agg(F.min_by(F.struct(*[c for c in records.columns if c != key]), order).alias("__r"))
    return kept.select(key, "__r.*").select(*records.columns)


def new_only(records: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key that ``existing`` does not have yet: what an insert that ignores conflicts adds."""
    return first_of_each(records.join(existing.select(key), key, "left_anti"), key, order)


def reuploads(files: DataFrame, seen: DataFrame, policy: str = "REJECT") -> DataFrame:
    """``files`` with ``outcome``: ACCEPTED, or REJECTED or CORRECTION (by ``policy``) where their account had the same content before.

    Files have (file_id, account_id, checksum); earlier ones are in ``seen`` (account_id, checksum) or have a smaller file_id.
    """
    if policy not in ("REJECT", "CORRECTION"):
        raise ValueError(f"policy {policy}")
    first = files.groupBy("account_id", "checksum").agg(F.min("file_id").alias("first"))
    known = seen.select("account_id", "checksum").distinct().withColumn("known", F.lit(True))
    again = F.coalesce("known", F.lit(False)) | (F.col("file_id") > F.col("first"))
    out = files.join(first, ["account_id", "checksum"]).join(known, ["account_id", "checksum"], "left")
    return out.withColumn("outcome", F.when(again, "REJECTED" if policy == "REJECT" else "CORRECTION").otherwise("ACCEPTED")).drop("first", "known")


def stages(raw: DataFrame, spec: mapping.Spec, accounts: DataFrame, rates: DataFrame, rules: list[str | dict] | None = None) -> DataFrame:
    """``raw`` (record, tenant_id, connector_id, account_id, batch_id, payload) through mapping, normalization and validation.

    A record keeps the first stage's reason; later stages leave it alone.
    """
    return validation.validate(mapping.normalize(mapping.apply(raw, spec), accounts, rates), rules)


def run(raw: DataFrame, spec: mapping.Spec, accounts: DataFrame, rates: DataFrame, rules: list[str | dict] | None = None, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The canonical transactions and the quarantine of raw records.

    The idempotency key is that of tenant, connector, natural key and batch; a record whose key is in
    ``existing`` or on an earlier record is dropped.
    """
    done = stages(raw, spec, accounts, rates, rules)
    for c in ("reference", "description"):
        if c not in done.columns:
            done = done.withColumn(c, F.lit(None).cast("string"))
    good = done.where("reason IS NULL").withColumn("natural_key", natural_key(F.col("reference"), record_hash(counterparty="account_id")))
    keyed = good.withColumn("idempotency_key", idempotency_key(F.col("tenant_id"), F.col("connector_id"), F.col("natural_key"), F.col("batch_id")))
    fresh = new_only(keyed, existing, "idempotency_key", "record") if existing is not None else first_of_each(keyed, "idempotency_key", "record")
    return canonical(fresh), quarantined(done)


def canonical(records: DataFrame) -> DataFrame:
    """Transactions as they are stored."""
    return records.select(
        "record", "tenant_id", "account_id", "idempotency_key", F.col("reference").alias("external_ref"), "description", "amount", "currency", "base_amount", "fx_rate", "value_date", "booking_date", "side",
        F.lit("UNMATCHED").alias("status"),
    )


# ---------------------------------------------------------------- a filter before the check for known keys
def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for so many items at a rate of false positives."""
    bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / items * math.log(2)))


def bloom_places(key: Column, items: int, rate: float) -> Column:
    """The places of a key's bits, by two hashes."""
    bits, hashes = bloom_size(items, rate)
    one, two = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit("second")), F.lit(bits))
    return F.array_distinct(F.array(*[F.pmod(one + two * i, F.lit(bits)) for i in range(hashes)]))


def bloom_bits(keys: DataFrame, key: str, items: int = 10_000, rate: float = 0.01) -> DataFrame:
    """The set bits of a filter over ``keys``: a table of places, at most as many as the filter has bits."""
    return keys.select(F.explode(bloom_places(F.col(key), items, rate)).alias("place")).distinct()


def may_exist(records: DataFrame, bits: DataFrame, key: str, items: int = 10_000, rate: float = 0.01) -> DataFrame:
    """``key, may_exist``: false is certain, true wants the check itself. Only a filter of a size set beforehand is ever joined."""
    asked = records.select(F.col(key).alias("key")).distinct().withColumn("places", bloom_places(F.col("key"), items, rate))
    hit = asked.select("key", F.explode("places").alias("place")).join(bits, "place", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    return asked.join(hit, "key", "left").select("key", (F.coalesce("n", F.lit(0)) == F.size("places")).alias("may_exist"))
