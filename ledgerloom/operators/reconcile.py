"""Batch results against a stream's provisional ones, and the review of suggested matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.matching import assign


def overlaps(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """``batch_ord, stream_ord, shared``: pairs of results that share transactions, and how many.

    Both have (ord, ids), a distinct list of transaction ids; they meet by each id.
    """
    b = batch.select(F.col("ord").alias("batch_ord"), F.explode(F.array_distinct("ids")).alias("id"))
    s = stream.select(F.col("ord").alias("stream_ord"), F.explode(F.array_distinct("ids")).alias("id"))
    return b.join(s, "id").groupBy("batch_ord", "stream_ord").agg(F.count("*").alias("shared"))


def reconcile(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """``stream_ord, batch_ord, outcome, reason`` for each of the stream's results.

    Batch results in order each take the first of the stream's results that shares a transaction and is not
    taken. Equal sets confirm the stream's result; others, and results that no batch result takes, are variances. A batch
    result without a partner has no row: a stream need not see everything.
    """
    edges = overlaps(batch, stream).select(
        F.col("batch_ord").alias("src_ord"), F.col("batch_ord").cast("string").alias("src_id"), F.col("stream_ord").alias("tgt_ord"), F.col("stream_ord").cast("string").alias("tgt_id"),
        F.lit(1.0).alias("score"), F.array().cast("array<bigint>").alias("ranks"),
    )
    pairs = assign(edges).select(F.col("src_ord").alias("batch_ord"), F.col("tgt_ord").alias("stream_ord"))
    sets = lambda side, name: side.select(F.col("ord").alias(f"{name}_ord"), F.array_sort(F.array_distinct("ids")).alias(f"{name}_ids"))
    met = sets(stream, "stream").join(pairs, "stream_ord", "left").join(sets(batch, "batch"), "batch_ord", "left")
    same = F.col("stream_ids") == F.col("batch_ids")
    return met.select(
        "stream_ord", "batch_ord", F.when(same, "AUTO_MATCHED_CONFIRMED").otherwise("RECONCILIATION_VARIANCE").alias("outcome"),
        F.when(F.col("batch_ord").isNull(), "no_confirming_match_found").when(~same, "different_transactions").alias("reason"), "stream_ids", "batch_ids",
    )


def confirmations(outcomes: DataFrame, confirmed_at: Column) -> DataFrame:
    """The events of confirmed results."""
    payload = F.to_json(F.struct(F.col("stream_ord").alias("match_result_id"), confirmed_at.alias("confirmed_at")))
    return outcomes.where("outcome = 'AUTO_MATCHED_CONFIRMED'").select(F.col("stream_ord").alias("aggregate_id"), F.lit("match.auto_confirmed").alias("event_type"), F.lit("case.events.default").alias("topic"), payload.alias("payload"))


def variances(outcomes: DataFrame) -> DataFrame:
    """A break for each variance, with what either side said."""
    said = F.struct(F.col("stream_ids").alias("streaming_transaction_ids"), F.col("batch_ids").alias("batch_transaction_ids"), F.col("reason").alias("batch_outcome"))
    return outcomes.where("outcome = 'RECONCILIATION_VARIANCE'").select(F.col("stream_ord").alias("result"), F.lit("RECONCILIATION_VARIANCE").alias("break_type"), F.col("stream_ids").alias("transaction_ids"), F.to_json(said).alias("payload"))


# ---------------------------------------------------------------- review
def nested(results: DataFrame, lines: DataFrame) -> DataFrame:
    """``result_id, status, source_ids, target_ids``: results with their lines gathered by side."""
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("transaction_id"))))
    return results.join(lines.groupBy("result_id").agg(of("SOURCE").alias("source_ids"), of("TARGET").alias("target_ids")), "result_id").select("result_id", "status", "score", "source_ids", "target_ids")


def review(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """``result_id, decision, succeeded, status`` for each decision (result_id, decision of CONFIRM or REJECT, actor).

    A decision fails on its own (``succeeded`` false) if its result does not exist or is not SUGGESTED, if it has no actor or
    if it is an odd one; the others go through. Of several on one result the first by actor counts.
    """
    first = decisions.groupBy("result_id").agg(F.min(F.struct("actor", "decision")).alias("first"))
    found = decisions.join(first, "result_id").join(results.select("result_id", F.col("status").alias("was")), "result_id", "left")
    fine = F.coalesce((F.col("was") == "SUGGESTED") & F.col("decision").isin("CONFIRM", "REJECT") & (F.col("actor") != "") & (F.struct("actor", "decision") == F.col("first")), F.lit(False))
    status = F.when(fine & (F.col("decision") == "CONFIRM"), "CONFIRMED").when(fine, "REJECTED").otherwise(F.col("was"))
    return found.select("result_id", "decision", "actor", fine.alias("succeeded"), status.alias("status"))


def reviewed_transactions(reviewed: DataFrame, lines: DataFrame) -> DataFrame:
    """``transaction_id, status`` of the transactions that a decision has moved."""
    moved = reviewed.where("succeeded").join(lines, "result_id")
    return moved.select("transaction_id", F.when(F.col("decision") == "CONFIRM", "MATCHED").otherwise("UNMATCHED").alias("status"))


def rejected_breaks(reviewed: DataFrame, lines: DataFrame) -> DataFrame:
    """One break over all transactions of each rejected result, with the amount of its first line."""
    moved = reviewed.where("succeeded AND decision = 'REJECT'").join(lines, "result_id")
    held = F.array_sort(F.collect_list(F.struct("side", "transaction_id", "allocated_amount")))
    out = moved.groupBy("result_id").agg(held.alias("l"))
    return out.select("result_id", F.lit("UNMATCHED").alias("break_type"), F.col("l.transaction_id").alias("transaction_ids"), F.element_at("l", 1).getField("allocated_amount").alias("amount_at_risk"))


# ---------------------------------------------------------------- rules
# Fixed value: the moves that a rule's status may make.
RULE_MOVES = {"DRAFT": ("ACTIVE", "ARCHIVED"), "ACTIVE": ("ARCHIVED",)}


def activate(rules: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules after requests (rule_id, approver) for activation, and each request's outcome.

    Rules have (id, tenant_id, source_account, target_account, name, version, status, created_by). A request fails without an approver, for an unknown rule,
    for one that is not a DRAFT, or if the approver has written the rule. An activated rule archives the active rules of
    its name on its pair of accounts; of several requests on one pair and name the newest version stays active.
    """
    pair = ["tenant_id", "source_account", "target_account", "name"]
    asked = requests.join(rules.withColumnRenamed("id", "rule_id"), "rule_id", "left")
    reason = (
        F.when(F.coalesce("approver", F.lit("")) == "", "approved_by must be set")
        .when(F.col("status").isNull(), "no such rule")
        .when(F.col("approver") == F.col("created_by"), "the maker may not approve")
        .when(F.col("status") != "DRAFT", F.concat(F.lit("no move from "), "status"))
    )
    outcome = asked.select("rule_id", "approver", reason.isNull().alias("succeeded"), reason.alias("reason"))
    new = asked.where(reason.isNull()).groupBy(*pair).agg(F.max("version").alias("newest"), F.collect_set("rule_id").alias("activated"))
    held = rules.join(new, pair, "left")
    mine = F.array_contains("activated", F.col("id"))
    status = F.when(mine & (F.col("version") == F.col("newest")), "ACTIVE").when(F.col("newest").isNotNull() & ((F.col("status") == "ACTIVE") | mine), "ARCHIVED").otherwise(F.col("status"))
    return held.withColumn("status", status).select(*rules.columns), outcome


def rules_for_pair(rules: DataFrame, source_account: str, target_account: str) -> DataFrame:
    """The active rules of a pair of accounts in both directions (a rule of both counts twice), by priority."""
    one = lambda a, b: rules.where((F.col("status") == "ACTIVE") & (F.col("source_account") == a) & (F.col("target_account") == b))
    return one(source_account, target_account).unionAll(one(target_account, source_account)).orderBy("priority", "version", "id")
