"""Validation of normalized records: the schema's checks and a tenant's business rules.

A record's failures are all collected, each as ``field: reason``. Business rules are documents with a ``rule`` name and
its parameters; a name that nobody has registered or parameters that make no sense are failures of every record, never skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import ISO_4217

#: A rule's reason where it is violated, else null; of the parameters and the record's columns.
BusinessRule = Callable[[dict], Column]


def schema_failures() -> list[Column]:
    """The reasons of the fields that every record needs."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [
        F.when(empty("currency"), "currency: required field is empty").when(~F.col("currency").isin(*ISO_4217), F.concat(F.lit("currency: not a known code: "), "currency")),
        F.when(F.col("value_date").isNull(), "value_date: required field is missing"),
        F.when(empty("side"), "side: required field is empty"),
    ]


def amount_sign(parameters: dict) -> Column:
    """Amounts of one side must not be negative, unless ``allow_negative``; the other side is not concerned."""
    bad = (F.col("side") == parameters["side"]) & (F.col("amount") < 0)
    return F.when(bad & F.lit(not parameters.get("allow_negative", False)), F.concat(F.lit(f"amount_sign: negative amount on the {parameters['side']} side: "), F.col("amount").cast("string")))


def account_allowlist(parameters: dict) -> Column:
    """Only the listed accounts may have records; a list of none allows none."""
    listed = [str(a) for a in parameters["allowed_account_ids"]]
    return F.when(~F.coalesce(F.col("account_id").isin(*listed) if listed else F.lit(False), F.lit(False)), F.concat(F.lit("account_allowlist: account is not in the list: "), F.coalesce("account_id", F.lit(""))))


RULES: dict[str, BusinessRule] = {"amount_sign": amount_sign, "account_allowlist": account_allowlist}


def register(name: str, rule: BusinessRule) -> None:
    """Add a rule, or put one in the place of another."""
    RULES[name] = rule


def business_failures(rules: list[str | dict]) -> list[Column]:
    """The reasons of configured rules, in their order."""
    out = []
    for raw in rules:
        try:
            parameters = json.loads(raw) if isinstance(raw, str) else raw
            name = parameters["rule"]
        except (ValueError, KeyError, TypeError) as e:
            out.append(F.lit(f"business_rule: invalid rule: {type(e).__name__}"))
            continue
        if name not in RULES:
            out.append(F.lit(f'business_rule: unknown rule "{name}"'))
            continue
        try:
            reason = RULES[name](parameters)
        except (KeyError, TypeError, ValueError) as e:
            out.append(F.lit(f"{name}: invalid parameters: {type(e).__name__}"))
            continue
        out.append(F.when(reason.isNotNull(), F.concat(F.lit(f"{name}: "), reason)))
    return out


def failures(rules: list[str | dict] | None = None) -> Column:
    """All failures of a record, in order."""
    return F.array_compact(F.array(*schema_failures(), *business_failures(rules or [])))


def validate(records: DataFrame, rules: list[str | dict] | None = None) -> DataFrame:
    """``records`` whose ``reason``, where there was none, names all failures."""
    rows = records.withColumn("__failures", F.explode(F.array(failures(rules))))
    reason = F.when(F.size("__failures") > 0, F.concat(F.lit("validation failed: "), F.array_join("__failures", "; ")))
    return rows.withColumn("reason", F.coalesce("reason", reason)).drop("__failures")
