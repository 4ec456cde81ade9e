"""Mapping specifications: documents that say how a source's record becomes typed fields, compiled to Columns.

A document has ``source_format``, ``version`` and ``mappings``, each with a target, a source path into the JSON record and an
ordered chain of transforms, written as ``name``, ``name("literal")`` or ``name(path)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalar


@dataclass(frozen=True)
class Call:
    name: str
    argument: str | None = None


@dataclass(frozen=True)
class Field:
    target: str
    source: str
    calls: tuple[str, ...]

    @property
    def column(self) -> str:
        """The target's column: the last part of its path."""
        return self.target.rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Spec:
    source_format: str
    version: int
    fields: tuple[Field, ...]


def parse_call(text: str) -> Call:
    """One entry of a chain; empty brackets stand for no argument."""
    name, bracket, rest = text.strip().partition("(")
    inner = rest[:-1]
    quoted = len(inner) > 1 and inner[0] == inner[-1] == '"'
    body = inner[1:-1] if quoted else inner
    if not (name.isascii() and name.isidentifier()) or bracket and (not rest.endswith(")") or ('"' if quoted else ")") in body):
        raise ValueError(f"not a transform: {text!r}")
    return Call(name, (body if quoted else body.strip()) or None)


def parse(document: str) -> Spec:
    """A specification of a document in YAML or JSON."""
    raw = yaml.safe_load(document)
    fields = tuple(Field(m["target"], m["source"], tuple(m.get("transform") or ())) for m in raw.get("mappings") or ())
    return Spec(raw.get("source_format", ""), int(raw.get("version", 0)), fields)


def lookup(payload: Column, path: str) -> Column:
    """The scalar at a dotted path of a JSON record; null, an error, if any part of the path is missing."""
    return F.get_json_object(payload, "$" + "".join(f"['{p}']" for p in path.split(".")))


def _chain(value: Column, field: Field, payload: Column, secret: str) -> Column:
    """``struct(value, error)``; the error names the first step that had no result, and each step is evaluated once."""
    where = f'field_mapping: target "{field.target}": '
    broken = None
    steps = []
    for text in field.calls:
        try:
            call = parse_call(text)
        except ValueError as e:
            broken = where + str(e)
            break
        if call.name not in scalar.TRANSFORMS:
            broken = where + f'unknown transform "{call.name}"'
            break
        steps.append(call)

    def after(values: list[Column], rest: list[Call]) -> Column:
        if rest:
            call = rest[0]
            argument = [secret] if call.name == "tokenize" else [lookup(payload, call.argument or "") if call.name in scalar.BY_PATH else call.argument] if call.argument is not None else []
            out = scalar.TRANSFORMS[call.name](values[-1], *argument)
            return scalar.bound(out, lambda v: after([*values, v], rest[1:]))
        error = F.when(values[0].isNull(), f'{where}field "{field.source}" not found')
        for call, v in zip(steps, values[1:], strict=True):
            error = error.when(v.isNull(), f'{where}transform "{call.name}" failed')
        return F.struct(values[-1].alias("value"), (error.otherwise(broken) if broken else error).alias("error"))

    return scalar.bound(value, lambda v: after([v], steps))


def apply(records: DataFrame, spec: Spec, payload: str = "payload", secret: str = "key") -> DataFrame:
    """``records`` with a column for each target and ``reason``, the first error in the order of the specification.

    The fields of one record are made by one generator, behind which later filters on the reason do not evaluate them again.
    """
    source = F.col(payload)
    made = F.struct(*[_chain(lookup(source, f.source), f, source, secret).alias(f.column) for f in spec.fields])
    rows = records.withColumn("__made", F.explode(F.array(made)))
    bad = F.when(F.try_parse_json(source).isNull(), "format_parse: not JSON")
    reason = F.coalesce(bad, *[F.col(f"__made.{f.column}.error") for f in spec.fields])
    values = {f.column: F.col(f"__made.{f.column}.value") for f in spec.fields}
    return rows.withColumns({**values, "reason": reason}).drop("__made")


def active(specs: DataFrame) -> DataFrame:
    """The newest ACTIVE specification of each (tenant_id, source_format)."""
    others = [c for c in specs.columns if c not in ("tenant_id", "source_format")]
    newest = specs.where("status = 'ACTIVE'").groupBy("tenant_id", "source_format").agg(F.max_by(F.struct(*others), "version").alias("s"))
    return newest.select("tenant_id", "source_format", "s.*")


def normalize(mapped: DataFrame, accounts: DataFrame, rates: DataFrame) -> DataFrame:
    """Mapped records in their account's currency, with ``base_amount, fx_rate, booking_date, side`` and ``reason``.

    ``accounts`` has (tenant_id, account_id, account_currency), ``rates`` (tenant_id, from_currency, to_currency, rate) with one row for each
    pair. A missing amount, currency, date, account or rate is a reason, unless the record has one. Both tables grow with
    the tenants, so Spark chooses how to join them by their size.
    """
    held = mapped.join(accounts.select("tenant_id", "account_id", "account_currency"), ["tenant_id", "account_id"], "left")
    rate = rates.select("tenant_id", F.col("from_currency").alias("currency"), F.col("to_currency").alias("account_currency"), F.col("rate").alias("fx_rate"))
    out = held.join(rate, ["tenant_id", "currency", "account_currency"], "left").withColumn("fx_rate", F.when(F.col("currency") == F.col("account_currency"), F.lit("1").cast("decimal(20,10)")).otherwise(F.col("fx_rate")))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("amount").isNull(), "normalization: amount missing")
        .when(F.col("currency").isNull(), "normalization: currency missing")
        .when(F.col("value_date").isNull(), "normalization: value_date missing")
        .when(F.col("account_currency").isNull(), "normalization: no such account")
        .when(F.col("fx_rate").isNull(), F.concat(F.lit("normalization: no fx rate "), "currency", F.lit("->"), "account_currency"))
    )
    booked = F.coalesce("booking_date", "value_date") if "booking_date" in mapped.columns else F.col("value_date")
    return out.withColumns({
        "reason": reason, "base_amount": scalar.convert(F.col("amount"), F.col("fx_rate")), "booking_date": booked,
        "amount": F.col("amount").cast("decimal(20,4)"), "side": F.when(F.col("amount") < 0, "DEBIT").when(F.col("amount") >= 0, "CREDIT"),
    })
