"""MT940 statements as DataFrame programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import bound

#: The parts of a statement line in the order of the field's public layout; each is one group.
ENTRY = {
    "value_date": r"([0-9]{6})",
    "entry_date": r"([0-9]{4})?",
    "mark": r"(R?[CD])",
    "funds_code": r"([A-Z])?",
    "amount": r"([0-9]+,[0-9]*)",
    "kind": r"([A-Z][A-Z0-9]{3})?",
    "customer_ref": r"((?:(?!//)[^\n])*)",
    "bank_ref": r"(?://([^\n]*))?",
}
ENTRY_PATTERN = "^" + "".join(ENTRY.values())
#: The same of a balance: mark, date, currency, amount.
BALANCE = {"mark": r"([CD])", "date": r"([0-9]{6})", "currency": r"([A-Z]{3})", "amount": r"([0-9]+,[0-9]*)"}
BALANCE_PATTERN = "^" + "".join(BALANCE.values()) + r"\s*$"

#: The tags of a statement's own fields.
HEADS = {"reference": ("20",), "account": ("25",), "number": ("28C", "28")}
OPENING, CLOSING = ("60F", "60M"), ("62F", "62M")


def structured(note: Column) -> Column:
    """The parts between ``?nn`` codes, trimmed and joined by spaces."""
    return F.array_join(F.filter(F.transform(F.split(note, r"\?[0-9]{2}"), lambda x: F.trim(x)), lambda x: x != ""), " ")


#: Ways to read a note; an unknown one reads it as it is.
DIALECTS = {"generic": lambda note: note, "structured": structured}


def register_dialect(name: str, read) -> None:
    DIALECTS[name] = read


def amount(text: Column) -> Column:
    """An amount with a decimal comma, which may be the last character."""
    return F.replace(F.regexp_replace(text, ",$", ""), F.lit(","), F.lit(".")).try_cast("decimal(20,4)")


def _group(parts: dict[str, str], pattern: str, value: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, list(parts).index(name) + 1), F.lit(""))


def fields(message: Column) -> Column:
    """The tagged fields of a message as (tag, value); lines without a tag continue the one before, ``-`` and blank lines go."""
    body = F.regexp_replace(F.regexp_replace(message, "\r", ""), "(?m)^(?:-|\\s*)$\n?", "")
    tagged = F.filter(F.split(F.concat(F.lit("\n"), body), r"\n(?=:[0-9]{2}[A-Z]?:)"), lambda x: ~F.trim(x).isin("", "\n"))
    return F.transform(tagged, lambda x: F.struct(F.regexp_extract(x, r"^\s*:([0-9]{2}[A-Z]?):", 1).alias("tag"), F.regexp_replace(F.regexp_replace(x, r"^\s*:[0-9]{2}[A-Z]?:", ""), "\n+$", "").alias("value")))


#: Characters of a message that are read at once, and on to the next field that may begin a piece.
PIECE = 65536
#: A piece begins at a field other than ``:86:``, so that a note stays with the field before it.
PIECES = r"(?s).{%d,}?(?=\n:(?!86:)[0-9]{2}[A-Z]?:)|.+"


def _first(found: Column, *tags: str) -> Column:
    return F.try_element_at(F.filter(found, lambda x: x.tag.isin(*tags)), F.lit(1)).getField("value")


def _pieces(statements: DataFrame) -> DataFrame:
    """The messages cut to pieces, so that a message's fields are never held together."""
    return statements.select("statement_id", F.regexp_extract_all("message", F.lit(PIECES % PIECE), F.lit(0)).alias("pieces"))


def _heads(**tags: tuple[str, ...]) -> Column:
    """Under each name the first value of its tags; pieces after the last one needed are not read."""

    def add(seen: Column, piece: Column) -> Column:
        full = F.lit(True)
        for name in tags:
            full = full & seen.getField(name).isNotNull()
        more = lambda f: F.struct(*[F.coalesce(seen.getField(k), _first(f, *v)).alias(k) for k, v in tags.items()])
        return F.when(full, seen).otherwise(bound(fields(piece), more))

    return F.aggregate("pieces", F.struct(*[F.lit(None).cast("string").alias(k) for k in tags]), add)


def _read(statements: DataFrame, **tags: tuple[str, ...]) -> DataFrame:
    """A row for each piece: its fields ``f``, the number of fields before it and the ``heads`` of its statement."""
    before = F.aggregate("pieces", F.array(F.lit(0)), lambda seen, piece: F.concat(seen, F.array(F.element_at(seen, -1) + F.size(fields(piece)))))
    named = _pieces(statements).select("statement_id", _heads(**tags).alias("heads"), before.alias("before"), "pieces")
    cut = named.select("statement_id", "heads", "before", F.posexplode("pieces").alias("nth", "piece"))
    held = cut.select("statement_id", "heads", F.coalesce(F.get("before", F.col("nth")), F.lit(0)).alias("before"), F.explode(F.array(F.struct(fields(F.col("piece")).alias("f")))).alias("g"))
    return held.select("statement_id", "heads", "before", F.col("g.f").alias("f"))


def balances(statements: DataFrame) -> DataFrame:
    """``statement_id, reference, account, number`` and the mark, date, currency and amount of the opening and closing balance.

    A balance that does not fit its layout has null parts; the closing currency falls back to the opening one.
    """
    heads = _heads(**HEADS, opening=OPENING, closing=CLOSING)
    named = _pieces(statements.where("message IS NOT NULL")).select("statement_id", heads.alias("heads")).select("statement_id", "heads.*")
    out = ["statement_id", "reference", "account", "number"]
    for side in ("opening", "closing"):
        part = lambda name, side=side: _group(BALANCE, BALANCE_PATTERN, F.col(side), name)
        out += [part("mark").alias(f"{side}_mark"), part("date").alias(f"{side}_date"), part("currency").alias(f"{side}_currency"), amount(part("amount")).alias(f"{side}_amount")]
    return named.select(*out)


def parse(statements: DataFrame, dialect: str = "generic") -> DataFrame:
    """A row for each ``:61:`` line of (statement_id, message), with its ``:86:`` note and the header's fields.

    A note without a line before it has a row of its own with an empty line. A line that does not fit the layout has null
    fields, for the quarantine; what continues a line is its ``details``. The currency is that of the opening balance.
    """
    currency = F.nullif(F.regexp_extract("heads.opening", "^[CD][0-9]{6}([A-Z]{3})", 1), F.lit(""))
    # each field takes its neighbours along within the array, so that no row carries its whole piece
    beside = F.transform("f", lambda x, i: F.struct(i.alias("at"), x.tag.alias("tag"), x.value.alias("value"), F.when(i > 0, F.get("f", i - 1).tag).otherwise("").alias("before"), F.get("f", i + 1).alias("follow")))
    wanted = F.filter(beside, lambda x: (x.tag == "61") | ((x.tag == "86") & (x.before != "61")))
    named = _read(statements, **HEADS, opening=OPENING).select("statement_id", *[F.col(f"heads.{k}").alias(k) for k in HEADS], currency.alias("currency"), F.col("before").alias("skipped"), wanted.alias("fs"))
    rows = named.select("statement_id", *HEADS, "currency", "skipped", F.explode("fs").alias("x")).withColumn("at", F.col("skipped") + F.col("x.at"))
    orphan = F.col("x.tag") == "86"
    follow = F.col("x.follow")
    note = F.when(orphan, F.col("x.value")).when(follow.getField("tag") == "86", follow.getField("value")).otherwise("")
    line = F.when(F.col("x.tag") == "61", F.col("x.value"))
    part = lambda name: _group(ENTRY, ENTRY_PATTERN, line, name)
    details = F.when(F.contains(line, F.lit("\n")), F.regexp_replace(line, "^[^\n]*\n", ""))
    read = DIALECTS.get(dialect, DIALECTS["generic"])
    return rows.select(
        "statement_id", *HEADS, "currency", F.col("at").alias("line"), part("value_date").alias("value_date"), part("entry_date").alias("entry_date"), part("mark").alias("mark"),
        amount(part("amount")).alias("amount"), part("kind").alias("kind"), part("customer_ref").alias("customer_ref"), part("bank_ref").alias("bank_ref"), details.alias("details"), read(note).alias("note"),
    )


def payloads(entries: DataFrame) -> DataFrame:
    """The entries as JSON records for a mapping, with their statement's currency."""
    return entries.withColumn("payload", F.to_json(F.struct(*[F.col(c) for c in ("value_date", "mark", "currency", "customer_ref", "bank_ref", "note")], F.col("amount").cast("string").alias("amount"))))
