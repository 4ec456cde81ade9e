"""Ingestion functions as Columns: null stands for an error, which the pipeline turns into a quarantine reason."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted currency codes.
ISO_4217 = (
    "USD", "EUR", "GBP", "JPY", "CHF", "AUD", "CAD", "NZD", "CNY", "HKD", "SGD", "SEK", "NOK", "DKK", "PLN", "CZK",
    "HUF", "ZAR", "MXN", "BRL", "INR", "KRW", "IDR", "THB", "MYR", "PHP", "VND", "AED", "SAR", "ILS", "TRY", "RUB",
)
# Hours to resolve by priority, the share of them before a warning, minutes before the next attempt, attempts.
SLA_HOURS = {"HIGH": 4, "MEDIUM": 24, "LOW": 72}
SLA_WARNING = 0.75
BACKOFF_MINUTES = (1, 5, 30, 120, 720)
MAX_ATTEMPTS = 8


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def parse_decimal(x: Column) -> Column:
    """A decimal; a lone first comma is the decimal point."""

    def of(t: Column) -> Column:
        dotted = F.when(F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")), F.regexp_replace(t, "^([^,]*),", "$1.")).otherwise(t)
        return bound(dotted, lambda d: F.when(d.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), d).otherwise(None).try_cast("decimal(38,10)"))

    return bound(trim(x), of)


def apply_sign(x: Column, mark: Column, reversals: bool = False) -> Column:
    """Negated for marks that begin with D, kept for C, an error for others.

    Reversal marks (RC, RD) are errors too, unless ``reversals`` gives them the opposite sign of their second letter.
    """

    def of(m: Column) -> Column:
        out = F.when(m.startswith("D"), -x).when(m.startswith("C"), x)
        return out.when(m == "RC", -x).when(m == "RD", x) if reversals else out

    return bound(F.upper(trim(mark)), of)


def iso4217(x: Column) -> Column:
    return bound(F.upper(trim(x)), lambda code: F.when(code.isin(*ISO_4217), code))


#: Tokens of a date layout, with a group for each and the value of a part that is not there.
TOKENS = {"YYYY": "([0-9]{4})", "YY": "([0-9]{2})", "MM": "([0-9]{2})", "DD": "([0-9]{2})", "HH": "([0-9]{2})", "mm": "([0-9]{2})", "ss": "([0-9]{2})"}
_ABSENT = {"YYYY": "0000", "MM": "01", "DD": "01", "HH": "00", "mm": "00", "ss": "00"}


def parse_timestamp(x: Column, layout: str) -> Column:
    """A strict time of a layout of YYYY or YY, MM, DD, HH, mm and ss; two-digit years from 69 on are of the last century.

    Parts that the layout lacks are the first of their kind, year 0000 among them.
    """
    token = re.compile("|".join(TOKENS))
    names = token.findall(layout)
    ends = token.split(layout)
    pattern = "^" + re.escape(ends[0]) + "".join(TOKENS[n] + re.escape(e) for n, e in zip(names, ends[1:], strict=True)) + "$"

    def of(t: Column) -> Column:
        part = {n: F.regexp_extract(t, pattern, i + 1) for i, n in enumerate(names)}
        if "YYYY" not in part and "YY" in part:
            part["YYYY"] = F.concat(F.when(part["YY"] >= "69", "19").otherwise("20"), part["YY"])
        year, month, day, hour, minute, second = (part.get(n, F.lit(missing)) for n, missing in _ABSENT.items())
        return F.when(t.rlike(pattern), F.concat(F.concat_ws("-", year, month, day), F.lit(" "), F.concat_ws(":", hour, minute, second))).otherwise(None).try_cast("timestamp")

    return bound(x, of)


def parse_date(x: Column, layout: str) -> Column:
    """The date of ``parse_timestamp``."""
    return parse_timestamp(x, layout).cast("date")


def extract_regex(x: Column, pattern: str) -> Column:
    """The first group of the first match, or an error."""
    if not re.compile(pattern).groups:
        return F.lit(None).cast("string")
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def tokenize(x: Column, key: str) -> Column:
    """A deterministic keyed token; the same value always has the same one."""
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(key), F.lit("\x00"), x), 256), 1, 32))


#: Transforms by name: Columns of the value and of an argument, which is a literal or, for ``apply_sign_from``, a Column.
TRANSFORMS: dict[str, Callable[..., Column]] = {"parse_decimal": parse_decimal, "apply_sign_from": apply_sign, "uppercase": F.upper, "trim": trim, "iso4217_validate": iso4217, "parse_date": parse_date, "extract_regex": extract_regex, "tokenize": tokenize}
#: Those whose argument is a path into the record.
BY_PATH = {"apply_sign_from"}


def register(name: str, transform: Callable[..., Column], by_path: bool = False) -> None:
    """Add a transform; a name that is taken is an error."""
    if name in TRANSFORMS:
        raise ValueError(f"transform {name} is registered")
    TRANSFORMS[name] = transform
    if by_path:
        BY_PATH.add(name)


def sha_parts(*parts: Column) -> Column:
    """SHA-256 of parts joined by a zero byte; null parts are empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def decimal_text(x: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


# ---------------------------------------------------------------- money
def money(units: Column, nanos: Column) -> Column:
    """An amount from whole units and billionths."""
    return (units.cast("decimal(28,9)") + nanos.cast("decimal(28,9)") / F.lit("1000000000").cast("decimal(10,0)")).cast("decimal(28,9)")


def add_money(a: Column, a_currency: Column, b: Column, b_currency: Column) -> Column:
    """The sum of two amounts of one currency; null (an error) for two."""
    return F.when(a_currency == b_currency, a + b)


def convert(amount: Column, rate: Column) -> Column:
    """An amount at a rate, with the four places that are stored; null without a rate."""
    return (amount.cast("decimal(20,4)") * rate.cast("decimal(20,10)")).cast("decimal(20,4)")


# ---------------------------------------------------------------- times
def sla_hours(priority: Column) -> Column:
    return F.when(priority == "HIGH", SLA_HOURS["HIGH"]).when(priority == "LOW", SLA_HOURS["LOW"]).otherwise(SLA_HOURS["MEDIUM"])


def sla_due(opened: Column, priority: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(opened) + sla_hours(priority) * 3600)


def sla_warning(opened: Column, priority: Column) -> Column:
    """When three quarters of the time are over."""
    return F.timestamp_seconds(F.unix_timestamp(opened) + sla_hours(priority) * int(3600 * SLA_WARNING))


def backoff_minutes(attempt: Column, jitter: Column | None = None) -> Column:
    """Minutes before the next attempt, the last of the list for all later ones; null after the last attempt.

    ``jitter`` in -1 to 1 (for instance ``2 * rand() - 1``) moves them by up to a tenth.
    """
    base = F.element_at(F.array(*map(F.lit, BACKOFF_MINUTES)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(BACKOFF_MINUTES))).cast("int"))
    out = F.when(attempt < MAX_ATTEMPTS, base)
    return out if jitter is None else out * (1 + 0.1 * jitter)


# ---------------------------------------------------------------- signatures
_BYTES = "".join(map(chr, range(256)))


def _xored(key: Column, byte: int) -> Column:
    """A binary key with each byte xored.

    Bytes become characters of one table, the results those of a second one 256 further on, as translate drops what becomes a zero
    character; of their two bytes the lower one counts. There is no loop and no lambda, so that a literal key is xored once, at planning.
    """
    text = F.translate(F.decode(key, "ISO-8859-1"), _BYTES, "".join(chr(256 + (b ^ byte)) for b in range(256)))
    return F.unhex(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "..(..)", "$1"))


def hmac_sha256(key: Column, body: Column) -> Column:
    """The lower-case hex HMAC-SHA256 of a text or binary body under a text key, within the JVM."""
    raw = F.encode(key, "utf-8")
    short = F.when(F.octet_length(raw) > 64, F.sha2(raw, 256)).otherwise(F.lower(F.hex(raw)))
    padded = F.unhex(F.rpad(short, 128, "0"))
    inner = F.sha2(F.concat(_xored(padded, 0x36), body.cast("binary")), 256)
    return F.sha2(F.concat(_xored(padded, 0x5C), F.unhex(inner)), 256)
