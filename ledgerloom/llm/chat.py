"""Chat formatting by schema fingerprinting, with DataFrame functions only.

A conversation may come in many layouts: rows by turn, a list of messages, a prompt with a completion,
an instruction with an input and an output. The nested field paths of a record (or of a DataFrame's
schema) are hashed to a fingerprint; the fingerprint selects a declarative mapping; the mapping turns
the record into canonical turns ``(conv_id, turn, role, text)``.

The template writes a turn as ``<s>role`` newline ``text</s>``. The control strings ``<s>``, ``</s>``,
``[INST]`` and ``[/INST]`` inside a role or a text get one backslash after their first character, and
those that already have backslashes there get one more, so that the output holds control strings only
where the template put them and the escape can be undone exactly. In roles, backslashes and newlines are
written as ``\\\\`` and ``\\n``.

Defined results: null texts and roles count as empty; rows are ordered by turn, then role, then text, and
rows that repeat stay; a null turn comes first; a row with a null conv_id is a conversation of its own, as an unbounded number of them may not meet in one; a record
whose fingerprint no mapping has gives no turns, and its fingerprint shows in ``unmapped_records``; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_OPEN, TURN_CLOSE = "<s>", "</s>"
# The control strings end like this after their first character.
CONTROL_REST = "(?=/?(?:s>|INST\\]))"


# ---------------------------------------------------------------- fingerprints and mappings
def paths_of(kind: T.DataType, prefix: str = "") -> set[str]:
    """The nested field paths of a type; ``[]`` marks array elements."""
    if isinstance(kind, T.StructType):
        return set().union(*(paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields)) if kind.fields else {prefix}
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return {prefix}


def fingerprint(paths: set[str] | frozenset[str]) -> int:
    """The hash of a set of nested field paths."""
    return zlib.crc32("\n".join(sorted(paths)).encode())


def json_fingerprint(payload: Column) -> Column:
    """The fingerprint of each JSON record, in the JVM: its distinct key paths to two levels below the top, sorted and hashed.

    Objects are followed, and in arrays every element's keys count (``[]``), not only the first one's. A payload
    that is no JSON object has a null fingerprint.
    """
    at = lambda value, key: F.call_function("get_json_object", value, F.concat(F.lit("$['"), key, F.lit("']")))

    def below(value: Column, key: Column, deeper) -> Column:
        inner = F.json_object_keys(value)
        size = F.json_array_length(value)
        element = lambda i: F.call_function("get_json_object", value, F.concat(F.lit("$["), i, F.lit("]")))
        keys_of_elements = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.json_object_keys(element(i)), F.array().cast("array<string>")))))
        return (
            F.when(inner.isNotNull() & (F.size(inner) > 0), deeper(value, key, inner) if deeper else F.transform(inner, lambda k: F.concat(key, F.lit("."), k)))
            .when((size > 0) & (F.size(keys_of_elements) > 0), F.transform(keys_of_elements, lambda k: F.concat(key, F.lit("[]."), k)))
            .when(size.isNotNull(), F.array(F.concat(key, F.lit("[]"))))
            .otherwise(F.array(key))
        )

    second = lambda value, key, inner: F.flatten(F.transform(inner, lambda k: below(at(value, k), F.concat(key, F.lit("."), k), None)))
    paths = F.flatten(F.transform(F.json_object_keys(payload), lambda key: below(at(payload, key), key, second)))
    return F.crc32(F.array_join(F.array_sort(F.array_distinct(paths)), "\n").cast("binary"))


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and SQL over ``payload`` that gives an array of (role, text)."""

    name: str
    paths: frozenset[str]
    turns_sql: str
    id_path: str = "$.id"

    @property
    def fingerprint(self) -> int:
        return fingerprint(self.paths)


def _list(field: str, role: str, text: str) -> str:
    return f"transform(from_json(get_json_object(payload, '$.{field}'), 'array<struct<{role}:string,{text}:string>>'), m -> struct(m.{role} AS role, m.{text} AS text))"


def _fields(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct('{role}' AS role, {sql} AS text)" for role, sql in pairs) + ")"


def _at(path: str) -> str:
    return f"get_json_object(payload, '$.{path}')"


MAPPINGS = (
    Mapping("messages", frozenset({"id", "messages[].role", "messages[].content"}), _list("messages", "role", "content")),
    Mapping("turn_list", frozenset({"id", "conversations[].from", "conversations[].value"}), _list("conversations", "from", "value")),
    Mapping("prompt", frozenset({"id", "prompt", "completion"}), _fields(("user", _at("prompt")), ("assistant", _at("completion")))),
    Mapping("nested_prompt", frozenset({"id", "prompt.text", "response.text"}), _fields(("user", _at("prompt.text")), ("assistant", _at("response.text")))),
    Mapping("instruction", frozenset({"id", "instruction", "output"}), _fields(("user", _at("instruction")), ("assistant", _at("output")))),
    Mapping("instruction_input", frozenset({"id", "instruction", "input", "output"}), _fields(("user", f"concat_ws('\\n', {_at('instruction')}, nullif({_at('input')}, ''))"), ("assistant", _at("output")))),
)

@dataclass(frozen=True)
class TableMapping:
    """The layout of a table with a row for each turn: SQL for its four columns, by the paths that make it."""

    name: str
    paths: frozenset[str]
    conv_id: str
    turn: str
    role: str
    text: str

    @property
    def fingerprint(self) -> int:
        return fingerprint(self.paths)


TABLES = (
    TableMapping("turns", frozenset({"conv_id", "turn", "role", "text"}), "conv_id", "turn", "role", "text"),
    TableMapping("utterances", frozenset({"conversation", "position", "speaker", "utterance"}), "conversation", "position", "speaker", "utterance"),
    TableMapping("nested_turns", frozenset({"conv_id", "turn", "message.role", "message.content"}), "conv_id", "turn", "message.role", "message.content"),
)


def table_mapping(paths: set[str], mappings: tuple[TableMapping, ...] = TABLES) -> TableMapping:
    """The mapping that the fingerprint of a schema's paths selects.

    Paths that no mapping knows are further columns and are left out of the fingerprint. If what remains is of more than one layout,
    those layouts' own paths are hashed one by one; the first one whose fingerprint is in the table is taken.
    """
    by_print = {m.fingerprint: m for m in mappings}
    vocabulary = frozenset().union(*(m.paths for m in mappings))
    known = frozenset(paths & vocabulary)
    for part in (known, *(known & m.paths for m in mappings)):
        if fingerprint(part) in by_print:
            return by_print[fingerprint(part)]
    raise ValueError(f"no mapping for the paths {sorted(paths)} (fingerprint {fingerprint(known)})")


def turns_from_table(rows: DataFrame, mappings: tuple[TableMapping, ...] = TABLES) -> DataFrame:
    """Canonical turns of a table with a row for each turn; the fingerprint of its schema selects the mapping."""
    m = table_mapping(paths_of(rows.schema), mappings)
    return rows.select(F.expr(m.conv_id).cast("long").alias("conv_id"), F.expr(m.turn).cast("long").alias("turn"), F.expr(m.role).cast("string").alias("role"), F.expr(m.text).cast("string").alias("text"))


def turns_from_records(records: DataFrame, payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts, each mapped by its own fingerprint."""
    keyed = records.select(F.col(payload).alias("payload")).withColumn("print", json_fingerprint(F.col("payload")))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        turns = F.when(F.col("print") == m.fingerprint, F.expr(m.turns_sql)).otherwise(turns)
    conv = F.lit(None).cast("string")
    for m in mappings:
        conv = F.when(F.col("print") == m.fingerprint, F.get_json_object("payload", m.id_path)).otherwise(conv)
    return keyed.select(conv.cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


def unmapped_records(records: DataFrame, payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Fingerprints that no mapping has, with their number of records."""
    return records.select(json_fingerprint(F.col(payload)).alias("fingerprint")).where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin([m.fingerprint for m in mappings])).groupBy("fingerprint").agg(F.count("*").alias("records"))


# ---------------------------------------------------------------- template
def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*){CONTROL_REST}", "$1$2\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*)\\\\{CONTROL_REST}", "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    newlines = F.regexp_replace(unescape(role), "(?<!\\\\)((?:\\\\\\\\)*)\\\\n", "$1\n")
    return F.replace(newlines, F.lit("\\\\"), F.lit("\\"))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, spans``: one row per conversation.

    ``spans`` has an entry for each turn: where its text starts in ``formatted`` (code points, from 0), its
    length, and whether the loss covers it. A conversation is one output row, so its turns meet in one task;
    offsets come from a running sum over rows, not from work that grows with the square of the turns.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    clean = turns.select("conv_id", lone, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    written = clean.select(
        "conv_id", "lone", "turn", "role", "text",
        F.concat(F.lit(TURN_OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    size = F.char_length("head") + F.char_length("body") + F.lit(len(TURN_CLOSE))
    placed = written.select(
        "conv_id", "lone", (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"),
        "head", "body", (F.col("role") == loss_role).alias("loss"),
    )
    gathered = placed.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("t"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: F.concat(x.head, x.body, F.lit(TURN_CLOSE))), "").alias("formatted"),
        F.transform("t", lambda x: F.struct((x.at + F.char_length(x.head)).alias("start"), F.char_length(x.body).cast("long").alias("length"), x.loss.alias("loss"))).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_texts`` parsed from ``formatted`` and ``spans`` alone."""
    pieces = F.split("formatted", TURN_CLOSE, -1)
    parsed = formatted.select("conv_id", "formatted", "spans", F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces"))
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substr(p, F.char_length(head(p)) + F.lit(2))
    turns = F.transform("pieces", lambda p: F.struct(unescape_role(F.substr(head(p), F.lit(len(TURN_OPEN) + 1))).alias("role"), unescape(body(p)).alias("text")))
    loss = F.zip_with("pieces", "spans", lambda p, s: F.when(s.loss, unescape(F.right(p, s.length.cast("int")))).otherwise(F.lit("")))
    return parsed.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of conversations that were read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
