"""Matching rules: documents in YAML or JSON, checked and compiled.

A document has one key ``rule`` with ``name``, ``version``, ``match_cardinality``, ``keys`` (a field and a tolerance:
``exact``, or an object with a type, days, absolute or percent), ``scoring`` (field, method, weight, min_similarity),
``thresholds`` (auto_match, suggest), ``aggregation_rules`` (max_group_size) and ``execution`` (priority, mode).
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import yaml

# Cardinalities, kinds of tolerance, and the fields that each built-in method can score.
CARDINALITIES = ("ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE")
TOLERANCES = ("exact", "date_window", "numeric")
TEXT_FIELDS = ("reference", "counterparty_ref", "currency", "side")
METHOD_FIELDS = {"exact": TEXT_FIELDS, "jaro_winkler": TEXT_FIELDS, "levenshtein_normalized": TEXT_FIELDS, "numeric_closeness": ("base_amount",), "date_proximity": ("value_date",)}
#: Records of a group at most.
MAX_GROUP = 5


@dataclass(frozen=True)
class Key:
    """A blocking key. Numeric ones have an absolute width, or a share of the record's own amount, or width 1."""

    field: str
    kind: str = "exact"
    days: int = 0
    amount: Decimal = Decimal(0)
    percent: Decimal = Decimal(0)

    @property
    def steps(self) -> int | None:
        """For a percentage: the number of any positive amount's band, as each amount is measured by its own."""
        if self.kind != "numeric" or self.amount or not self.percent:
            return None
        return int((1 / (2 * self.percent)).quantize(Decimal(1), ROUND_HALF_UP))


@dataclass(frozen=True)
class Score:
    field: str
    method: str
    weight: float
    least: float = 0.0


@dataclass(frozen=True)
class Rule:
    name: str
    keys: tuple[Key, ...]
    scores: tuple[Score, ...]
    auto: float
    suggest: float
    priority: int = 0
    cardinality: str = "ONE_TO_ONE"
    modes: tuple[str, ...] = ()
    max_group: int = MAX_GROUP
    version: int = 0
    warnings: tuple[str, ...] = ()

    @property
    def streaming(self) -> bool:
        """Whether the rule may run on a stream."""
        return "streaming" in self.modes


def tolerance(raw) -> dict:
    """The parts of a tolerance, written as a word or as an object."""
    if raw is None or isinstance(raw, str):
        raw = {"type": raw or "exact"}
    if not isinstance(raw, dict):
        raise ValueError("a tolerance is a word or an object")
    kind = raw.get("type") or raw.get("kind") or "exact"
    if kind not in TOLERANCES:
        raise ValueError(f"unknown tolerance {kind!r}")
    return {"kind": kind, "days": int(raw.get("days", 0)), "amount": Decimal(str(raw.get("absolute", 0))), "percent": Decimal(str(raw.get("percent", 0)))}


def compile_rule(raw: dict, methods: Collection[str] = METHOD_FIELDS) -> Rule:
    """The rule of one document's ``rule`` object; what cannot run is an error."""
    name = str(raw.get("name", ""))
    cardinality = raw.get("match_cardinality")
    if cardinality not in CARDINALITIES:
        raise ValueError(f"rule {name!r}: match_cardinality {cardinality!r} is not supported")
    keys = tuple(Key(k["field"], **tolerance(k.get("tolerance"))) for k in raw.get("keys") or ())
    if not keys:
        raise ValueError(f"rule {name!r}: a blocking key is needed")
    scoring = raw.get("scoring") or ()
    if not scoring:
        raise ValueError(f"rule {name!r}: a scored field is needed")
    for s in scoring:
        if s["method"] not in methods:
            raise ValueError(f"rule {name!r}: field {s['field']!r} has the unknown method {s['method']!r}")
        fields = METHOD_FIELDS.get(s["method"])
        if fields and s["field"] not in fields and not (fields is TEXT_FIELDS and s["field"].startswith("extra.")):
            raise ValueError(f"rule {name!r}: {s['method']} cannot score {s['field']}")
    total = sum(float(s.get("weight", 0)) for s in scoring)
    scale = total if total > 0 and abs(total - 1) > 1e-9 else 1.0
    scores = tuple(Score(s["field"], s["method"], float(s.get("weight", 0)) / scale, float(s.get("min_similarity", 0))) for s in scoring)
    limits, groups, run = (raw.get(x) or {} for x in ("thresholds", "aggregation_rules", "execution"))
    size = int(groups.get("max_group_size", 0))
    unused = tuple(x for x, there in (("scope", raw.get("scope")), ("aggregation_rules.sum_tolerance", groups.get("sum_tolerance"))) if there)
    return Rule(
        name, keys, scores, float(limits.get("auto_match", 0)), float(limits.get("suggest", 0)), int(run.get("priority", 0)), cardinality, tuple(run.get("mode") or ()),
        size if 0 < size <= MAX_GROUP else MAX_GROUP, int(raw.get("version", 0)), tuple(f"{x} has no effect" for x in unused),
    )


def parse(document: str, methods: Collection[str] = METHOD_FIELDS) -> Rule:
    """The rule of a document in YAML or JSON."""
    read = yaml.safe_load(document)
    if not isinstance(read, dict) or not isinstance(read.get("rule"), dict):
        raise ValueError("a document has one key, rule")
    return compile_rule(read["rule"], methods)


def ordered(rules: list[Rule]) -> list[Rule]:
    """Rules in the order in which they run."""
    return sorted(rules, key=lambda r: (r.priority, r.version, r.name))


# The rules of the headline queries.
AMOUNT_DATE = """
rule:
  name: amount and date
  version: 1
  match_cardinality: ONE_TO_ONE
  keys:
    - {field: tenant_id, tolerance: exact}
    - {field: currency, tolerance: exact}
    - {field: value_date, tolerance: {type: date_window, days: 1}}
    - {field: base_amount, tolerance: {type: numeric, absolute: "0.01"}}
  scoring:
    - {field: reference, method: levenshtein_normalized, weight: 0.3}
    - {field: base_amount, method: numeric_closeness, weight: 0.4}
    - {field: value_date, method: date_proximity, weight: 0.3}
  thresholds: {auto_match: 0.95, suggest: 0.6}
  execution: {priority: 1, mode: [batch, streaming]}
"""
REFERENCE_ONLY = """
rule:
  name: reference
  version: 1
  match_cardinality: ONE_TO_ONE
  keys:
    - {field: reference, tolerance: exact}
  scoring:
    - {field: reference, method: exact, weight: 1.0}
  thresholds: {auto_match: 0.9, suggest: 0.5}
  execution: {priority: 2, mode: [batch]}
"""
