"""Rules, candidates, assignment, groups and reconciliation against plain models."""

import itertools
import random
import time
from datetime import date, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import similarity
from ledgerloom.operators import matching, reconcile
from ledgerloom.operators.graph import components
from ledgerloom.plans import rules
from ledgerloom.streaming.jobs import plain_match, plain_rank

RECORD = "ord long, id string, tenant_id string, account_id string, value_date date, base_amount decimal(20,4), currency string, reference string, counterparty_ref string, side string, extra map<string,string>"


def record(ord_, day="2024-01-15", amount="100.00", currency="USD", reference="INV1", name=None, extra=None):
    return (ord_, name or f"r{ord_}", "T", "A", date.fromisoformat(day), Decimal(amount), currency, reference, "", "DEBIT", extra or {})


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def document(keys, scoring, auto=0.9, suggest=0.5, priority=10, name="r", cardinality="ONE_TO_ONE", more=""):
    keyed = "\n".join(f"    - {{field: {f}, tolerance: {t}}}" for f, t in keys)
    scored = "\n".join(f"    - {{field: {f}, method: {m}, weight: {w}}}" for f, m, w in scoring)
    return f"rule:\n  name: {name}\n  version: 1\n  match_cardinality: {cardinality}\n  keys:\n{keyed}\n  scoring:\n{scored}\n  thresholds: {{auto_match: {auto}, suggest: {suggest}}}\n  execution: {{priority: {priority}, mode: [batch]}}\n{more}"


STRICT = document([("currency", "exact"), ("value_date", "{type: date_window, days: 1}"), ("base_amount", '{type: numeric, absolute: "0.01"}')], [("currency", "exact", 0.3), ("reference", "exact", 0.4), ("base_amount", "numeric_closeness", 0.3)])
BY_REFERENCE = document([("currency", "exact"), ("reference", "exact")], [("reference", "exact", 0.5), ("base_amount", "numeric_closeness", 0.5)], name="first")
LOOSE = document([("currency", "exact"), ("value_date", "{type: date_window, days: 1}")], [("base_amount", "numeric_closeness", 1.0)], priority=20, name="second")


@pytest.mark.parametrize(
    ("documents", "source", "target", "auto", "suggested", "left"),
    [
        ([STRICT], [], [], set(), set(), set()),
        ([STRICT], [record(1)], [record(2)], {("r1", "r2")}, set(), set()),
        ([STRICT], [record(1)], [record(2, reference="OTHER")], set(), {("r1", "r2")}, set()),
        ([STRICT], [record(1, currency="EUR")], [record(2)], set(), set(), {"r1", "r2"}),
        ([LOOSE, BY_REFERENCE], [record(1, reference="SAME"), record(2, "2024-01-20", "300", "GBP", "a")], [record(3, reference="SAME"), record(4, "2024-01-20", "300", "GBP", "b")], {("r1", "r3"), ("r2", "r4")}, set(), set()),
    ],
    ids=["empty", "auto", "suggested", "unmatched", "chain"],
)
def test_golden_cases(spark, documents, source, target, auto, suggested, left):
    s, t = frame(spark, source), frame(spark, target)
    found = matching.match_chain(s, t, [rules.parse(d) for d in documents])
    got = found.collect()
    assert {(r.src_id, r.tgt_id) for r in got if r.status == "AUTO"} == auto
    assert {(r.src_id, r.tgt_id) for r in got if r.status == "SUGGESTED"} == suggested
    assert {r.id for r in matching.unmatched(s, t, found).collect()} == left


def test_documents_are_checked():
    rule = rules.parse(rules.AMOUNT_DATE)
    assert [k.kind for k in rule.keys] == ["exact", "exact", "date_window", "numeric"] and rule.streaming and rule.priority == 1
    assert rules.parse(document([("a", "exact")], [("reference", "exact", 2), ("side", "exact", 6)])).scores[1].weight == 0.75
    more = "  scope: {source: {account_group: g}}\n  aggregation_rules: {max_group_size: 20, sum_tolerance: {absolute: 1}}\n"
    odd = rules.parse(document([("a", "")], [("extra.x", "exact", 1)], cardinality="ONE_TO_MANY", more=more))
    assert odd.max_group == 5 and odd.keys[0].kind == "exact" and len(odd.warnings) == 2 and not odd.streaming
    assert rules.parse('{"rule": {"name": "j", "match_cardinality": "MANY_TO_ONE", "keys": [{"field": "a", "tolerance": {"type": "numeric", "percent": 0.05}}], "scoring": [{"field": "side", "method": "exact", "weight": 1}]}}').keys[0].steps == 10
    good = [("currency", "exact")], [("reference", "exact", 1)]
    for bad in (
        "rule: 3", "a: 1", document([], good[1]), document(good[0], []), document(good[0], [("reference", "odd", 1)]), document(good[0], [("base_amount", "exact", 1)]), document(good[0], [("side", "date_proximity", 1)]),
        document(*good, cardinality="MANY_TO_MANY"), document(*good, cardinality="odd"), document([("a", "fuzzy")], good[1]), document([("a", "[1]")], good[1]),
    ):
        with pytest.raises(ValueError):
            rules.parse(bad)


def test_similarity_vectors():
    for a, b, want in (("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("JELLYFISH", "SMELLYFISH", 0.8963), ("", "", 1.0), ("ABC", "XYZ", 0.0), ("a", "", 0.0)):
        assert round(similarity.jaro_winkler(a, b), 4) == want
    assert round(similarity.jaro("abcdef", "bcadef"), 4) == 0.9444  # an odd number of swaps is halved in whole numbers


def test_scores_of_columns_and_their_twins_are_equal(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(7))), "".join(rng.choice("abc") for _ in range(rng.randrange(7))), Decimal(rng.randrange(300)) / 10000, Decimal(rng.randrange(300)) / 10000, date(2024, 1, 1), date(2024, 1, 1) + timedelta(days=rng.randrange(12))) for i in range(300)]
    pairs = spark.createDataFrame(rows, "i int, a string, b string, x decimal(20,4), y decimal(20,4), d date, e date")
    columns = {"exact": ("a", "b"), "jaro_winkler": ("a", "b"), "levenshtein_normalized": ("a", "b"), "numeric_closeness": ("x", "y"), "date_proximity": ("d", "e")}
    for r in pairs.select("*", *[similarity.SCORERS[m](F.col(p), F.col(q)).alias(m) for m, (p, q) in columns.items()]).collect():
        for m, (p, q) in columns.items():
            assert abs(r[m] - similarity.PLAIN[m](r[p], r[q])) < 1e-9, (m, r)


def test_assignment_is_greedy_by_source(spark):
    rng = random.Random(1)
    for rounds, edges_a_component in ((12, 200_000), (1, 200_000), (1, 4)):
        for _ in range(3):
            edges = {(s, t): rng.choice([0.7, 0.8, 0.9]) for s in range(9) for t in range(9) if rng.random() < 0.5}
            rows = spark.createDataFrame([(s, f"s{s}", t, f"t{t}", w, [0]) for (s, t), w in edges.items()], "src_ord long, src_id string, tgt_ord long, tgt_id string, score double, ranks array<long>")
            free, want = set(range(9)), set()
            for s in range(9):
                best = sorted((-w, t) for (a, t), w in edges.items() if a == s and t in free)
                if best:
                    want.add((s, best[0][1]))
                    free.remove(best[0][1])
            assert {(r.src_ord, r.tgt_ord) for r in matching.assign(rows, rounds, edges_a_component).collect()} == want


def test_a_long_chain_of_contention_ends_soon(spark):
    n = 1000
    edges = [(i, f"s{i}", t, f"t{t}", score, [0]) for i in range(n) for t, score in ((i, 0.8), (i - 1, 0.9)) if t >= 0]
    rows = spark.createDataFrame(edges, "src_ord long, src_id string, tgt_ord long, tgt_id string, score double, ranks array<long>")
    began = time.time()
    assert {(r.src_ord, r.tgt_ord) for r in matching.assign(rows).collect()} == {(i, i) for i in range(n)}
    assert time.time() - began < 60


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}


def test_match_equals_a_plain_loop(spark):
    rng = random.Random(11)
    rule = rules.parse(rules.AMOUNT_DATE.replace('absolute: "0.01"', 'absolute: "0.02"'))
    for _ in range(4):
        side = lambda at, name: [record(at + i, f"2024-01-{rng.randrange(10, 16)}", f"{rng.randrange(-6, 6) / 100}", rng.choice(["USD", "EUR"]), rng.choice(["ab", "abc", "x", None]), f"{name}{i}") for i in range(25)]  # noqa: B023, E731
        source, target = side(0, "s"), side(100, "t")
        fields = [c.split()[0] for c in RECORD.split(", ")[:-1]]
        pool = [dict(zip(fields, r, strict=False)) for r in target]
        want = set()
        for r in source:
            free = [p for p in pool if p["id"] not in {t for _, t, _ in want}]
            found = plain_match(dict(zip(fields, r, strict=False)), free, [rule])
            if found:
                want.add((r[1], free[found[0]]["id"], found[2]))
        got = matching.match(frame(spark, source), frame(spark, target), rule)
        assert {(r.src_id, r.tgt_id, r.status) for r in got.collect()} == want


@pytest.mark.parametrize("key", [rules.Key("currency"), rules.Key("value_date", "date_window", days=2), rules.Key("base_amount", "numeric", amount=Decimal("0.5")), rules.Key("base_amount", "numeric"), rules.Key("base_amount", "numeric", percent=Decimal("0.05")), rules.Key("base_amount", "numeric", percent=Decimal("0.4"))])
def test_candidates_equal_all_pairs_that_meet(spark, key):
    rng = random.Random(5)
    rows = [record(i, f"2024-01-{rng.randrange(10, 28)}", str(rng.choice([0, 1, -1, rng.randrange(-40, 40) / 8])), rng.choice(["USD", "EUR"])) for i in range(60)]
    rows += [(100, "r100", "T", "A", None, None, None, "x", "", "", {}), (101, "r101", "T", "A", None, None, None, "y", "", "", {})]
    where = [c.split()[0] for c in RECORD.split(", ")].index(key.field)
    got = matching.candidates(frame(spark, rows), frame(spark, rows), (key,))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    pairs = [(r[0], r[1]) for r in got.select("s.ord", "t.ord").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a[0], b[0]) for a, b in itertools.product(rows, rows) if plain_rank(key, a[where], b[where]) is not None}


def test_few_candidates_for_each_record(spark):
    rule = rules.parse(STRICT)
    rows = [record(i, f"2024-01-{10 + i % 5}", str(100 + i % 10), ["USD", "EUR"][i % 2]) for i in range(50)]
    assert matching.candidates(frame(spark, rows), frame(spark, rows), rule.keys).count() / 50 <= 15


def test_missing_extra_field_is_an_error(spark):
    rule = rules.parse(document([("currency", "exact")], [("extra.k", "exact", 1)]))
    fine = frame(spark, [record(1, extra={"k": "a"})])
    assert matching.match(fine, fine, rule).count() == 1
    with pytest.raises(Exception, match="extra.k is missing"):
        matching.match(fine, frame(spark, [record(2)]), rule).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-30, 30), max_size=9), st.integers(-60, 60), st.integers(0, 3), st.integers(1, 5))
def test_first_group(amounts, want, slack, most):
    got = matching._first_group(amounts, want, slack, most)
    tried = (list(c) for size in range(1, most + 1) for c in itertools.combinations(range(len(amounts)), size))
    assert got == next((c for c in tried if abs(sum(amounts[i] for i in c) - want) <= slack), [])


def test_groups_of_keys(spark):
    lines = spark.createDataFrame([("a", 1, Decimal("1.5")), ("a", 2, Decimal("2.5")), ("a", 3, Decimal("4"))], "key string, place int, amount decimal(20,4)")
    wanted = spark.createDataFrame([("a", Decimal("6.6")), ("b", Decimal("1"))], "key string, amount decimal(20,4)")
    get = lambda **k: {r.key: r.places for r in matching.find_groups(lines, wanted, **k).collect()}
    assert get() == {"a": None, "b": None}
    assert get(absolute="0.1") == get(percent="0.02") == {"a": [2, 3], "b": None}
    assert get(absolute="0.1", most=1)["a"] is None


def test_reconcile_equals_a_plain_loop(spark):
    rng = random.Random(2)
    for _ in range(3):
        some = lambda n: [(i, sorted({f"x{rng.randrange(14)}" for _ in range(rng.randrange(1, 4))})) for i in range(n)]
        batch, stream = some(8), some(8)
        taken, want = {}, {}
        for b, ids in batch:
            first = next((s for s, other in stream if s not in taken and set(other) & set(ids)), None)
            if first is not None:
                taken[first] = (b, ids)
        for s, ids in stream:
            b = taken.get(s)
            want[s] = ("AUTO_MATCHED_CONFIRMED", b[0], None) if b and b[1] == ids else ("RECONCILIATION_VARIANCE", b[0] if b else None, "different_transactions" if b else "no_confirming_match_found")
        schema = "ord long, ids array<string>"
        got = reconcile.reconcile(spark.createDataFrame(batch, schema), spark.createDataFrame(stream, schema))
        assert {r.stream_ord: (r.outcome, r.batch_ord, r.reason) for r in got.collect()} == want
