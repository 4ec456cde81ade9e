"""Streams against plain loops."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import rules
from ledgerloom.streaming import jobs

NEAR = rules.AMOUNT_DATE.replace('absolute: "0.01"', 'absolute: "0.02"')
FIELDS = ("id", "tenant_id", "currency", "reference", "value_date", "base_amount", "arrival")


def plain(records, documents, readd, as_of=None):
    """One record after the other, with one list for each tenant."""
    usable, pools, newest, out = rules.ordered([r for r in documents if r.streaming]), {}, {}, set()
    keys = jobs.group_keys(usable)
    for r in sorted(records, key=lambda r: (r["arrival"], r["id"])):
        group = tuple(r[k] for k in keys)
        pool = pools.setdefault(group, [])
        found = jobs.plain_match(r, pool, usable)
        matched = found is not None and found[2] == "AUTO"
        if matched:
            out.add((r["id"], pool[found[0]]["id"], round(found[1], 6)))
            del pool[found[0]]
        newest[group] = max(newest.get(group, date.min), r["value_date"])
        limit = (as_of or newest[group]) - timedelta(days=jobs.POOL_DAYS)
        if readd or not matched:
            pool.append(r)
        pools[group] = [p for p in pool if p["value_date"] >= limit]
    return out


@pytest.mark.parametrize(("readd", "as_of"), [(True, None), (False, None), (True, date(2024, 1, 25))])
def test_pool_equals_a_plain_loop(spark, readd, as_of):
    rng = random.Random(6)
    records = [dict(zip(FIELDS, (f"r{i}", rng.choice("TU"), rng.choice(["USD", "EUR"]), rng.choice(["ab", "abc", "xyz"]), date(2024, 1, 10) + timedelta(days=i // 12 + rng.randrange(2)), Decimal(rng.randrange(-8, 8)) / 100, i), strict=True)) for i in range(150)]
    rows = spark.createDataFrame([tuple(r.values()) for r in records], "id string, tenant_id string, currency string, reference string, value_date date, base_amount decimal(20,4), arrival long")
    documents = [rules.parse(NEAR), rules.parse(rules.REFERENCE_ONLY)]
    got = jobs.pool_match(rows, documents, readd=readd, as_of=as_of).collect()
    # a record that leaves late is past the window of every rule here, so when it leaves changes nothing
    want = plain(records, documents, readd, as_of)
    assert {(r.id, r.other_id, round(r.score, 6)) for r in got} == want and want


REFERENCE = rules.REFERENCE_ONLY.replace("mode: [batch]", "mode: [streaming]").replace("keys:", "keys:\n    - {field: tenant_id}\n    - {field: value_date, tolerance: {type: date_window, days: 1}}")


class Store:
    """The state of one bucket, with a count of the calls."""

    def __init__(self):
        self.calls, self.map, self.value = 0, {}, None

    def getMapState(self, *_):
        return self.Map(self)

    def getValueState(self, *_):
        return self.Value(self)

    class Map:
        def __init__(self, store):
            self.store = store

        def getValue(self, key):
            self.store.calls += 1
            return self.store.map.get(key)

        def updateValue(self, key, value):
            self.store.calls += 1
            self.store.map[key] = value

        def removeKey(self, key):
            self.store.calls += 1
            del self.store.map[key]

    class Value(Map):
        def exists(self):
            return self.store.value is not None

        def get(self):
            return self.store.value

        def update(self, value):
            self.store.value = value


@pytest.mark.parametrize("document", [NEAR, REFERENCE])
def test_a_bucket_of_many_groups_makes_few_calls_and_grows(monkeypatch, document):
    import json

    import pandas as pd

    rng, usable, store = random.Random(7), [rules.parse(document)], Store()
    keys = jobs.group_keys(usable)
    records = [dict(zip(FIELDS, (f"r{i:05d}", f"T{rng.randrange(3)}", rng.choice(["USD", "EUR"]), f"é{rng.randrange(900)}" if document == REFERENCE else rng.choice("ab"), date(2024, 1, 10) + timedelta(days=i // 100), Decimal(rng.randrange(-900, 900)) / 100, i), strict=True)) for i in range(3000)]
    monkeypatch.setattr(jobs, "PART_RECORDS", 64)
    got, counts = set(), []
    for began, ended in ((0, 40), (40, 1500), (1500, 2990), (2990, 3000)):
        batch = [{f: None for f in jobs.FIELDS} | {f: r[f] for f in ("id", "reference", "currency", "arrival")} | {"key": json.dumps([r[k] for k in keys]), "day": r["value_date"].toordinal(), "amount": str(r["base_amount"])} for r in records[began:ended]]
        rng.shuffle(batch)
        pool = jobs.Pool(usable, keys, True, None)
        pool.init(store)
        calls = store.calls
        for frame in pool.handleInputRows((1,), iter([pd.DataFrame(batch[:20]), pd.DataFrame(batch[20:])] if batch[20:] else [pd.DataFrame(batch)]), None):
            got |= {(r.id, r.other_id, round(r.score, 6)) for r in frame.itertuples()}
        counts.append(store.calls - calls)
    want = plain(records, usable, True)
    assert got == want and len(want) > 50
    assert max(counts) < 500 and counts[-1] <= 2 * 4 * 10
    assert store.value[0] in (16, 32, 64) and store.value[1] == sum(len(x) for text, in store.map.values() for _, cell, x in json.loads(text) if cell is not None)


def test_the_pool_lasts_from_batch_to_batch(spark):
    from ledgerloom.session import shared

    rng = random.Random(8)
    records = [dict(zip(FIELDS, (f"r{i:03d}", "T", "USD", f"R{rng.randrange(40)}", date(2024, 1, 10) + timedelta(days=i // 60), Decimal(1), i), strict=True)) for i in range(120)]
    usable, folder = [rules.parse(REFERENCE)], shared(spark, "rows")
    for part in range(3):
        rows = spark.createDataFrame([tuple(r.values()) for r in records[part * 40 : part * 40 + 40]], "id string, tenant_id string, currency string, reference string, value_date date, base_amount decimal(20,4), arrival long")
        given = jobs.pool_input(rows, usable)
        given.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.finish(jobs.pool_stream(stream, usable), folder).collect()
    want = plain(records, usable, True)
    assert {(r.id, r.other_id, round(r.score, 6)) for r in got} == want and [w for w in want if int(w[0][1:]) // 40 > int(w[1][1:]) // 40]


def test_without_a_streaming_rule_nothing_matches(spark):
    rows = spark.createDataFrame([("a", "T", date(2024, 1, 1), Decimal(1), 0)], "id string, tenant_id string, value_date date, base_amount decimal(20,4), arrival long")
    assert jobs.pool_match(rows, [rules.parse(rules.REFERENCE_ONLY)]).count() == 0


def test_every_record_of_both_ledgers_is_matched(spark, monkeypatch):
    from ledgerloom.queries import QUERIES, matching

    small = "/root/testdata/sf0.001"
    sources, targets = ({(r.reference, r.id) for r in x.collect()} for x in matching.ledgers(spark, small))
    # references are unique, and a pair's amounts and dates are near enough
    by_reference = dict(sources)
    want = {(i, by_reference[reference]) for reference, i in targets if reference in by_reference}
    got = [(r.id, r.other_id) for r in QUERIES["stream_match"](spark, small).collect()]
    assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(jobs, "pool_match", lambda records, _: records)
    arrived = [r.id for r in QUERIES["stream_match"](spark, small).collect()]
    assert sorted(arrived) == sorted(i for _, i in sources | targets)


def test_dedup_in_time(spark):
    rows = spark.createDataFrame([("k", f"2024-01-01 00:{m:02d}:00", m) for m in (0, 3, 9)], "delivery_key string, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
    assert jobs.dedup(rows).count() == 1


def test_partial_sums_of_batches(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    got = {r.k: (r.n, r.s) for r in jobs.incremental(rows, ["k"], {"n": "count(*)", "s": "sum(id)"}).collect()}
    assert got == {k: (len(range(k, 100, 3)), sum(range(k, 100, 3))) for k in range(3)}


def test_fan_out_of_a_stream(spark):
    from ledgerloom.operators import notify

    rows = spark.createDataFrame([(i, "click" if i % 2 else "view", f'{{"value": {i}}}') for i in range(10)], "event_id long, event_type string, payload string")
    stream, folder = jobs.stream_of(rows)
    got = jobs.finish(notify.fan_out(stream, [{"sub": 1, "active": True, "types": ["click"], "filter": "value > 4"}]), folder)
    assert sorted(r.event_id for r in got.collect()) == [5, 7, 9]


def test_late_records_are_left_to_the_batch(spark):
    rule = rules.parse(rules.AMOUNT_DATE.replace("days: 1", "days: 10"))
    rows = [("early", "T", "USD", "x", date(2024, 1, 1), Decimal(1), 0), ("new", "T", "USD", "y", date(2024, 1, 20), Decimal(1), 1), ("late", "T", "USD", "x", date(2024, 1, 1), Decimal(1), 2)]
    frame = spark.createDataFrame(rows, "id string, tenant_id string, currency string, reference string, value_date date, base_amount decimal(20,4), arrival long")
    assert jobs.pool_match(frame, [rule]).where("other_id = 'early'").count() == 0
    from ledgerloom.operators import matching

    batch = frame.withColumn("ord", F.col("arrival"))
    assert matching.match(batch.where("id = 'late'"), batch.where("id = 'early'"), rule).count() == 1


def test_topics(spark):
    from ledgerloom.streaming import topics

    rows = spark.createDataFrame([("T", "A", "p")], "tenant_id string, account_id string, payload string")
    assert tuple(topics.messages(rows, "matching.results.default").first()) == ("matching.results.default", "T|A", "p")
    with pytest.raises(ValueError):
        topics.messages(rows, "odd")
    bad = spark.createDataFrame([("T", "validation", "r", "p"), ("T", "normalization", "r", "p")], "tenant_id string, stage string, reason string, payload string")
    assert [r.topic for r in topics.dead_letters(bad).collect()] == ["dlq.validation"]
    held = spark.createDataFrame([("audit.events", "k", 1, "a"), ("audit.events", "k", 2, "b"), ("webhook.outbox", "k", 0, "c"), ("webhook.outbox", "k", topics.DAY, "d")], "topic string, key string, at_ms long, value string")
    assert sorted(r.value for r in topics.kept_messages(held, 8 * topics.DAY).collect()) == ["b", "d"]
