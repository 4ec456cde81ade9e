"""Functions, mapping documents, normalization, validation, keys."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import ingest, mapping, validation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_functions_of_texts(spark):
    value = lambda f, *a: one(spark, f(*[F.lit(x) for x in a]))
    assert value(scalar.parse_decimal, " 1234,50 ") == Decimal("1234.5") and value(scalar.parse_decimal, "1e3") == 1000
    assert [value(scalar.parse_decimal, x) for x in ("", "1,2,3", "1.2,3", "x", None, "1 2")] == [None] * 6
    assert [one(spark, scalar.apply_sign(F.lit(Decimal(5)), F.lit(m))) for m in ("D", " dr", "C", "cr ", "RD", "RC", "")] == [-5, -5, 5, 5, None, None, None]
    assert [one(spark, scalar.apply_sign(F.lit(Decimal(5)), F.lit(m), reversals=True)) for m in ("RD", "RC")] == [5, -5]
    assert value(scalar.trim, "  a b\t\n") == "a b" and value(scalar.iso4217, " usd ") == "USD" and value(scalar.iso4217, "XXX") is None
    parse = lambda x, layout: one(spark, scalar.parse_date(F.lit(x), layout))
    assert str(parse("690101", "YYMMDD")) == "1969-01-01" and str(parse("680101", "YYMMDD")) == "2068-01-01"
    assert parse("20240230", "YYYYMMDD") is None and parse("2024-1-01", "YYYY-MM-DD") is None and str(parse("01.02.2024", "DD.MM.YYYY")) == "2024-02-01"
    assert str(one(spark, scalar.parse_timestamp(F.lit("2024-01-02T03:04:05"), "YYYY-MM-DDTHH:mm:ss"))) == "2024-01-02 03:04:05"
    assert one(spark, scalar.extract_regex(F.lit("a1b2"), "([0-9])")) == "1" and one(spark, scalar.extract_regex(F.lit("a"), "([0-9])")) is None and one(spark, scalar.extract_regex(F.lit("1"), "[0-9]")) is None
    assert value(scalar.tokenize, "a", "k").startswith("tok_")


def test_money_and_signatures(spark):
    import hashlib
    import hmac

    assert one(spark, scalar.money(F.lit(-3), F.lit(-500_000_000))) == Decimal("-3.5")
    assert one(spark, scalar.add_money(F.lit(1), F.lit("USD"), F.lit(2), F.lit("USD"))) == 3 and one(spark, scalar.add_money(F.lit(1), F.lit("USD"), F.lit(2), F.lit("EUR"))) is None
    assert one(spark, scalar.convert(F.lit("1.00005").cast("decimal(20,5)"), F.lit("2").cast("decimal(20,10)"))) == Decimal("2.0002")
    for key, body in (("k", "b"), ("é" * 20, "x" * 200), ("long " * 30, ""), ("", "b")):
        assert one(spark, scalar.hmac_sha256(F.lit(key), F.lit(body))) == hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_a_signature_is_cheap_to_verify(spark):
    import hashlib
    import hmac

    from ledgerloom.operators import notify

    # every byte of a key: both ends of each nibble, those that become zero, and a hashed key
    for key in ("6\\\x00\x7f", "".join(map(chr, range(0x20, 0x60))), "é\u0436" * 16, "\U0001f600" * 40):
        rows = spark.createDataFrame([(key, "b")], "k string, b string")
        want = hmac.new(key.encode(), b"b", hashlib.sha256).hexdigest()
        assert {rows.select(scalar.hmac_sha256(k, F.col("b"))).first()[0] for k in (F.col("k"), F.lit(key))} == {want}
    sign = lambda t: hmac.new(b"k", f"{t}.b".encode(), hashlib.sha256).hexdigest()
    given = [(f"t=1,v1=00,v1= {sign(1).upper()} ", True), (f"t=1,t=2,v1={sign(2)},v0=1", True), (f"t=1,t=2,v1={sign(1)}", False), (f"v1={sign('')}", False), (f"t=,v1={sign('')}", False), (f"V1={sign(1)},t=1", False), (f"v1={sign(1)},t=1", True), (f"at=1,v1={sign(1)}", False), (f"\n,t=1,v1={sign(1)}", True), ("", False), (None, False)]
    rows = spark.createDataFrame([(i, s, "b") for i, (s, _) in enumerate(given)], "i int, s string, b string")
    checked = rows.select("i", notify.verify_incoming("stripe", F.col("s"), F.col("b"), F.lit("k")).alias("ok"))
    assert [r.ok for r in checked.orderBy("i").collect()] == [ok for _, ok in given]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "sequence(" not in plan and plan.count("lambdafunction(") == 2


def test_transform_calls():
    assert mapping.parse_call(" trim ") == mapping.Call("trim") == mapping.parse_call("trim()")
    assert mapping.parse_call('parse_date("YY(MM)")') == mapping.Call("parse_date", "YY(MM)")
    assert mapping.parse_call("apply_sign_from( field_61.mark )") == mapping.Call("apply_sign_from", "field_61.mark")
    for bad in ("", "1x", "a b", "f(", "f)x", "f(a)b", 'f("a"b")', "f(a)c)"):
        with pytest.raises(ValueError):
            mapping.parse_call(bad)


def test_mapping_names_the_first_error(spark):
    spec = mapping.parse("""
source_format: x
version: 3
mappings:
  - {target: a.amount, source: v.n, transform: [trim, parse_decimal]}
  - {target: a.text, source: t, transform: [uppercase]}
""")
    rows = spark.createDataFrame([('{"v": {"n": " 1,5 "}, "t": "x"}',), ('{"v": {}, "t": "x"}',), ('{"v": {"n": "?"}}',), ('{"v": {"n": "1"}}',), ("{",), (None,)], "payload string").withColumn("id", F.lit(1))
    got = [(r.amount, r.text, r.reason) for r in mapping.apply(rows, spec).collect()]
    assert got[0] == (Decimal("1.5"), "X", None)
    assert [r for _, _, r in got[1:]] == ['field_mapping: target "a.amount": field "v.n" not found', 'field_mapping: target "a.amount": transform "parse_decimal" failed', 'field_mapping: target "a.text": field "t" not found', "format_parse: not JSON", "format_parse: not JSON"]
    odd = mapping.parse("mappings: [{target: b, source: t, transform: [trim, odd]}, {target: c, source: t, transform: ['x(']}]")
    assert mapping.apply(rows, odd).first().reason == 'field_mapping: target "b": unknown transform "odd"'
    assert mapping.apply(rows.limit(0), spec).count() == 0


def test_registries():
    with pytest.raises(ValueError):
        scalar.register("trim", F.trim)
    scalar.register("test_lower", F.lower)
    assert "test_lower" in scalar.TRANSFORMS
    validation.register("test_rule", lambda p: F.when(F.col("amount") > p["most"], "too much"))
    assert "test_rule" in validation.RULES


def test_validation_collects_all(spark):
    rows = spark.createDataFrame([("", None, "", Decimal("5"), None, None), ("USD", "2024-01-01", "DEBIT", Decimal("-5"), "A", None), ("USD", "2024-01-01", "DEBIT", Decimal("5"), "A", "old reason")], "currency string, value_date string, side string, amount decimal(20,4), account_id string, reason string").withColumn("value_date", F.col("value_date").cast("date"))
    validation.register("test_rule", lambda p: F.when(F.col("amount") > p["most"], "too much"))
    got = [r.reason for r in validation.validate(rows, ['{"rule": "amount_sign", "side": "DEBIT"}', {"rule": "test_rule", "most": 1}, "no json", {"rule": "account_allowlist", "allowed_account_ids": ["A"]}]).collect()]
    assert got[0] == "validation failed: currency: required field is empty; value_date: required field is missing; side: required field is empty; test_rule: too much; business_rule: invalid rule: JSONDecodeError; account_allowlist: account_allowlist: account is not in the list: "
    assert "amount_sign: negative amount" in got[1] and got[2] == "old reason"


def test_keys(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), (None, 4)], "key string, n int")
    assert sorted((r.key or "", r.n) for r in ingest.first_of_each(rows, "key", "n").collect()) == [("", 4), ("a", 2), ("b", 1)]
    assert [r.key for r in ingest.new_only(rows.where("key IS NOT NULL"), spark.createDataFrame([("a",)], "key string"), "key", "n").collect()] == ["b"]
    with pytest.raises(ValueError):
        ingest.reuploads(rows, rows, "odd")


def test_bloom_filter(spark):
    assert ingest.bloom_size(10_000, 0.01) == (95851, 7)
    known = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    other = spark.range(2000, 7000).select(F.col("id").cast("string").alias("key"))
    bits = ingest.bloom_bits(known, "key", 2000, 0.01)
    assert ingest.may_exist(known, bits, "key", 2000, 0.01).where("NOT may_exist").count() == 0
    assert ingest.may_exist(other, bits, "key", 2000, 0.01).where("may_exist").count() < 0.02 * 5000
