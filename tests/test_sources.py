"""Files, statements, connectors, sinks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sinks import tables
from ledgerloom.sources import connectors, files, mt940


def test_statement_lines(spark):
    message = ":20:R\r\n:25:A\n:28C:1\n:60F:C240101EUR1,\n:61:240115C12,5NTRFX//B\n:86:one\ntwo\n:61:2401160117RD7,NTRFY\nmore of it\n:61:bad\n:86:?00a?20 b \n:86:lost\n:62F:C240131EUR1,\n-"
    statements = spark.createDataFrame([(1, message), (2, ""), (3, None), (4, ":61:240115DX3,NMSCZ")], "statement_id long, message string")
    got = {r.line: r for r in mt940.parse(statements.where("statement_id = 1")).collect()}
    rows = [got[k] for k in sorted(got)]
    assert [(r.mark, r.note, r.currency) for r in rows] == [("C", "one\ntwo", "EUR"), ("RD", "", "EUR"), (None, "?00a?20 b ", "EUR"), (None, "lost", "EUR")]
    assert (rows[0].bank_ref, rows[0].customer_ref, rows[1].details, rows[1].entry_date, str(rows[0].amount)) == ("B", "X", "more of it", "0117", "12.5000")
    assert [r.note for r in mt940.parse(statements.where("statement_id = 1"), "structured").where("amount IS NULL").orderBy("line").collect()] == ["a b", "lost"]
    assert mt940.parse(statements.where("statement_id IN (2, 3)")).count() == 0
    funds = mt940.parse(statements.where("statement_id = 4")).first()
    assert (funds.mark, str(funds.amount), funds.kind, funds.customer_ref, funds.currency) == ("D", "3.0000", "NMSC", "Z", None)
    b = mt940.balances(statements.where("statement_id = 1")).first()
    assert (b.opening_mark, b.closing_date, str(b.closing_amount), b.number) == ("C", "240131", "1.0000", "1")


def test_rows_of_a_long_statement_do_not_carry_it(spark):
    message = ":60F:C240101EUR1,\n:86:of the head\n" + "\n".join(f":61:240115C{i},5NTRFR{i}" + f"\n:86:?20n?21{i}" * (i % 2) for i in range(3000))
    entries = mt940.parse(spark.createDataFrame([(1, message)], "statement_id long, message string"), "structured")
    got = {r.line: r for r in entries.collect()}
    rows = [got[k] for k in sorted(got)]
    assert [r.note for r in rows] == ["of the head", *(f"n {i}" if i % 2 else "" for i in range(3000))]
    assert [int(r.amount) for r in rows[1:]] == list(range(3000)) and rows[0].amount is None
    node = entries._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":
        node = node.children().apply(0)
    kinds = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
    assert kinds and not [k for k in kinds if k.startswith("array")]


def test_structured_statements_of_a_table_do_not_carry_their_fields(spark):
    from ledgerloom.queries.registry import QUERIES

    out = QUERIES["mt940_structured"](spark, "/root/testdata/sf0.001")
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":
        node = node.children().apply(0)
    kinds = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
    assert kinds and not [k for k in kinds if k.startswith("array")]
    assert out.where("note = 'of the head'").count() == out.select("statement").distinct().count()


def test_fields_of_a_long_statement_are_never_held_together(spark):
    message = ":60F:C240101EUR1,\n" + "\n".join(f":61:240115C{i},5NTRFR{i}\n:86:note {i}" for i in range(9000)) + "\n:20:late\n:62F:C240131EUR1,"
    statements = spark.createDataFrame([(1, message)], "statement_id long, message string")
    assert mt940._read(statements).agg(F.max(F.size("f"))).first()[0] < 6000
    got = mt940.parse(statements).orderBy("line").collect()
    assert [(r.line, r.customer_ref, r.note) for r in got] == [(2 * i + 1, f"R{i}", f"note {i}") for i in range(9000)]
    assert {(r.reference, r.account, r.currency) for r in got} == {("late", None, "EUR")}
    assert mt940.balances(statements).select("reference", "closing_mark").collect() == [("late", "C")]


@pytest.mark.parametrize("size", [1, 20])
def test_pieces_of_any_size_give_the_same_rows(spark, monkeypatch, size):
    whole = "\r\n-\n:20:R\r\n:86:head\n:61:240115C1,NTRFA\n\r:86:one\n\n \nmore\n:86:lost\n:25:A\n:61:bad\n-\n:61:240116D2,NTRFB\n:60F:C240101EUR1,\n:86:tail\n-"
    statements = spark.createDataFrame([(1, whole), (2, ""), (3, None), (4, "\n \n"), (5, ":86:only")], "statement_id long, message string")
    rows = lambda: [mt940.parse(statements, "structured").orderBy("statement_id", "line").collect(), mt940.balances(statements).orderBy("statement_id").collect()]
    want = rows()
    assert [(r.statement_id, r.line, r.note) for r in want[0]] == [(1, 1, "head"), (1, 2, "one\nmore"), (1, 4, "lost"), (1, 6, ""), (1, 7, ""), (1, 9, "tail"), (5, 0, "only")]
    assert [r.statement_id for r in want[1]] == [1, 2, 4, 5]
    monkeypatch.setattr(mt940, "PIECE", size)
    assert rows() == want


def test_statements_of_a_table_have_their_lines_in_order(spark):
    from ledgerloom.queries.streams import _statements

    entries = mt940.parse(_statements(spark, "/root/testdata/sf0.1").where("statement_id = 3")).where("amount IS NOT NULL").orderBy("line")
    keys = [int(r.customer_ref[3:]) for r in entries.collect()]
    assert keys == sorted(keys) and keys[-1] > 10000


def workbook(rows):
    cell = lambda r, c, v: f'<c r="{"ABCD"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{"ABCD"[c]}{r}"><v>{v}</v></c>'
    sheet = "".join(f"<row>{''.join(cell(i, j, v) for j, v in enumerate(row) if v is not None)}</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["name", "n"], ["x", 1.5], [None, 2], ["y"]]))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = {(r.path[-6:], r.row): (r.payload, r.reason) for r in files.scan_workbooks(spark, str(tmp_path)).collect()}
    assert [got["a.xlsx", i][0] for i in (1, 2, 3)] == ['{"name": "x", "n": "1.5"}', '{"name": "", "n": "2"}', '{"name": "y", "n": ""}']
    assert got["b.xlsx", 0][1].startswith("format_parse")
    assert all(r.reason.startswith("format_parse: larger") for r in files.scan_workbooks(spark, str(tmp_path), most=5).collect())


def test_poll_reads_what_has_changed(spark, tmp_path):
    (tmp_path / "one.txt").write_text("1")
    nothing = spark.createDataFrame([], "path string, modified timestamp")
    first = files.poll(spark, str(tmp_path), nothing)
    seen = files.seen_after(nothing, first)
    assert first.count() == 1 and files.poll(spark, str(tmp_path), seen).count() == 0


def test_objects(spark, tmp_path):
    files.put(spark, f"{tmp_path}/o", b"\x00bytes")
    files.put_encrypted(spark, f"{tmp_path}/e", b"secret", "0123456789abcdef")
    assert files.get(spark, f"{tmp_path}/o") == b"\x00bytes" and files.get_encrypted(spark, f"{tmp_path}/e", "0123456789abcdef") == b"secret"
    assert b"secret" not in files.get(spark, f"{tmp_path}/e")


def test_connectors(spark, tmp_path):
    with pytest.raises(ValueError):
        connectors.register("csv", connectors.Csv)
    with pytest.raises(ValueError):
        connectors.create("odd", {})
    assert connectors.create("csv", {"tenant_id": "T"}).problems() == ["connector_id is missing", "path is missing"]
    with pytest.raises(ValueError):
        connectors.create("csv", {"tenant_id": "T"}).fetch(spark)
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    got = connectors.create("jsonl", {"tenant_id": "T", "connector_id": "C", "path": str(tmp_path)}).fetch(spark).collect()
    assert sorted(r.payload for r in got) == ['{"a": 1}', '{"a": 2}'] and got[0].source_format == "jsonl"
    queue = connectors.Queue({"brokers": "b:1", "topic": "t", "security": "SASL_SSL", "mechanism": "SCRAM-SHA-256", "user": "u", "password": 'p"'})
    assert queue.streaming and "ScramLoginModule" in queue.options()["kafka.sasl.jaas.config"] and '\\"' in queue.options()["kafka.sasl.jaas.config"]


def test_connector_as_data_source(spark):
    source = connectors.as_data_source("numbers", lambda options: list(range(int(options["parts"]))), lambda options, part: (f"{part}.{i}" for i in range(2)))
    spark.dataSource.register(source)
    got = spark.read.format("numbers").option("parts", "3").load()
    assert sorted(r.payload for r in got.collect()) == ["0.0", "0.1", "1.0", "1.1", "2.0", "2.1"]


def test_receiver_limits(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "POST", f"d{i % 3}", "", "x" * (6 << 20) if i == 5 else "b") for i in range(12)]
    requests = spark.createDataFrame(rows, "request_id long, at string, method string, delivery_id string, signature string, body string").withColumn("at", F.col("at").cast("timestamp"))
    from ledgerloom.functions.scalar import hmac_sha256

    signed = requests.withColumn("signature", hmac_sha256(F.lit("k"), F.col("body")))
    got = {r.request_id: r.status for r in connectors.received(signed, "adyen", "k", waiting=2).collect()}
    assert got == {0: 202, 1: 202, 2: 503, 3: 200, 4: 200, 5: 413, 6: 200, 7: 200, 8: 200, 9: 200, 10: 200, 11: 200}
    assert {r.status for r in connectors.received(requests, "adyen", "k").where("request_id <> 5").collect()} == {401}


def test_batches_are_whole_or_not_there(spark, tmp_path):
    rows = spark.range(3)
    for _ in range(2):  # a batch that runs again replaces itself
        tables.persist_batch(0, str(tmp_path), {"a": rows, "b": rows})
    rows.write.parquet(f"{tmp_path}/a/batch=1")  # a batch that did not come to its mark
    assert tables.read_batches(spark, str(tmp_path), "a").count() == 3 and tables.read_batches(spark, str(tmp_path), "b").count() == 3


def test_insert_and_update(spark, tmp_path):
    tables.insert(spark.range(3), str(tmp_path / "t"))
    tables.insert(spark.range(3, 5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    rows = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, status string")
    got = tables.update_status(rows, spark.createDataFrame([("a",), ("a",), ("z",)], "id string"), "y")
    assert sorted(map(tuple, got.collect())) == [("a", "y"), ("b", "x")]
