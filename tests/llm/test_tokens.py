"""SentencePiece encoding, packing and chat formatting against the libraries and against exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, packing, pieces
from ledgerloom.llm.common import tokenizer_path

TEXTS = ["", None, " ", "  ", "a", " a  b\n\tc ", "▁x ▁▁ y", "ends ", "日本語 テキスト 🎉", "<s> </s> [INST]", "<|endoftext|> a<|endoftext|>b ", "it's 12,000   \n\n x y", "word " * 3000, "x" * 5000, "tab\tand\x1c fs \x1cz", "é́ ﬁ Ⅷ　z"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "again", "x")], "doc_id long, text string, ids string").repartition(3)


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = TEXTS[row.doc_id] or "" if row.doc_id is not None and row.doc_id != 3 else None
        if text is None:
            continue
        ids = model.encode(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(model.decode(ids).encode() if ids else b"").hexdigest()
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert back[9] == TEXTS[9]
    assert pieces.encode(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_normalisers_are_read_from_the_model():
    import pathlib

    model = pathlib.Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
    assert pieces.only_marks(model) and pieces.Chunks(tokenizer_path("piece_bpe_32k.model")).separable
    part = lambda spec: b"\x1a" + bytes([len(spec)]) + spec
    assert pieces.only_marks(part(b"\x20\x00")) and not pieces.only_marks(part(b"")) and not pieces.only_marks(b"")
    assert not pieces.only_marks(part(b"\x12\x01x\x20\x00")) and not pieces.only_marks(part(b"\x18\x00\x20\x00")) and not pieces.only_marks(part(b"\x20\x00\x28\x00"))


def packed(frame):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


def check_pack(rows, expected):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            piece = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 and {r.window for r in rs} == {at}


def test_packing_by_library_ids(spark, docs):
    own = docs.where("doc_id IS NOT NULL AND text IS DISTINCT FROM 'again'")
    encode = packed(None)
    check_pack(packing.pack(own, tokenizer_path("byte_bpe_50k.tiktoken")).collect(), {i: encode(t) for i, t in enumerate(TEXTS)})
    assert packing.pack(docs.limit(0), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0
    assert packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True).where(F.size("ids") != F.col("length")).count() == 0


def test_packing_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encode = packed(None)
    check_pack(packing.pack(table, tokenizer_path("byte_bpe_50k.tiktoken")).collect(), {r.doc_id: encode(r.text) for r in table.collect()})


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> <s><\\\\s>", "", None, "\\n a\\", "[INST][\\INST]</s", "< /s>\n\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a\nb\\n", None, "assistant", "<s>", "tool"], nasty, strict=True))]
    rows += [(None, 0, "user", "x"), (None, 0, "assistant", "x"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "system", "s")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)).withColumn("head", F.lit("x"))
    formatted = chat.format_turns(chat.turns_from_table(table))
    read = chat.read_back(formatted).collect()
    got = {r.conv_id: r for r in read}
    assert sorted(r.turns[0].role for r in read if r.conv_id is None) == ["assistant", "user"]
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:7]]
    assert [(t.role, t.text) for t in got[2].turns] == [("system", "s"), ("user", "a"), ("user", "a"), ("assistant", "b")]
    assert "".join(got[1].loss_texts) == nasty[1] + nasty[4]
    for r in formatted.collect():
        if r.conv_id is None:
            continue
        for s, t in zip(r.spans, got[r.conv_id].turns, strict=True):
            assert s.loss == (t.role == "assistant")
            assert r.formatted[s.start - 1] == "\n" and r.formatted[s.start + s.length :].startswith("</s>")
    assert chat.digest(chat.read_back(chat.format_turns(chat.turns_from_table(table.limit(0))))).count() == 0


def test_fingerprints_select_mappings(spark):
    records = spark.createDataFrame(
        [('{"id": 1, "messages": [{"content": "q", "role": "user"}, {"role": "assistant", "content": "a"}]}',), ('{"completion": "a", "prompt": "q", "id": 2}',), ('{"id": 3, "prompt": {"text": "q"}, "response": {"text": "a"}}',),
         ('{"id": 4, "instruction": "q", "input": "", "output": "a"}',), ('{"id": 5, "conversations": [{"from": "user", "value": "q"}, {"from": "assistant", "value": "a"}]}',), ('{"odd": 1}',), ("no json",), (None,)],
        "payload string",
    )
    got = {}
    for r in chat.turns_from_records(records).collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    assert got == {i: {0: ("user", "q"), 1: ("assistant", "a")} for i in range(1, 6)}
    assert sum(r.records for r in chat.unmapped_records(records).collect()) == 3


def test_fingerprints_follow_paths(spark):
    value = lambda x: spark.range(1).select(chat.json_fingerprint(F.lit(x))).first()[0]
    assert value('{"b": {"c": {"d": 1}, "e": []}, "a": [{"x": 1}, {"y": 2}]}') == chat.fingerprint({"b.c.d", "b.e[]", "a[].x", "a[].y"})
    assert value('{"a": [1, 2], "b": {}}') == chat.fingerprint({"a[]", "b"})
    assert value('{"a": [1, {"x": 2}]}') == chat.fingerprint({"a[].x"}) and value("[1]") is None and value(None) is None


def test_schema_fingerprints_select_mappings(spark):
    assert chat.table_mapping({"conv_id", "turn", "role", "text", "extra"}).name == "turns"
    assert chat.table_mapping({"conversation", "position", "speaker", "utterance"}).name == "utterances"
    assert chat.table_mapping({"conv_id", "turn", "role", "text", "message.role", "speaker"}).name == "turns"
    with pytest.raises(ValueError):
        chat.table_mapping({"conv_id", "turn", "text"})
    nested = spark.createDataFrame([(1, 0, ("user", "hi"), 3)], "conv_id long, turn long, message struct<role:string,content:string>, more int")
    assert tuple(chat.turns_from_table(nested).first()) == (1, 0, "user", "hi")
