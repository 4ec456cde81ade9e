"""Personal data, quality and the pipeline's stages against plain versions of them."""

import hashlib
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii, quality
from ledgerloom.llm.common import table

SMALL = "/root/testdata/sf0.001"


def luhn(m):
    digits = [int(c) for c in m if c.isdigit()][::-1]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
}


def base(text):
    kinds = list(BASE)
    spans = sorted((m.start(), kinds.index(k), m.end(), k) for k, (p, valid) in BASE.items() for m in re.finditer(p, text or "") if valid(m[0]))
    return [f"{k}:{a}:{e}" for a, _, e, k in spans]


def texts():
    rng = random.Random(11)
    out = [None, "", "a@b.c_d@e.f x@y.com.@z.org @ a@ .@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.003.255 0000300.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1111x 41111111111111111 5 5",
           "+1 (389) 555-5010 Les +4912345 +12 3456.7890-123(4) ++1234567890 +1", "é🎉 a@b.cd 🎉 1.1.1.1 password=Abc12345! token = \"0123456789abcdef0123\" v 1.2", "9" * 60_000 + " " + "1 " * 4_000, "a." * 40_000 + "@", "x" * 90_000 + "@y.zz"]
    for _ in range(400):
        out.append("".join(rng.choice("0123456789 .-+()@a_%é\n") if rng.random() < 0.9 else rng.choice(["4111111111111111", "+1 555 123 4567", "a@b.co", "10.0.0.1"]) for _ in range(rng.randrange(120))))
    return out


def test_base_spans_equal_plain_matching(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.cd"), (3, "a@b.cd")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(frame).collect())
    want = []
    for i, t in rows:
        spans = base(t)
        want.append((i if i is not None else -1, hashlib.sha256(",".join(spans).encode()).hexdigest(), *(sum(s.startswith(k) for s in spans) for k in BASE)))
    assert got == sorted(want)
    assert pii.find(frame.limit(0)).count() == 0


def test_added_spans_keep_base_and_find_secrets(spark):
    words = " ".join(f"w{i % 7}".replace("w", "word") for i in range(20)).replace("0", "").replace("1", "")
    rows = [(i, f"text {words} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" then mail{i}@a.example and version {i}.2 of {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r, (_, text) in zip(pii.find(frame).orderBy("doc_id").collect(), rows, strict=True):
        spans = r.spans.split(",")
        assert set(base(text)) <= set(spans)
        assert [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans) if k == "secret"] == [hashlib.sha1(str(r.doc_id).encode()).hexdigest()]
    clean = [r.text for r in pii.redact(frame).collect()]
    assert all("[SECRET]" in t and "[EMAIL]" in t and "@" not in t for t in clean)


def test_secrets_and_names_without_digits_are_found(spark):
    hidden = ["password=correcthorsebattery", "api_key=AbCdEfGhIjKl", "hunterhunter", "Maria Kowalska", "London"]
    rows = [(i, f"some plain text {hidden[0]} and {hidden[1]} or the password is {hidden[2]} as {hidden[3]} of {hidden[4]} said in version {i}.2 on page {i}") for i in range(40)]
    frame = spark.createDataFrame([*rows, (98, "Londonderry and Mariana keep no secret here")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(frame).collect()}
    for i, text in rows:
        assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[i].split(","))] == hidden
    assert got[98] == ""


def test_names_of_columns_do_not_clash(spark):
    frame = spark.createDataFrame([(1, "mail a@b.cd", "keep", "k", "q", "s", "w")], "doc_id long, text string, __base string, __text string, quality string, pii_spans string, PII_BASE string")
    got = pii.redact(frame)
    assert got.columns == frame.columns and tuple(got.first()) == (1, "mail [EMAIL]", "keep", "k", "q", "s", "w")
    kept = quality.select_documents(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert kept.columns == frame.columns and tuple(kept.first()) == tuple(frame.first())


def test_redaction_of_many_and_overlapping_spans(spark):
    import time

    rng = random.Random(3)
    rows = []
    for n in (0, 1, 5, 64, 65, 200, 700):
        text = "".join(rng.choice("abcé🎉 ") for _ in range(4 * n + 30))
        spans = sorted((a, rng.randrange(4), min(len(text), a + rng.randrange(1, 9)), rng.choice(["email", "ip"])) for a in (rng.randrange(len(text)) for _ in range(n)))
        rows.append((text, spans))
    frame = spark.createDataFrame(rows, "t string, s array<struct<start:int,rank:int,end:int,kind:string>>")
    for r in frame.select("t", "s", pii.redacted(F.col("t"), F.col("s")).alias("x")).collect():
        out, at = "", 0
        for a, _, e, k in r.s:
            if a >= at:
                out += r.t[at:a] + f"[{k.upper()}]"
            at = max(at, e)
        assert r.x == out + r.t[at:]
    long = spark.createDataFrame([(1, "a@b.cd " * 100_000)], "doc_id long, text string")
    began = time.time()
    assert pii.redact(long).first().text == "[EMAIL] " * 100_000
    assert time.time() - began < 30


def test_quality_equals_plain_loops(spark):
    """Each probability from single features, and rows that repeat a rated id."""
    import numpy as np

    docs = table(spark, SMALL, "documents")
    again = docs.unionAll(docs.where("doc_id % 3 = 0")).unionAll(docs.withColumn("text", F.lit("other text")))
    labels = table(spark, SMALL, "labels")
    model = quality.train(again, labels, quality.label_grade(), top=2)
    texts = ["", "Some words, some WORDS 12 times.", "### $$$ 123"] + [r.text for r in docs.limit(20).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.scored(frame, model, 2).collect():
        words = quality.hashed_words([r.text.encode()])[0][0]
        heads = [h for first in quality.PREFIXES for h in quality.hashed_words([r.text.encode()], (first,))[0][0].tolist()]
        found = {int(h) >> 46 for h in [*words.tolist(), *heads]}
        kinds = [int(quality.KIND[b]) for b in r.text.encode()]
        solid, n = max(1, len(kinds) - kinds.count(1)), max(1, len(words))
        shares = [kinds.count(2) / solid, kinds.count(4) / solid, kinds.count(5) / solid, kinds.count(6) / solid, 1 - len(set(words.tolist())) / n, kinds.count(0) / solid]
        steps = [int(min(11, max(0, np.ceil(np.log2(max(x, 1e-4) * 1024))))) for x in shares] + [min(11, int(solid / n)), min(11, n.bit_length())]
        score = sum(float(np.float32(model.weights[f])) for f in found) + sum(float(np.float32(model.weights[quality.WORDS + i * quality.STEPS + x])) for i, x in enumerate(steps))
        below = [1 / (1 + np.exp(score - t)) for t in model.thresholds]
        assert abs(r.quality.tail_probability - (1 - below[1])) < 1e-6
        assert abs(r.quality.expected_grade - ((below[1] - below[0]) + 2 * (1 - below[1]))) < 1e-6


def test_quality_grades(spark):
    rng = random.Random(2)
    good = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(good) for _ in range(rng.randrange(5, 80))]
        grade = i % 3
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "vilely"])
        elif grade == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, 0 if grade == 1 else 1, int(grade == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (7000, ""), (7001, "w1 " * 50_000)], "doc_id long, text string").withColumn("quality", F.lit(1))
    got = quality.grade_documents(docs, spark.createDataFrame([*labels, (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert len(kept) == 603
    held_out = [i for i in range(450, 600)]
    assert sum(kept[i] == (i % 3 == 2) for i in held_out) >= 0.95 * len(held_out)
    for r in got.collect():
        assert 0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 and r.kept == (r.tail_probability >= 0.5)
    none = quality.grade_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("NOT kept").count() == 0
    assert quality.grade_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    fitted, held = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    got = quality.grade_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), fitted).join(held, "doc_id")
    toxic, junk, clean = (got.where(c).agg(F.avg(F.col("kept").cast("double"))).first()[0] for c in ("toxic = 1", "toxic = 0 AND quality = 0", "toxic = 0 AND quality = 1"))
    assert toxic <= 0.05 and junk <= 0.1 and clean >= 0.97


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    first = pipeline.quality_stage(spark, docs, SMALL)
    assert first.columns == docs.columns
    kept = {r.doc_id for r in quality.grade_documents(docs, table(spark, SMALL, "labels")).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and kept
    second = pipeline.near_duplicate_stage(spark, docs, SMALL)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sys.path.insert(0, os.path.dirname(__file__))
    from test_duplicates import brute

    assert {r.doc_id for r in second.collect()} == {d for d, _, _, k in brute(rows, 80) if k}
    third = pipeline.pii_stage(spark, docs, SMALL)
    assert third.columns == docs.columns and third.count() == docs.count()
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for r in third.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        if not spans[r.doc_id]:
            assert r.text == r.old
        else:
            out, at = "", 0
            for k, a, b in (s.split(":") for s in spans[r.doc_id].split(",")):
                if int(a) >= at:
                    out += r.old[at : int(a)] + f"[{k.upper()}]"
                at = max(at, int(b))
            assert r.text == out + r.old[at:]
        assert r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, "a b c d e f", "x"), (None, "A b  c d e f", "y"), (5, "q r s t u v", "1"), (5, "q r s t u v", "0"), (6, "q r s t u v", "z"), (None, "", "e"), (None, None, "e"), (7, None, "n"), (8, "", "n"), (None, "", "e")], "doc_id long, text string, component string")
    one = pipeline.near_duplicate_stage(spark, odd, SMALL)
    assert one.columns == odd.columns
    assert sorted(map(tuple, one.collect()), key=str) == sorted([(None, "A b  c d e f", "y"), (5, "q r s t u v", "0"), (None, "", "e"), (None, "", "e"), (None, None, "e"), (7, None, "n"), (8, "", "n")], key=str)
    for stage in (pipeline.quality_stage, pipeline.near_duplicate_stage, pipeline.pii_stage):
        got = stage(spark, odd, SMALL)
        assert got.columns == odd.columns and got.count() >= 1 and stage(spark, odd.limit(0), SMALL).count() == 0
    packed = pipeline.packing_stage(spark, docs, SMALL)
    import zlib

    import numpy as np
    from test_tokens import packed as encoder

    encode = encoder(None)
    want = {r.doc_id: encode(r.text) for r in docs.collect()}
    pieces = {}
    for r in packed.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in pieces.items()} == want
    assert pipeline.packing_stage(spark, docs.limit(0), SMALL).count() == 0
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "pii", "packing"]
    assert pipeline.run(spark, SMALL).select("doc_id").distinct().count() <= len(kept)
