"""File sources: CSV, workbooks, statements, and a poll that reads what has changed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared  # noqa: F401 - callers that write inputs use it

# Fixed value: the largest workbook that is read.
WORKBOOK_BYTES = 50 << 20


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of CSV files with a header; a row of another width keeps its text in ``_corrupt_record`` and has a reason."""
    schema = ", ".join(f"{c} string" for c in [*columns, "_corrupt_record"])
    read = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return read.withColumn("reason", F.when(F.col("_corrupt_record").isNotNull(), "format_parse: wrong number of fields"))


def csv_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``payload, reason``: each row as a JSON object of texts under the names of the first file's header."""
    names = spark.read.option("header", True).csv(path).columns
    rows = scan_csv(spark, path, names)
    return rows.select(F.when(F.col("reason").isNull(), F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).otherwise(F.col("_corrupt_record")).alias("payload"), "reason")


def _cells(content: bytes) -> list[list[str]]:
    """The rows of a workbook's first sheet as texts."""
    book = zipfile.ZipFile(io.BytesIO(content))
    plain = lambda tag: tag.rsplit("}", 1)[-1]
    texts = lambda node: "".join(t.text or "" for t in node.iter() if plain(t.tag) == "t")
    strings = [texts(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for row in (x for x in ElementTree.fromstring(book.read(sheets[0])).iter() if plain(x.tag) == "row"):
        cells: dict[int, str] = {}
        for c in row:
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = len(cells)
            if letters:
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                at -= 1
            value = next((v.text or "" for v in c if plain(v.tag) == "v"), "")
            cells[at] = strings[int(value)] if c.get("t") == "s" and value else texts(c) if c.get("t") == "inlineStr" else value
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


def scan_workbooks(spark: SparkSession, path: str, most: int = WORKBOOK_BYTES) -> DataFrame:
    """``path, row, payload, reason``: rows of the first sheet of each workbook as JSON objects under its header.

    A workbook that is too large or cannot be read has one row with a reason; shorter rows have empty texts, cells beyond the header are left out.
    """
    import json

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, size, content in zip(frame["path"], frame["length"], frame["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError(f"larger than {most} bytes: {size}")
                    header, *rows = _cells(bytes(content)) or [[]]
                    made = [(name, i, json.dumps(dict(zip(header, r + [""] * len(header), strict=False))), None) for i, r in enumerate(rows, 1)]
                except Exception as e:  # noqa: BLE001 - whatever a broken file does, it is that file's reason
                    made = [(name, 0, None, f"format_parse: {e}")]
                yield pd.DataFrame(made, columns=["path", "row", "payload", "reason"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    held = files.select("path", "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))
    return held.mapInPandas(run, "path string, row long, payload string, reason string")


def poll(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """``path, modified, content`` of the files whose time of change is not the one in ``seen`` (path, modified)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "content")
    return files.join(seen.select("path", "modified"), ["path", "modified"], "left_anti")


def seen_after(seen: DataFrame, polled: DataFrame) -> DataFrame:
    """The checkpoint of the next poll."""
    both = seen.select("path", "modified").unionByName(polled.select("path", "modified"))
    return both.groupBy("path").agg(F.max("modified").alias("modified"))


# ---------------------------------------------------------------- objects
def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one object to any store that Hadoop knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(content))
    stream.close()


def get(spark: SparkSession, path: str) -> bytes:
    """Read one object."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def put_encrypted(spark: SparkSession, path: str, content: bytes, key: str) -> None:
    """Write one object under AES."""
    sealed = spark.createDataFrame([(bytearray(content),)], "c binary").select(F.aes_encrypt("c", F.lit(key))).first()[0]
    put(spark, path, bytes(sealed))


def get_encrypted(spark: SparkSession, path: str, key: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select(F.aes_decrypt("content", F.lit(key))).first()[0])
