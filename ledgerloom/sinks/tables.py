"""Writes: bulk inserts, two tables under one batch, updates by key, encrypted payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows of a file, so that no insert makes one that is too large to read by a task.
ROWS_A_FILE = 5_000_000


def insert(rows: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows in files of bounded size."""
    writer = rows.write.mode("append").option("maxRecordsPerFile", ROWS_A_FILE)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)


def persist_batch(batch_id: int, folder: str, tables: dict[str, DataFrame]) -> None:
    """Write all tables of one batch; a batch that runs again replaces what it wrote, and readers see those that are complete only.

    Each batch has its own folder of every table; the last thing written is its mark in ``_batches``.
    """
    some = next(iter(tables.values()))
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
    some.sparkSession.range(1).select(F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{folder}/_batches/mark={batch_id}")


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of complete batches, with their numbers as ``batch``."""
    marks = spark.read.parquet(f"{folder}/_batches/mark=*").select(F.col("batch").cast("int").alias("batch"))
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").join(F.broadcast(marks.distinct()), "batch", "left_semi")


def persist_stream(rows: DataFrame, folder: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """A stream each of whose batches writes several tables (transactions and their events, say) or none of them."""

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        persist_batch(batch_id, folder, split(held))
        held.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()


def update_status(rows: DataFrame, ids: DataFrame, status: str, key: str = "id") -> DataFrame:
    """``rows`` with a new status where ``ids`` (key) has them."""
    return rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).drop("__hit")


def upsert_latest(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """One row for each key: the last written; an aggregate that combines before its shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("__r")).select(*keys, "__r.*")


def encrypted(payload: Column, key: Column) -> Column:
    """A payload under AES in GCM mode with a fresh vector; the key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(payload, key)


def decrypted(sealed: Column, key: Column) -> Column:
    """The payload, or null if the key or the bytes are wrong."""
    return F.try_aes_decrypt(sealed, key).cast("string")
