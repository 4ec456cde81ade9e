"""Connectors: what a source offers, and the registry that makes one from its type and settings.

A connector reads raw records ``tenant_id, connector_id, batch_id, source_format, payload``. The pipeline does not care where
they come from. Connectors written outside the library register here, or as a Spark data source by ``as_data_source``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.operators.notify import delivery_key, verify_incoming
from ledgerloom.sources import files, mt940

RAW = "tenant_id string, connector_id string, batch_id string, source_format string, payload string"
# Fixed values of the receiver: bytes of a request, minutes in which a delivery is not taken twice, requests that may wait.
REQUEST_BYTES = 5 << 20
AGAIN_MINUTES = 10
WAITING = 1000


class Connector(ABC):
    """One configured source; ``settings`` has tenant_id, connector_id, batch_id and what the type needs."""

    needs: tuple[str, ...] = ()
    streaming = False

    def __init__(self, settings: dict):
        self.settings = settings

    def problems(self) -> list[str]:
        """What is wrong with the settings."""
        return [f"{name} is missing" for name in ("tenant_id", "connector_id", *self.needs) if not self.settings.get(name)]

    @abstractmethod
    def payloads(self, spark: SparkSession) -> DataFrame:
        """``payload`` and what else the source knows."""

    def fetch(self, spark: SparkSession) -> DataFrame:
        """Raw records."""
        if self.problems():
            raise ValueError("; ".join(self.problems()))
        s = self.settings
        return self.payloads(spark).select(F.lit(s["tenant_id"]).alias("tenant_id"), F.lit(s["connector_id"]).alias("connector_id"), F.lit(s.get("batch_id", "")).alias("batch_id"), F.lit(s["type"]).alias("source_format"), "payload")

    def checkpoint(self) -> DataFrame | None:
        """What the next fetch must know, for sources that read again and again."""
        return None


class Csv(Connector):
    needs = ("path",)

    def payloads(self, spark):
        return files.csv_payloads(spark, self.settings["path"])


class Workbook(Connector):
    needs = ("path",)

    def payloads(self, spark):
        return files.scan_workbooks(spark, self.settings["path"])


class Statements(Connector):
    """Statement files; those whose time of change is in ``seen`` are not read again."""

    needs = ("path",)
    polled: DataFrame | None = None

    def payloads(self, spark):
        self.seen = self.settings.get("seen")
        if self.seen is None:
            self.seen = spark.createDataFrame([], "path string, modified timestamp")
        self.polled = files.poll(spark, self.settings["path"], self.seen)
        messages = self.polled.select(F.xxhash64("path", "modified").alias("statement_id"), F.col("content").cast("string").alias("message"))
        return mt940.payloads(mt940.parse(messages, self.settings.get("dialect", "generic")))

    def checkpoint(self):
        return None if self.polled is None else files.seen_after(self.seen, self.polled)


class JsonLines(Connector):
    needs = ("path",)

    def payloads(self, spark):
        return spark.read.text(self.settings["path"]).select(F.col("value").alias("payload"))


class Queue(Connector):
    """A Kafka topic; needs Spark's connector for it on the class path."""

    needs = ("brokers", "topic")
    streaming = True

    def options(self) -> dict[str, str]:
        """Settings as the connector's options: plain, SASL (PLAIN or SCRAM) over TLS, or mutual TLS."""
        s = self.settings
        out = {"kafka.bootstrap.servers": s["brokers"], "subscribe": s["topic"], "startingOffsets": s.get("from", "earliest")}
        security = s.get("security", "PLAINTEXT")
        if security == "PLAINTEXT":
            return out
        out["kafka.security.protocol"] = "SASL_SSL" if security == "SASL_SSL" else "SSL"
        if security == "SASL_SSL":
            mechanism = s.get("mechanism", "PLAIN")
            if mechanism not in ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512"):
                raise ValueError(f"mechanism {mechanism}")
            module = "plain.PlainLoginModule" if mechanism == "PLAIN" else "scram.ScramLoginModule"
            quoted = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'
            out |= {"kafka.sasl.mechanism": mechanism, "kafka.sasl.jaas.config": f"org.apache.kafka.common.security.{module} required username={quoted(s['user'])} password={quoted(s['password'])};"}
        elif security == "MTLS":
            out |= {"kafka.ssl.keystore.location": s["keystore"], "kafka.ssl.truststore.location": s["truststore"]}
        else:
            raise ValueError(f"security {security}")
        return out

    def payloads(self, spark):
        return spark.readStream.format("kafka").options(**self.options()).load().select(F.col("value").cast("string").alias("payload"))


REGISTRY: dict[str, Callable[[dict], Connector]] = {"csv": Csv, "workbook": Workbook, "mt940": Statements, "jsonl": JsonLines, "kafka": Queue}


def register(kind: str, make: Callable[[dict], Connector]) -> None:
    """Add a type; one that is there already is an error."""
    if kind in REGISTRY:
        raise ValueError(f"connector {kind!r} is registered")
    REGISTRY[kind] = make


def create(kind: str, settings: dict) -> Connector:
    """A connector of a registered type."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown connector {kind!r}")
    return REGISTRY[kind](settings | {"type": kind})


# ---------------------------------------------------------------- extensions
def as_data_source(kind: str, parts: Callable[[dict], list], read: Callable[[dict, object], Iterator[str]]) -> type[DataSource]:
    """A Spark data source of raw payloads: ``parts`` splits the work on the driver, ``read`` gives a part's payloads on an executor.

    Register it with ``spark.dataSource.register`` and read it with ``spark.read.format(kind).options(...).load()``.
    """

    class Part(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [Part(p) for p in parts(self.options)]

        def read(self, partition):
            for payload in read(self.options, partition.value):
                yield (payload,)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return "payload string"

        def reader(self, schema):
            return Reader(dict(self.options))

    return Source


# ---------------------------------------------------------------- receiver
def received(requests: DataFrame, scheme: str, secret: str, waiting: int = WAITING) -> DataFrame:
    """``request_id, status, delivery_key`` of HTTP requests (request_id, at, method, delivery_id, signature, body) in the order of their arrival.

    405 for other methods than POST, 413 for a body that is too large, 401 for a wrong signature, 200 for a delivery that came in the
    last ten minutes before (it is not taken again), 503 for those beyond what may wait, 202 for those taken. A key that is not taken
    does not start its ten minutes. Deliveries of one key stream through a task in order, which keeps one time.
    """
    body = F.coalesce("body", F.lit(""))
    early = F.when(F.col("method") != "POST", 405).when(F.octet_length(body) > REQUEST_BYTES, 413).when(~verify_incoming(scheme, F.col("signature"), body, F.lit(secret)), 401)
    rows = requests.select("request_id", "at", early.alias("early"), delivery_key(F.col("delivery_id"), body).alias("delivery_key"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            fresh = []
            for k, t in zip(frame["delivery_key"], frame["t"], strict=True):
                taken = k != key or t - last >= AGAIN_MINUTES * 60_000_000
                key, last = k, t if taken else last
                fresh.append(taken)
            yield pd.DataFrame({"request_id": frame["request_id"], "fresh": fresh})

    kind = requests.schema["request_id"].dataType.simpleString()
    keyed = rows.where("early IS NULL").select("delivery_key", F.unix_micros("at").alias("t"), "request_id").repartition("delivery_key").sortWithinPartitions("delivery_key", "t", "request_id")
    held = rows.join(keyed.mapInPandas(fold, f"request_id {kind}, fresh boolean"), "request_id", "left")
    first = held.where("fresh").orderBy("at", "request_id").limit(waiting).select("request_id", F.lit(True).alias("held"))
    status = F.coalesce("early", F.when(~F.col("fresh"), 200).when(F.col("held"), 202).otherwise(503))
    return held.join(first, "request_id", "left").select("request_id", status.cast("int").alias("status"), "delivery_key")
