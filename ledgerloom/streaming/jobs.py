"""Structured Streaming jobs, each run until its source is used up."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date as Date
from decimal import ROUND_HALF_UP, Decimal
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions.similarity import PLAIN
from ledgerloom.plans.rules import Key, Rule, ordered
from ledgerloom.session import delete_folder, kept, shared

# Fixed value: days that a record stays in the pool.
POOL_DAYS = 7
# Buckets to which groups are dealt, records in a part of a bucket's state.
BUCKETS = 1024
PART_RECORDS = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` as a file stream, and the folder to remove when it is done."""
    spark, folder = rows.sparkSession, shared(rows.sparkSession, "rows")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder), folder


def finish(frame: DataFrame, source: str) -> DataFrame:
    """Run a stream over what there is, and give what it wrote; its folders go."""
    spark, folder = frame.sparkSession, shared(frame.sparkSession, "stream")
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = kept(spark.read.schema(frame.schema).parquet(f"{folder}/out"), folder)
    delete_folder(spark, source)
    return out


def dedup(deliveries: DataFrame, minutes: int = 10) -> DataFrame:
    """Streamed deliveries (delivery_key, at, ...) without those whose key came before within the time."""
    stream, folder = stream_of(deliveries)
    return finish(stream.withWatermark("at", f"{minutes} minutes").dropDuplicatesWithinWatermark(["delivery_key"]), folder)


def incremental(rows: DataFrame, keys: list, measures: dict[str, str], files_a_batch: int = 1) -> DataFrame:
    """Sums of partial aggregates of a stream: each batch adds its own partial rows to a table, and reading adds these up.

    ``keys`` are Columns, ``measures`` has SQL aggregates that may be summed (counts and sums) by name. The stream holds no state.
    """
    spark = rows.sparkSession
    folder, table = shared(spark, "rows"), shared(spark, "partial")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(*[F.expr(sql).alias(n) for n, sql in measures.items()]).write.mode("overwrite").parquet(f"{table}/out/batch={batch_id}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{table}/state").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(f"{table}/out")
    names = [c for c in read.columns if c not in measures and c != "batch"]
    out = kept(read.groupBy(*names).agg(*[F.sum(n).alias(n) for n in measures]), table)
    delete_folder(spark, folder)
    return out


# ---------------------------------------------------------------- matching on a stream
def plain_bucket(amount: Decimal, key: Key) -> int:
    """The number of an amount's band, as the batch has it."""
    if key.steps is not None:
        return key.steps * ((amount > 0) - (amount < 0))
    return int((amount / (2 * key.amount if key.amount else 1)).quantize(Decimal(1), ROUND_HALF_UP))


def plain_rank(key: Key, a, b) -> int | None:
    """The rank of a candidate by one key, or None if the two do not meet by it."""
    if key.kind == "exact":
        return 0 if a == b else None
    if a is None or b is None:
        return 0 if a is b else None
    gap = (b - a).days if key.kind == "date_window" else plain_bucket(b, key) - plain_bucket(a, key)
    return max(0, gap) if abs(gap) <= (2 * key.days if key.kind == "date_window" else 2) else None


def plain_match(incoming: dict, pool: list[dict], rules: list[Rule]) -> tuple[int, float, str, str] | None:
    """The place in the pool, score, status and rule of a record's match: the first rule by which some candidate reaches the suggestion.

    Ties go to the smaller ranks and then to the earlier place.
    """
    for rule in rules:
        best = None
        for at, other in enumerate(pool):
            ranks = [plain_rank(k, incoming.get(k.field), other.get(k.field)) for k in rule.keys]
            if None in ranks or other["id"] == incoming["id"]:
                continue
            scores = [PLAIN[s.method](incoming.get(s.field), other.get(s.field)) for s in rule.scores]
            total = round(sum((0.0 if x < s.least else x) * s.weight for x, s in zip(scores, rule.scores, strict=True)), 9)
            if total >= rule.suggest and (best is None or (-total, ranks, at) < best):
                best = (-total, ranks, at)
        if best:
            return best[2], -best[0], "AUTO" if -best[0] >= rule.auto else "SUGGESTED", rule.name
    return None


FIELDS = ("id", "reference", "counterparty_ref", "currency", "side", "account_id")


def _cell_width(rules: list[Rule]) -> Decimal | None:
    """Amounts that may meet by some rule lie in the same cell of this width or in neighbours; None if a rule has no band of fixed width."""
    widths = [max((6 * k.amount for k in r.keys if k.kind == "numeric" and k.field == "base_amount" and k.amount), default=None) for r in rules]
    return None if not widths or None in widths else max(widths)


class Pool(StatefulProcessor):
    """The pools of a bucket of groups: records by group and cell of the amount, in the order of their coming.

    A call to the state store costs far more than a record, so what the store holds is parts of about ``PART_RECORDS`` records each,
    to which groups and cells are dealt by hash. A record reads the parts of its cells, a batch each part once; as a bucket grows,
    its parts are split in two, one at a time.
    """

    def __init__(self, rules: list[Rule], keys: tuple[str, ...], readd: bool, as_of: int | None):
        self.rules, self.keys, self.readd, self.as_of = rules, keys, readd, as_of
        self.width = _cell_width(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part long", "entries string")
        self.size = handle.getValueState("size", "parts long, records long")

    def _cell(self, amount: Decimal) -> int:
        return 0 if self.width is None else int(amount // self.width) if amount >= 0 else -int(-amount // self.width) - 1

    @staticmethod
    def _place(group: str, cell: int | None, n: int) -> int:
        """The part, of ``n``, of a cell; what was last seen of a group (no cell) lies with its cell 0."""
        return crc32(f"{cell or 0} {group}".encode()) % n

    def _read(self, part: int) -> dict[tuple[str, int | None], list]:
        """A part as it is stored: records by group and cell, and the last number and newest day by group."""
        text = self.parts.getValue((part,)) if self.before and part < self.before else None
        return {(group, cell): entries for group, cell, entries in json.loads(text[0])} if text else {}

    def _write(self, part: int, entries: dict[tuple[str, int | None], list]) -> None:
        held = [(*at, x) for at, x in entries.items() if x]
        if held:
            self.parts.updateValue((part,), (json.dumps(held, ensure_ascii=False, separators=(",", ":")),))
        elif part < self.before:
            self.parts.removeKey((part,))

    def _split(self, n: int) -> None:
        """Deal what is stored anew to ``n`` parts, a multiple of those before."""
        for part in range(self.before):
            dealt: dict[int, dict] = {part: {}}
            for at, x in self._read(part).items():
                dealt.setdefault(self._place(*at, n), {})[at] = x
            for to, entries in dealt.items():
                self._write(to, entries)
        self.before = n

    def _part(self, group: str, cell: int | None) -> dict[tuple[str, int | None], list]:
        part = self._place(group, cell, self.n)
        if part not in self.held:
            self.held[part] = {at: x if at[1] is None else [{"seq": r[0], "day": r[1], "value_date": Date.fromordinal(r[1]), "base_amount": Decimal(r[2]), **dict(zip(FIELDS, r[3:], strict=True))} for r in x] for at, x in self._read(part).items()}
        return self.held[part]

    def _load(self, group: str, cell: int) -> list[dict]:
        return self._part(group, cell).setdefault((group, cell), [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.held: dict[int, dict] = {}
        incoming = sorted((r for frame in rows for r in zip(*(frame[c] for c in ("arrival", "id", "key", "day", "amount", *FIELDS)), strict=True)), key=lambda r: r[:2])
        self.before, records = self.size.get() if self.size.exists() else (0, 0)
        self.n = self.before or 1
        while self.n * PART_RECORDS < records + len(incoming):
            self.n *= 2
        if self.before and self.n > self.before:
            self._split(self.n)
        out = []
        for _, own_id, group, day, amount, *texts in incoming:
            day, exact = int(day), dict(zip(self.keys, json.loads(group), strict=True))
            record = dict(zip(FIELDS, texts, strict=True)) | exact | {"day": day, "value_date": Date.fromordinal(day), "base_amount": Decimal(amount)}
            own = self._cell(record["base_amount"])
            near = [own] if self.width is None else [own - 1, own, own + 1]
            held = {c: self._load(group, c) for c in near}
            pool = sorted((x["seq"], c, i) for c in near for i, x in enumerate(held[c]))
            found = plain_match(record, [exact | held[c][i] for _, c, i in pool], self.rules) if pool else None
            matched = found is not None and found[2] == "AUTO"
            if matched:
                at, score, _, rule = found
                _, c, i = pool[at]
                out.append((own_id, held[c].pop(i)["id"], score, rule, "AUTO_MATCHED_STREAMING"))
                records -= 1
            last = self._part(group, None).setdefault((group, None), [0, 0])
            last[1] = max(last[1], day)
            limit = (self.as_of or last[1]) - POOL_DAYS
            if self.readd or not matched:
                last[0] += 1
                held[own].append(record | {"seq": last[0]})
                records += 1
            for c in near:
                if any(x["day"] < limit for x in held[c]):
                    stay = [x for x in held[c] if x["day"] >= limit]
                    records -= len(held[c]) - len(stay)
                    held[c][:] = stay
        for part, entries in self.held.items():
            self._write(part, {at: x if at[1] is None else [(r["seq"], r["day"], str(r["base_amount"]), *(r[f] for f in FIELDS)) for r in x] for at, x in entries.items()})
        self.size.update((self.n, records))
        yield pd.DataFrame(out, columns=["id", "other_id", "score", "rule", "status"])

    def close(self) -> None:
        pass


def group_keys(rules: list[Rule]) -> tuple[str, ...]:
    """The exact keys that all rules share: records that differ in one can never meet."""
    shared_keys = set.intersection(*[{k.field for k in r.keys if k.kind == "exact"} for r in rules]) if rules else set()
    return ("tenant_id", *sorted(k for k in shared_keys if k != "tenant_id" and not k.startswith("extra.")))


def pool_match(records: DataFrame, rules: list[Rule], readd: bool = True, as_of: Date | None = None) -> DataFrame:
    """``id, other_id, score, rule, status``: a stream's provisional matches of each record with its tenant's pool of the last days.

    Records (id, tenant_id, value_date, base_amount, arrival, and texts that rules name) are matched in the order of their arrival by the rules that may
    run on a stream. A match by AUTO is written and takes its partner out of the pool; the record itself joins the pool even then, unless
    ``readd`` is false; a suggestion only keeps later rules from the record. Records whose date is more than ``POOL_DAYS`` before
    ``as_of`` (by default the newest date that their group has seen) leave when their neighbourhood is next written.

    A group has the tenant and the exact keys that all rules share. Its records are in order, so one task has a group; groups are dealt
    to ``BUCKETS`` buckets, whose state is in parts of which a record reads those of three cells of the amount.
    """
    spark = records.sparkSession
    usable = ordered([r for r in rules if r.streaming])
    empty = spark.createDataFrame([], MATCHES)
    if not usable:
        return empty
    stream, folder = stream_of(pool_input(records, usable))
    return finish(pool_stream(stream, usable, readd, as_of), folder)


MATCHES = "id string, other_id string, score double, rule string, status string"


def pool_input(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """The columns of ``records`` that ``pool_stream`` reads, with their group and its bucket."""
    text = lambda f: F.col(f).cast("string").alias(f) if f in records.columns else F.lit(None).cast("string").alias(f)
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in group_keys(rules)]))
    day = F.unix_date(F.col("value_date").cast("date")).cast("long") + Date(1970, 1, 1).toordinal()
    return records.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), key.alias("key"), *[text(f) for f in FIELDS], day.alias("day"), F.col("base_amount").cast("string").alias("amount"), F.col("arrival").cast("long").alias("arrival"))


def pool_stream(stream: DataFrame, rules: list[Rule], readd: bool = True, as_of: Date | None = None) -> DataFrame:
    """The matches of a stream of ``pool_input`` by rules that may run on one."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = Pool(rules, group_keys(rules), readd, as_of.toordinal() if as_of else None)
    return stream.groupBy("bucket").transformWithStateInPandas(processor, MATCHES, "append", "none")
