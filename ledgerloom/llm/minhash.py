"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``side`` half keys are made, each half key from ``rows`` minhashes. A table key
combines one half key of either collection, so ``2 * side * rows`` minhashes serve ``side * side`` tables
of ``2 * rows`` rows. With the defaults a pair of similarity 0.85 shares a table with probability 0.9998
from 60 minhashes; separate tables would take 600.

1. One pass over the texts gives each document's number of shingles, a fingerprint of its whole set, and its
   half keys. Documents with equal sets form a class; only its smallest id goes on, so copies cost nothing.
2. Half keys that only one class has cannot lead to a shared table key, so table keys are formed from the
   shared ones only. Buckets with the same members count once.
3. In each bucket all members are compared with the smallest one; links are confirmed on the full sets and
   joined to components. Then the members of a bucket that are still in different components are compared,
   a block of members with a block at a time. So each pair that shares a table is compared unless it is
   connected already, and no bucket is turned into all of its pairs. Before a pair's sets are fetched, a
   sketch of either (the minhashes, or the least hashes of 512 ranges) must come within 4.4 standard
   deviations of the threshold.

A link means ``100 * intersection >= percent * union`` of the sets of shingles. Shingles are compared by
64-bit hashes of all their words.

Defined results: words are runs of characters other than space and 0x09-0x0D, A-Z in lower case; a text with
fewer words than a shingle has is one shingle; a null or empty text has no shingles and no links; a null id
is its own component (null); rows that share an id count as linked, and each row is returned; other columns
are ignored; an empty table gives an empty result. Sets of one text are built in memory (about 40 bytes a
character).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpoint_dir, cut, delete_folder
from ledgerloom.llm.graph import components

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype="u8") | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACE = _rng.integers(1, 2**63, 64, dtype="u8") | np.uint64(1)
#: Ranges of the hash that the fine sketch has, their starts, and their width less one.
BINS = 512
EDGES = np.arange(BINS, dtype="u8") << np.uint64(55)
WIDTH = np.uint64((1 << 55) - 1)
#: Standard deviations that a sketch's estimate may fall short of the threshold.
SPREAD = 4.4
#: Members of a bucket that a task compares at once.
BLOCK = 512
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 20), base, dtype="u8")
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes], firsts: tuple[int, ...] = (0,)) -> list[list[np.ndarray]]:
    """For each of ``firsts``: a 64-bit hash for each word of each text (0), or for the first bytes of each longer word."""
    if not texts:
        return [[] for _ in firsts]
    joined = np.frombuffer(b" ".join([*texts, b""]).lower(), dtype="u1")
    gap = SPACE[joined]
    start = np.nonzero(~gap & np.concatenate([[True], gap[:-1]]))[0]
    end = np.nonzero(~gap & np.concatenate([gap[1:], [True]]))[0] + 1
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(BYTE[joined] * _power(BASE, len(joined)), dtype="u8")])
    inverse = _power(BASE_INVERSE, len(joined) + 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])[:-1]
    out = []
    for first in firsts:
        a, b = (start, end) if not first else (start[end - start > first], start[end - start > first] + first)
        hashes = _mix((total[b] - total[a]) * inverse[a] + (b - a).astype("u8"))
        out.append(np.split(hashes, np.searchsorted(a, bounds)))
    return out


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text."""
    return hashed_words(texts)[0]


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text's words."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return _mix(np.array([(words * PLACE[:n]).sum(dtype="u8") + np.uint64(n)], dtype="u8"))
    total = np.zeros(n - width + 1, "u8")
    for i in range(width):
        total += words[i : n - width + 1 + i] * PLACE[i]
    return np.unique(_mix(total))


class Sketch:
    """Minhashes of a set, 32 bits each."""

    def __init__(self, count: int):
        rng = np.random.default_rng(977)
        self.count = count
        self.times = rng.integers(1, 2**63, count, dtype="u8") * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 2**63, count, dtype="u8")

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.count, np.iinfo("u8").max, dtype="u8")
        for at in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[at : at + 4096, None] * self.times + self.plus).min(axis=0), out=least)
        return (_mix(least) >> np.uint64(32)).astype("u4").view("i4")


def _features(docs: DataFrame, width: int, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(count)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, one, two, sketches = [], [], [], []
                for words in word_hashes([(x or "").encode() for x in batch.column(1).to_pylist()]):
                    shingles = shingle_set(words, width)
                    n.append(len(shingles))
                    one.append(int(shingles.sum(dtype="u8").view("i8")))
                    two.append(int(_mix(shingles + PLACE[7]).sum(dtype="u8").view("i8")))
                    sketches.append(sketch.of(shingles))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype="i4") * count), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists], names=["doc_id", "n_shingles", "one", "two", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, one long, two long, sketch array<int>")


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each of ``BINS`` equal ranges, 16 bits each; 0 where a range is empty."""
    at = np.searchsorted(shingles, EDGES)
    first = shingles[np.minimum(at, len(shingles) - 1)]
    return np.where((at < len(shingles)) & (first - EDGES <= WIDTH), (first & np.uint64(0xFFFF)) | np.uint64(1), np.uint64(0)).astype("u2")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles``: each text's sorted set as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(w, width) for w in word_hashes([x.encode() for x in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _common(one: np.ndarray, two: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    return int((two[np.minimum(at, len(two) - 1)] == one).sum())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                common = _common(one, two)
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _across_components(torn: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between members of a bucket that are in different components, a forest of them for each block.

    ``torn`` has a row for each bucket (``keys`` of (key, size)) and member. A bucket is cut into blocks of
    about ``BLOCK`` members, and a task compares two blocks, so that no task holds a whole bucket. A pair is
    compared in the first bucket that both are in: sizes first, then fine sketches, then the full sets; pairs
    that links of the block have connected meanwhile are left out.
    """
    rows = torn.withColumn("shared", F.array_sort(F.col("keys.key"))).withColumn("k", F.explode("keys")).drop("keys")
    sized = rows.withColumn("blocks", F.ceil(F.col("k.size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(F.col("k.key").alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "comp", "shared", "shingles")
    share = percent / 100
    columns = ("key", "i", "j", "own", "rep", "n", "comp")

    def compare(rows: dict[str, np.ndarray | list]) -> Iterator[tuple[int, int]]:
        key, i, j = rows["key"][0], rows["i"][0], rows["j"][0]
        own, rep, n, comp = rows["own"], rows["rep"], rows["n"], rows["comp"].copy()
        sets = [np.frombuffer(x, "u8") for x in rows["shingles"]]
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        if len(np.unique(comp)) < 2:
            return
        fine = np.stack([fine_sketch(x) for x in sets])
        filled = fine != 0
        wide = max(map(len, rows["shared"]))
        shared = np.stack([np.pad(x, (0, wide - len(x)), mode="edge") for x in rows["shared"]])
        for at, x in enumerate(left):
            near = left[at + 1 :] if i == j else right
            near = near[(comp[near] != comp[x]) & (100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x]))]
            if not len(near):
                continue
            same = ((fine[near] == fine[x]) & filled[x]).sum(axis=1)
            used = (filled[near] | filled[x]).sum(axis=1)
            near = near[same >= share * used - SPREAD * np.sqrt(share * (1 - share) * used)]
            earlier = shared[x][shared[x] < key]
            if len(earlier) and len(near):
                near = near[~np.isin(shared[near], earlier).any(axis=1)]
            for y in near:
                if comp[x] != comp[y]:
                    both = _common(sets[x], sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        yield int(rep[x]), int(rep[y])
                        comp[comp == comp[y]] = comp[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def done() -> Iterator[pa.RecordBatch]:
            found = list(compare({k: np.concatenate(v) if k in columns else [x for part in v for x in part] for k, v in held.items()})) if held else []
            held.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            got: dict[str, np.ndarray | list] = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in columns}
            got["shingles"] = batch.column("shingles").to_pylist()
            got["shared"] = [np.array(x, "i8") for x in batch.column("shared").to_pylist()]
            change = np.nonzero((np.diff(got["key"]) != 0) | (np.diff(got["i"]) != 0) | (np.diff(got["j"]) != 0))[0] + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and any(held[k][-1][-1] != got[k][a] for k in ("key", "i", "j")):
                    yield from done()
                for k, v in got.items():
                    held.setdefault(k, []).append(v[a:b])
        yield from done()

    return spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, rows: int = 3, side: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count = 2 * side * rows
    least = max(1, int(count * percent / 100 - SPREAD * (count * percent / 100 * (1 - percent / 100)) ** 0.5))
    features = cut(_features(source, width, count))
    classes = cut(features.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch")))

    half = F.transform(F.sequence(F.lit(0), F.lit(2 * side - 1)), lambda i: F.xxhash64(i, F.slice("sketch", i * rows + 1, F.lit(rows))))
    halves = classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode(half).alias("i", "h"))
    shared = halves.groupBy("i", "h").agg(F.count("*").alias("c")).where("c > 1").select("i", "h")
    live = halves.join(shared, ["i", "h"], "left_semi")
    first = F.collect_list(F.when(F.col("i") < side, F.struct("i", "h")))
    second = F.collect_list(F.when(F.col("i") >= side, F.struct("i", "h")))
    sides = live.groupBy("rep", "n").agg(first.alias("p"), second.alias("q"))  # at most 2 * side entries
    keys = sides.select("rep", "n", F.explode("p").alias("p"), "q").select("rep", "n", "p", F.explode("q").alias("q")).select(F.xxhash64("p.i", "p.h", "q.i", "q.h").alias("key"), "rep", "n")
    buckets = keys.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"), F.min(F.struct("rep", "n")).alias("hub")).where("c > 1")
    chosen = buckets.groupBy("c", "mark", "hub").agg(F.min("key").alias("key"))
    members = cut(keys.join(chosen.select("key", "hub"), "key").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))

    sized = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    folder = f"{checkpoint_dir(spark)}/sets-{uuid.uuid4().hex}"
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    own = _sets(source.join(wanted, "doc_id", "left_semi").where("text IS NOT NULL"), width)
    own.groupBy("doc_id", F.xxhash64("shingles").alias("h")).agg(F.any_value("shingles").alias("shingles")).drop("h").write.parquet(folder)
    sets = spark.read.parquet(folder)

    sketches = classes.select("rep", "sketch")
    hubs = members.where((F.col("rep") != F.col("hub")) & sized(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    agree = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda same: same))
    tried = cut(
        hubs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
        .where(agree >= least)
        .select("a", "b")
    )
    links = cut(_confirm(tried, sets, percent))
    found = components(links)

    placed = members.join(found, members["rep"] == found["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("size")).where("parts > 1").select("key", "size")
    torn = placed.join(open_keys, "key").groupBy("rep", "n", "comp").agg(F.collect_list(F.struct("key", "size")).alias("keys"))  # at most side ** 2 keys
    more = cut(_across_components(torn.join(sets, torn["rep"] == sets["doc_id"]).drop("doc_id"), percent))
    if more.limit(1).count():
        found = components(links.unionAll(more))

    delete_folder(spark, folder)
    named = classes.select("one", "two", "n_shingles", "rep").join(found, F.col("rep") == F.col("node"), "left").select("one", "two", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = features.select("doc_id", "n_shingles", "one", "two").join(named, ["one", "two", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, rows: int = 3, side: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest id; its columns are those of ``docs``.

    Of rows that share an id one stays (the first by its columns' values). Rows with a null id are in no group; of those with
    the same words in the same order one stays, and those without words all stay, as do other rows without words.
    """
    found = near_duplicates(docs, percent, width, rows, side, id_col, text_col)
    ids = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = cut(ids.where("NOT kept OR n > 1"))  # most documents are neither, so only few ids are joined
    plain = docs.join(odd.select(F.col("id").alias(id_col)), id_col, "left_anti").where(F.col(id_col).isNotNull()).select(*docs.columns)
    first = lambda group: group.agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    again = first(docs.join(odd.where("kept").select(F.col("id").alias(id_col)), id_col, "left_semi").select(*docs.columns).groupBy(id_col))
    nameless = docs.where(F.col(id_col).isNull())
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+", " "))
    return plain.unionByName(again).unionByName(first(nameless.where(words != "").groupBy(F.sha2(words, 256)))).unionByName(nameless.where(words == ""))
