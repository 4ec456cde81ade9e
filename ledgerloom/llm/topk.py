"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are quantised to integers ``floor(scale * x)``. For a query q and a candidate x that are cut
into segments, Cauchy-Schwarz gives per segment of length n
``q.x <= n * mean_q * mean_x + n * dev_q * dev_x`` (deviations around the segment means), so the squared
distance has the matching lower bound. The bound is evaluated from one segment to ever finer ones;
a candidate is dropped as soon as its bound falls below the query's k-th best score so far, and only
the survivors get an exact product. Every score is an exact integer.

Rows lie in candidate files of at most ``GROUP`` vectors and queries in files of at most ``block``, in the shared folder. A task holds one
candidate file and runs all query files past it. Candidate files are searched in waves, each as large as all before it
together: after a wave the k best of each query are merged and bound the next one, so that a wave adds about k rows a query, however
many files it has. Nothing is broadcast and no vector comes to the driver, which knows the names of files only.

Defined results: a vector that is null, empty, or has a null or non-finite component takes no part,
neither as a query nor as a candidate; vectors of another dimension than the query are no candidates
for it; a row with a null id takes no part; rows that repeat an id each count as a candidate, but never
for a query with their own id, and a repeated query id is searched once for each distinct vector;
ties go to the smaller id; an empty table gives an empty result. Scores beyond the range of a long are
clamped to it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpoint_dir, cut, delete_folder

#: Vectors of a candidate file, and files of the first wave at most.
GROUP = 1 << 15
FIRST_WAVE = 64
#: Number of segments at each resolution, coarse to fine.
RESOLUTIONS = (1, 2, 4, 8, 16)
#: Below this bound sums of products are exact in double precision.
EXACT = float(2**53)
LONG = (-(2**63), 2**63 - 1)


def usable(vector: str) -> Column:
    """True where a vector takes part."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad, F.lit(False))


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(values.astype("f8") * scale)


def segment_stats(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each resolution: segment lengths, means, and deviations (square root of the mean square)."""
    out, dim = [], rows.shape[1]
    for parts in RESOLUTIONS:
        if parts > dim:
            break
        edges = np.linspace(0, dim, parts + 1).astype(int)[:-1]
        length = np.diff(np.append(edges, dim)).astype("f8")
        mean = np.add.reduceat(rows, edges, axis=1) / length
        spread = np.add.reduceat(np.square(rows - np.repeat(mean, length.astype(int), axis=1)), edges, axis=1) / length
        out.append((length, mean, np.sqrt(spread)))
    return out


def exact_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pairwise integer products, row i of ``queries`` with row i of ``rows``; objects when doubles can't hold them."""
    size = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    if size < EXACT:
        return np.einsum("ij,ij->i", queries, rows).astype("i8")
    whole = [sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for q, r in zip(queries, rows, strict=True)]
    return np.array([min(max(x, LONG[0]), LONG[1]) for x in whole], dtype="i8")


class Best:
    """The k best candidates of each query so far; ``fresh`` are those that have come since it was made."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, before: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.stats = segment_stats(vectors)
        if before is None:
            before = np.full((len(ids), k), np.iinfo("i8").min, dtype="i8"), np.full((len(ids), k), np.iinfo("i8").max, dtype="i8"), np.zeros(len(ids), dtype="i8")
        self.score, self.who, self.found = (x.copy() for x in before)
        self.fresh = np.zeros((len(ids), k), dtype=bool)

    def add(self, ids: np.ndarray, rows: np.ndarray, stats: list | None = None) -> None:
        floor = np.where(self.found >= self.k, self.score[:, -1].astype("f8"), -np.inf)
        q, r = np.nonzero(self.ids[:, None] != ids[None, :])
        for (length, mean_q, dev_q), (_, mean_r, dev_r) in zip(self.stats, stats or segment_stats(rows), strict=True):
            if not len(q):
                return
            if len(q) > 0.2 * len(self.ids) * len(ids):  # most pairs are alive: products of whole blocks
                bound = ((mean_q * length) @ mean_r.T + (dev_q * length) @ dev_r.T)[q, r]
            else:
                bound = np.einsum("ij,ij->i", mean_q[q] * length, mean_r[r]) + np.einsum("ij,ij->i", dev_q[q] * length, dev_r[r])
            alive = bound * (1 + 1e-9 * np.sign(bound)) + 1.0 >= floor[q]
            q, r = q[alive], r[alive]
        for at in range(0, len(q), 1 << 18):
            part = slice(at, at + (1 << 18))
            self.keep(q[part], ids[r[part]], exact_products(self.vectors[q[part]], rows[r[part]]))

    def keep(self, q: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        full = self.found[q] >= self.k
        better = ~full | (score > self.score[q, -1]) | ((score == self.score[q, -1]) & (who < self.who[q, -1]))
        q, who, score = q[better], who[better], score[better]
        if not len(q):
            return
        touched = np.unique(q)
        old_q = np.repeat(touched, self.found[touched])
        slot = np.arange(len(old_q)) - np.repeat(np.cumsum(self.found[touched]) - self.found[touched], self.found[touched])
        fresh = np.concatenate([self.fresh[old_q, slot], np.ones(len(q), bool)])
        q = np.concatenate([old_q, q])
        who, score = np.concatenate([self.who[old_q, slot], who]), np.concatenate([self.score[old_q, slot], score])
        order = np.lexsort((who, -score.astype("f8"), q)) if np.abs(score).max(initial=0) < EXACT else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), who[i])), dtype=int)
        q, who, score, fresh = q[order], who[order], score[order], fresh[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[q[top], rank[top]], self.who[q[top], rank[top]], self.fresh[q[top], rank[top]] = score[top], who[top], fresh[top]
        np.maximum.at(self.found, q[top], rank[top] + 1)


def _save(path: str, **arrays: np.ndarray) -> None:
    """Write a file at once, so that a task that runs again leaves the same file."""
    part = f"{path}.{uuid.uuid4().hex}.npz"
    np.savez(part, **arrays)
    os.replace(part, path)


def _load(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {name: f[name] for name in f.files}


def _files(rows: DataFrame, folder: str, kind: str, size: int, scale: float) -> list[tuple[int, str]]:
    """Write quantised vectors to files of one dimension and at most ``size`` rows; the dimensions and names of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, made, count = TaskContext.get().partitionId(), {}, [], 0

        def out(d: int) -> None:
            nonlocal count
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            for at in range(0, len(ids), size):
                name = f"{kind}-{part}-{count}.npz"
                count += 1
                _save(f"{folder}/{name}", ids=ids[at : at + size], vectors=vectors[at : at + size])
                made.append((d, name))

        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths).tolist():
                own = np.nonzero(lengths == d)[0]
                held.setdefault(d, []).append((ids[own], quantise(flat[starts[own][:, None] + np.arange(d)], scale)))
                if sum(len(x) for x, _ in held[d]) >= size:
                    out(d)
        for d in list(held):
            out(d)
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.int32()), pa.array([n for _, n in made], pa.string())], names=["dim", "name"])

    return sorted((r.dim, r.name) for r in rows.mapInArrow(run, "dim int, name string").collect())


def _wave(spark, folder: str, number: int, candidates: list[tuple[int, str]], queries: dict[int, list[str]], k: int) -> None:
    """Search some candidate files for all queries, and write each query file's best after it (``number``)."""
    last = number - 1

    def before(block: str) -> tuple[np.ndarray, ...] | None:
        if last < 0:
            return None
        old = _load(f"{folder}/best-{last}-{block}")
        return old["score"], old["who"], old["found"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, name in zip(batch.column("dim").to_pylist(), batch.column("name").to_pylist(), strict=True):
                rows = _load(f"{folder}/{name}")
                parts = [(rows["ids"][i : i + 1024], rows["vectors"][i : i + 1024]) for i in range(0, len(rows["ids"]), 1024)]
                parts = [(i, v, segment_stats(v)) for i, v in parts]
                for block in queries.get(d, []):
                    q = _load(f"{folder}/{block}")
                    best = Best(q["ids"], q["vectors"], k, before(block))
                    for i, v, stats in parts:
                        best.add(i, v, stats)
                    at, slot = np.nonzero(best.fresh)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.string()), pa.array(at), pa.array(best.who[at, slot]), pa.array(best.score[at, slot])], names=["block", "at", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, held = None, []

        def out() -> None:
            q = _load(f"{folder}/{open_block}")
            best = Best(q["ids"], q["vectors"][:, :1], k, before(open_block))
            at, who, score = (np.concatenate(x) for x in zip(*held, strict=True))
            real = at >= 0
            best.keep(at[real], who[real], score[real])
            _save(f"{folder}/best-{number}-{open_block}", score=best.score, who=best.who, found=best.found)
            held.clear()

        for batch in batches:
            names = np.array(batch.column("block").to_pylist(), object)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "vec_id", "score")]
            edges = [0, *(np.nonzero(names[1:] != names[:-1])[0] + 1).tolist(), len(names)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if held and names[lo] != open_block:
                    out()
                open_block = names[lo]
                held.append(tuple(c[lo:hi] for c in columns))
        if held:
            out()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["block"])

    schema = "block string, at long, vec_id long, score long"
    every = [(block, -1, 0, 0) for blocks in queries.values() for block in blocks]  # each block has a new file, with or without new rows
    tasks = spark.createDataFrame(candidates, "dim int, name string").repartition(len(candidates))
    found = tasks.mapInArrow(search, schema).unionAll(spark.createDataFrame(every, schema))
    found.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block string").collect()


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer products of each query."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    own = (F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/topk-{uuid.uuid4().hex}"
    os.makedirs(folder)
    blocks = _files(rows.where(is_query).select(*own).distinct().sortWithinPartitions("vec_id", "v"), folder, "query", block, scale)
    queries: dict[int, list[str]] = {}
    for d, name in blocks:
        queries.setdefault(d, []).append(name)
    files = [(d, name) for d, name in _files(rows.select(*own), folder, "rows", GROUP, scale) if d in queries]
    files.sort(key=lambda f: hash_name(f[1]))  # waves are samples of the partitions
    at, wave = 0, 0
    while at < len(files):
        size = min(FIRST_WAVE, len(files)) if wave == 0 else at
        _wave(spark, folder, wave, files[at : at + size], queries, k)
        at, wave = at + size, wave + 1

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                ids, best = _load(f"{folder}/{name}")["ids"], _load(f"{folder}/best-{wave - 1}-{name}")
                q, slot = np.nonzero(np.arange(k)[None, :] < best["found"][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array((slot + 1).astype("i4")), pa.array(best["who"][q, slot]), pa.array(best["score"][q, slot])], names=["query_id", "rank", "vec_id", "score"])

    names = spark.createDataFrame([(n,) for _, n in blocks] if wave else [], "name string").repartition(max(1, len(blocks)))
    found = names.mapInArrow(result, "query_id long, rank int, vec_id long, score long")
    # several vectors may share a query's id; its best are those of all of them
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    out = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
    delete_folder(spark, folder)
    return out


def hash_name(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())
