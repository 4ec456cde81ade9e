"""Near-duplicate embeddings by lattice hashing.

Each unit vector is projected at random to eight dimensions, scaled and shifted, and decoded to its nearest
point of the E8 lattice; the point is its cell in one of ``tables`` tables. Besides its own cell a vector
probes the ``probes`` next best lattice points around it. Two vectors that meet in a cell of some table
(own with own, or own with probed) are compared by their cosine in double precision.

1. Equal vectors with equal labels form a class; one of them stands for all of it, so copies cost nothing.
2. A class enters its own and its probed cells. Cells with more than ``BLOCK`` entries are cut into blocks, and
   a task compares two blocks with one matrix product. A pair that meets more than once counts in the first
   place only: places are ordered by table, then by own cell, and either side can tell all of them from
   the two vectors' cells. So a task returns link counts and the edges of a spanning forest of its links,
   never all links of a group, and nothing has to be made distinct.
3. Counts are summed, edges are joined to components, and both go back to the members of each class.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links,
neither do rows with a null label; vectors of different dimension are not compared; every row is returned;
rows that share an id count as one vector id: their links are summed over their classes; a row with a null
id is its own component (null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut
from ledgerloom.llm.graph import components

#: Steps of a unit when vectors and planes are made whole numbers.
GRAIN = float(2**20)
#: Entries of a cell that a task compares at once.
BLOCK = 1024


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (integers with an even sum) to each row."""
    near = np.rint(x)
    off = x - near
    odd = np.nonzero(near.sum(axis=1) % 2 != 0)[0]
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (D8 and D8 shifted by a half) to each row, doubled to be whole."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = np.square(x - half).sum(axis=1) < np.square(x - whole).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype("i8")


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


class Lattice:
    """The cells of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int, probes: int, width: float):
        rng = np.random.default_rng(71 * dim + tables)
        # whole numbers, so that a vector has the same cells wherever they are computed
        self.planes = np.rint(rng.standard_normal((tables, dim, 8)) * (GRAIN / width)).astype("i8")
        self.shift = np.rint(rng.random((tables, 8)) * 4 * GRAIN) / GRAIN
        self.hash = rng.integers(1, 2**62, (tables, 8), dtype="i8") * 2 + 1
        self.tables, self.probes = tables, probes

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``rows x tables x (1 + probes)`` cell numbers; the first is the vector's own."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype="i8")
        whole = np.rint(unit * GRAIN).astype("i8")
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                at = (whole @ self.planes[t]).astype("f8") / GRAIN**2 + self.shift[t]
                own = nearest_e8(at)
                out[:, t, 0] = (own * self.hash[t]).sum(axis=1)
                if self.probes:
                    # nearest neighbours: |at - own - v| is least where (at - own).v is largest, as all v are as long
                    toward = (at - own / 2) @ NEIGHBOURS.T
                    best = np.argpartition(-toward, self.probes - 1, axis=1)[:, : self.probes]
                    points = own[:, None, :] + np.rint(2 * NEIGHBOURS[best]).astype("i8")
                    out[:, t, 1:] = (points * self.hash[t]).sum(axis=2)
        return out


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)  # no overflow, no underflow
    return scaled / np.sqrt(np.square(scaled).sum(axis=1, keepdims=True))


def _entries(classes: DataFrame, kind: str, tables: int, probes: int, width: float) -> DataFrame:
    """``cell, t, own, rep, copies, v``: each class in its own and its probed cells, with its vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                vectors = batch.column("v").to_pylist()
                rep, copies, group = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "copies", "part"))
                for dim in {len(v) for v in vectors}:
                    here = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
                    lattice = lattices.setdefault(dim, Lattice(dim, tables, probes, width))
                    matrix = np.array([vectors[i] for i in here], dtype=kind)
                    n, per = len(here), tables * (1 + probes)
                    cells = lattice.cells(_unit(matrix.astype("f8"))).reshape(n, per)
                    # a table, a label and a dimension have cells of their own
                    mixed = cells * np.int64(6364136223846793005) + (np.repeat(np.arange(tables), 1 + probes)[None, :] + 1) * np.int64(1442695040888963407) + group[here, None] + dim
                    packed = pa.array([x.tobytes() for x in matrix], pa.binary()).take(pa.array(np.repeat(np.arange(n), per)))
                    columns = [mixed.ravel(), np.tile(np.repeat(np.arange(tables, dtype="i4"), 1 + probes), n), np.tile(np.arange(per) % (1 + probes) == 0, n), np.repeat(rep[here], per), np.repeat(copies[here], per)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], names=["cell", "t", "own", "rep", "copies", "v"])

    return classes.mapInArrow(run, "cell long, t int, own boolean, rep long, copies long, v binary")


def _counted_here(t: int, home: np.ndarray, a: np.ndarray, b: np.ndarray, rep_a: np.ndarray, rep_b: np.ndarray) -> np.ndarray:
    """Which pairs count in table t at the cell ``home``: in no earlier table do they meet, and nowhere before in this one."""
    own_a, own_b = a[:, :, :1], b[:, :, :1]
    meet = (own_a == b).any(axis=2) | (own_b == a).any(axis=2)
    first = meet.argmax(axis=1) == t
    low_own = np.where(rep_a < rep_b, own_a[:, t, 0], own_b[:, t, 0])
    high_own = np.where(rep_a < rep_b, own_b[:, t, 0], own_a[:, t, 0])
    low_all = np.where((rep_a < rep_b)[:, None], a[:, t], b[:, t])
    high_all = np.where((rep_a < rep_b)[:, None], b[:, t], a[:, t])
    # in table t they may meet in either's own cell; the cell of the smaller id comes first
    at_low = (high_all == low_own[:, None]).any(axis=1)
    at_high = (low_all == high_own[:, None]).any(axis=1)
    place = np.where(at_low, low_own, np.where(at_high, high_own, low_own))
    return first & (place == home)


def _compare(entries: DataFrame, kind: str, least: float, tables: int, probes: int, width: float) -> DataFrame:
    """``rep, links, to``: for each class met in a pair of blocks its number of links, and an edge of the forest."""
    sizes = entries.groupBy("cell").agg(F.count("*").alias("size"), F.max("own").alias("any_own")).where("size > 1 AND any_own").select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    sized = entries.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "t", "own", "rep", "copies", "v")
    lattices: dict[int, Lattice] = {}

    def group(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        unit = _unit(np.frombuffer(b"".join(rows["v"]), dtype=kind).reshape(len(rows["v"]), -1).astype("f8"))
        lattice = lattices.setdefault(unit.shape[1], Lattice(unit.shape[1], tables, probes, width))
        own, rep, copies, mine = rows["own"], rows["rep"], rows["copies"], rows["mine"]
        i, j, t = rows["i"][0], rows["j"][0], int(rows["t"][0])
        left, right = np.nonzero(mine == i)[0], np.nonzero(mine == j)[0]
        links = np.zeros(len(rep), dtype="i8")
        up = np.arange(len(rep))
        if not own.any():
            return None

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        close = unit[left] @ unit[right].T >= least - 1e-9
        close &= own[left][:, None] | own[right][None, :]
        close &= (rep[left][:, None] < rep[right][None, :]) if i == j else (rep[left][:, None] != rep[right][None, :])
        x, y = np.nonzero(close)
        for at in range(0, len(x), 1 << 14):
            p, q = left[x[at : at + (1 << 14)]], right[y[at : at + (1 << 14)]]
            exact = (unit[p] * unit[q]).sum(axis=1) >= least
            p, q = p[exact], q[exact]
            if not len(p):
                continue
            seen, places = np.unique(np.concatenate([p, q, np.nonzero(own)[0][:1]]), return_inverse=True)
            cells = lattice.cells(unit[seen])
            home = cells[places[-1], t, 0]  # the own cell of any entry that is at home here
            counts = _counted_here(t, home, cells[places[: len(p)]], cells[places[len(p) : -1]], rep[p], rep[q])
            p, q = p[counts], q[counts]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    a, b = (a, b) if rep[a] < rep[b] else (b, a)
                    up[b] = a
        hit = np.nonzero(links)[0]
        return (rep[hit], links[hit], rep[[root(k) for k in hit]]) if len(hit) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            found = group({k: np.concatenate([h[k] for h in held]) for k in held[0]}) if held else None
            held.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["rep", "links", "to"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "i", "j", "mine", "t", "own", "rep", "copies", "v")}
            change = np.nonzero((np.diff(columns["cell"]) != 0) | (np.diff(columns["i"]) != 0) | (np.diff(columns["j"]) != 0))[0] + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and any(held[-1][k][-1] != columns[k][a] for k in ("cell", "i", "j")):
                    yield from done()
                held.append({k: v[a:b] for k, v in columns.items()})
        yield from done()

    return spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "rep long, links long, to long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, tables: int = 4, probes: int = 8, width: float = 1.5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))
    doubles = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, doubles).alias("v"), F.col(label_col).cast("string").alias("label"))
    keyed = rows.withColumn("class", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", "label", F.array_join(F.col("v").cast("array<string>"), ",")), 256)))
    classes = cut(keyed.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v"), F.any_value("label").alias("label")))
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    entries = _entries(classes.select("rep", "copies", F.xxhash64("label").alias("part"), "v"), kind, tables, probes, width)
    linked = cut(_compare(entries, kind, least, tables, probes, width))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(linked.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = classes.select("class", "rep", "copies").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    named = named.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "class").join(named, "class", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
