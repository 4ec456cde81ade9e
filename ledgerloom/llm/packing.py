"""Hierarchical multi-length packing of tokenised documents.

A document's ids (byte-level BPE, then an end id) are routed by length to context-size tiers. Documents
longer than the largest window fill whole windows first. What is left is packed tier by tier, from long
windows to short ones: an item opens a window of its own tier; the gap is filled with the largest items of
this and shorter tiers that fit (best fit), and when none fits, one is cut so that the window is full.
Windows that a task cannot fill are carried along; at its end the last of them are cut to powers of two.
So no window is padded. Windows of a size are dealt to step groups with the same number of tokens each.

The work is one pass over each input partition without a shuffle; a task holds a slice of documents and
less than one window a tier besides, so memory is bounded. Partitions number their sequences apart
(partition in the high bits), and a retried task repeats its result.

Tokenisation: white space only ever begins a word of the vocabulary's pattern, so the words between single
spaces are encoded on their own; a bounded table keeps the ids of the words that a worker has met. Texts
with other runs of white space, or with the end marker spelt out, are encoded as a whole. Ids equal those
of the tokenizers library (tests compare them).

Defined results: null and empty texts have the end id only; a null doc_id is carried as null; rows that
repeat a doc_id are packed each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Context sizes, long to short; each is a power of two.
TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 65_536
#: Distinct words whose ids a worker keeps.
TABLE = 600_000
#: Documents packed together.
SLICE = 1024
END_ID = 0
# Fixed value: the vocabulary's special token, which the tokenizers library finds in texts.
SPECIAL = "<|endoftext|>"

_state: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts, through a table of distinct words."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:  # a vocabulary installed on every machine, not data
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = np.array([len(ranks)], "<u4").tobytes()
        self.odd = re.compile(r" (?=\s|\Z)")
        self.table: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if SPECIAL in text:
            return self.special.join(self.whole(x) for x in text.split(SPECIAL))
        if self.odd.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        try:
            return self.whole(first) + b"".join(map(self.table.__getitem__, words))
        except KeyError:
            if len(self.table) > TABLE:
                self.table.clear()
            for word in set(words).difference(self.table):
                self.table[word] = self.whole(" " + word)
            return self.whole(first) + b"".join(map(self.table.__getitem__, words))


def word_ids(ranks_path: str) -> WordIds:
    if ranks_path not in _state:
        _state[ranks_path] = WordIds(ranks_path)
    return _state[ranks_path]


class Packer:
    """Packs items ``(length, serial, start)``; ``close`` gets each finished window as a list of items and its size."""

    def __init__(self, close, tiers: tuple[int, ...] = TIERS):
        self.close, self.tiers = close, tiers
        self.pool: list[tuple[int, int, int]] = []  # sorted by length

    def add(self, serial: int, length: int) -> None:
        top, at = self.tiers[0], 0
        while length - at >= top:
            self.close([(top, serial, at)], top)
            at += top
        if length > at:
            insort(self.pool, (length - at, serial, at))

    def fill(self, size: int) -> bool:
        """One full window of ``size``, opened by the pool's largest item that fits; False if the pool is too small."""
        pool, gap, window = self.pool, size, []
        while gap:
            at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                item = pool.pop(at)
            elif pool:  # each is longer than the gap: cut the shortest
                length, serial, start = pool.pop(0)
                item = (gap, serial, start)
                insort(pool, (length - gap, serial, start + gap))
            else:
                for x in window:
                    insort(pool, x)
                return False
            window.append(item)
            gap -= item[0]
        self.close(window, size)
        return True

    def drain(self, last: bool) -> None:
        """Pack what the pool holds; if ``last``, down to the last id."""
        for size, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.pool and self.pool[-1][0] > below and self.fill(size):
                pass
        left = sum(x[0] for x in self.pool)
        while left >= self.tiers[0] or last and left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            self.fill(size)
            left -= size


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id`` (and ``ids``)."""
    if list(tiers) != sorted(set(tiers), reverse=True) or any(x & (x - 1) for x in tiers):
        raise ValueError("tiers are falling powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = word_ids(ranks_path)
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: dict[int, tuple[int | None, bytes, int]] = {}  # serial: id, ids, ids not yet packed
        out: list[tuple] = []
        ids_out: list[bytes] = []
        count, steps, serial = 0, dict.fromkeys(tiers, 0), 0

        def close(window: list[tuple[int, int, int]], size: int) -> None:
            nonlocal count
            tier = next(i for i, t in reversed(list(enumerate(tiers))) if size <= t)
            room = max(1, STEP_TOKENS // tiers[tier])
            step = part + (tier << 28) + steps[tiers[tier]] // room
            steps[tiers[tier]] += 1
            offset = 0
            for length, who, start in window:
                doc, ids, left = held[who]
                piece = ids[4 * start : 4 * (start + length)]
                out.append((doc, start, length, zlib.crc32(piece), len(ids) // 4, part + count, offset, size, step))
                if with_ids:
                    ids_out.append(piece)
                offset += length
                if left == length:
                    del held[who]
                else:
                    held[who] = (doc, ids, left - length)
            count += 1

        def flush() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 8]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids_out)]).astype("i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_out), "<i4"))))
            out.clear()
            ids_out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id", *["ids"] * with_ids]
        end = np.array([END_ID], "<u4").tobytes()
        packer, id_type = Packer(close, tiers), pa.int64()
        for whole in batches:
            id_type = whole.schema.field(0).type
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = words.ids(text or "") + end
                    held[serial] = (doc, ids, len(ids) // 4)
                    packer.add(serial, len(ids) // 4)
                    serial += 1
                packer.drain(False)
                yield flush()
        packer.drain(True)
        yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_id long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
