"""SentencePiece encoding and decoding with a table of distinct chunks.

When no piece of a vocabulary has a white-space mark after another character, pieces cannot cross the
start of a run of marks, so a text's pieces are those of its marked words, one after another. A task
keeps a table of the distinct marked words it has met: each word is segmented by the library once, and
ids are joined back by position. The table is bounded (``TABLE`` entries, then it starts anew), so memory
does not grow with the input, and no shuffle is needed. A vocabulary with crossing pieces, or one whose
normalisation is more than the marks, is encoded text by text instead.

Results are exactly those of ``encode(text)`` without begin and end ids and without sampling, and of
``decode(ids)``. Null texts count as empty; an empty text has no ids and decodes to an empty text;
rows that repeat, null ids and very long texts need no care, as each row is on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct marked words that a task keeps.
TABLE = 400_000
MARK = "▁"
#: Texts whose marks change under normalisation in these ways, as a sample, show that a model does more than marking.
PROBE = " a  b\n\tc 　ﬁ́ Ⅷ "

_state: dict[str, Chunks] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and a whole number or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def only_marks(model: bytes) -> bool:
    """Whether a model's normaliser does no more than mark white space: it has no table of characters, puts a mark in front, removes
    no spaces and escapes them. These are the parts 2 to 5 of the model's part 3; the last three are true unless they are said to be false."""
    spec = dict(_fields(next((value for key, value in _fields(model) if key == 3), b"")))
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class Chunks:
    """A segmenter with its table of distinct chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = not any(MARK in x.lstrip(MARK) for x in names) and only_marks(self.model.serialized_model_proto()) and MARK in names
        self.lone = self.model.piece_to_id(MARK)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self.table: dict[str, tuple[list[int], str]] = {}

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark and with spaces for other marks."""
        if "  " in text or MARK in text or text[:1] == " ":
            return [x[1:].replace(MARK, " ") for x in self.cut.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        """Segment the words that the table lacks."""
        new = [x for x in set(words).difference(self.table) if x]
        if len(self.table) + len(new) > TABLE:
            self.table.clear()
            new = [x for x in set(words) if x]
        self.table[""] = ([self.lone], str(self.lone))
        for word, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.table[word] = (ids, ",".join(map(str, ids)))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids and the ids as decimal numbers joined by commas."""
        if not self.separable:
            for ids in self.model.encode(texts, num_threads=1):
                yield ids, ",".join(map(str, ids))
            return
        for text in texts:
            if not text:
                yield [], ""
                continue
            words = self.words(text)
            try:
                found = list(map(self.table.__getitem__, words))
            except KeyError:
                self.learn(words)
                found = list(map(self.table.__getitem__, words))
            yield list(chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])


def segmenter(path: str) -> Chunks:
    """The worker's segmenter; its table outlives a task."""
    if path not in _state:
        _state[path] = Chunks(path)
    return _state[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` for each row; ``ids`` only if ``with_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = segmenter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                rows = []
                for ids, said in chunks.encode(texts):
                    back = chunks.model.decode(ids) if ids else ""
                    rows.append((ids if with_ids else None, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                columns = [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([r[0] for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; a null list decodes to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = segmenter(path)
        for batch in batches:
            texts = [chunks.model.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")
