"""Language-model scores by online logistic context mixing.

A text is lower-cased (A-Z) and cut at white space; it is coded as its words and one end. The most frequent training
words (``VOCABULARY``, or ``WORDS_A_POWER`` times the ``GROWTH`` power of the training words), the end and an escape have
Huffman codes; other words follow the escape byte by byte in a Huffman code of bytes, up to a space. So a text is a
sequence of bits, and the probability of the text is the product of those of its bits.

For each bit hashed-context predictors give log odds from counts of the training texts:

* words: the code node alone; the node after the last *marker* (one of the ``MARKERS`` most frequent words); the most
  frequent follower of the two words before, as long as its code agrees; and the word that followed these two words
  when the same text had them last, so that a text teaches about itself;
* bytes of spelt words: the node alone, and after three and six bytes.

A gate, chosen by what is coded and by how sure the predictors are, has weights that mix the log odds to one
probability. The weights are learned online over all bits of all training texts, group of bits by group, by gradient
steps on the coding cost; they go on learning along each text that is scored, from the same start for all texts. The
mixed probability is refined: a table from the hashed code node and the quantised log odds to the share of
ones, gathered over all training bits, gives a second probability, and the mean of both codes the bit.

A training text is taught and scored without what it has put into the tables itself: its own followers are taken out of
the counts of its pairs of words, and each bit's own occurrence out of the other counts. So a text that the corpus holds once
is as new to the model as a held-out one, and copies stand out.

1. Words of all training texts are counted; counts stay in a table. The most frequent ones make the code.
2. All training texts fill the tables: tasks send counts of (context, symbol), which are summed by ranges of contexts.
3. All training texts teach the weights; tasks' weights are averaged. The same pass gathers the refinement.
4. All texts are scored. For the base score, counts of frequent words come with the code, those of others by a
   join of their hashes with the table of counts.

Words are compared by 64-bit hashes of all their bytes. The code and the tables are files in the shared folder that workers map
to memory, so the workers of a machine share them. All grow with the training words: an entry for each pair of words
that is followed by something, and ``SLOTS`` slots for each (context, byte). Slots and entries carry check bits. A task holds
slices of about ``SLICE_CHARS`` characters, or one text (about 200 bytes a character of the longest text).

Defined results: null and empty texts are one end; a null doc_id counts as an empty id for the split; rows that
repeat are trained on and scored each; without training texts all words are spelt; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpoint_dir, cut, delete_folder
from ledgerloom.llm.minhash import BASE, BASE_INVERSE, BYTE, SPACE, _mix, _power

u = np.uint64
#: Words with a code of their own at least, and times ``GROWTH`` powers of the training words.
VOCABULARY = 1 << 17
WORDS_A_POWER, GROWTH = 400, 0.4
MARKERS = 63
#: Bytes before a byte that its hashed contexts see, and the tables: markers, pairs of words, those contexts.
SPANS = (3, 6)
TABLES = 2 + len(SPANS)
INPUTS = 4
#: Texts handled at once, by characters; a task's pending keys; keys of a block; steps of paths; slots for each key; training words of a part.
SLICE_CHARS = 1 << 18
PENDING = 1 << 22
BLOCK = 1 << 14
CHUNK = 1 << 22
SLOTS = 16
WORDS_A_PART = 1 << 20
#: Gates: (follower's class, what the text itself says) of guesses and two of second guesses; (depth, marker's confidence) of words; (two
#: confidences) of bytes.
FLAG_GATES = 6 * 3 + 2
WORD_GATES = 4 * 4
GATES = FLAG_GATES + WORD_GATES + 4 * 4
RATE = 2.0
#: Bits of a group, between which the weights move in learning; words of a text between which its own corrections move
#: first (each next stretch is twice as long), and what holds these back.
GROUP = 1 << 14
STEP_WORDS = 32
OWN_RATE = np.float32(4)
OWN_HOLD = np.float32(20)
#: Contexts and log odds of the refinement, and the weight of what it starts from.
REFINED = 1 << 10
POINTS = 25
REACH = 8.0
START = 8.0
#: The hash of the end in the table of counts, and of what is before a text.
END, BEFORE = u(0x9E3779B97F4A7C15), u(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- states: two counts in a byte
EXACT = 14
STEP = 0.125


def _pair_states() -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array([(a, n - a) for n in range(EXACT + 1) for a in range(n, -1, -1)])  # zeros, ones
    return pairs, np.arange(len(pairs))


PAIRS, _ = _pair_states()
RATIOS = 256 - len(PAIRS)


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A byte for each pair of counts: exact up to ``EXACT`` together, beyond that the log odds in steps."""
    n = zeros + ones
    small = n * (n + 1) // 2 + ones
    ratio = np.rint(np.log((ones + 0.2) / (zeros + 0.2)) / STEP) + RATIOS // 2
    return np.where(n <= EXACT, np.minimum(small, len(PAIRS) - 1), len(PAIRS) + np.clip(ratio, 0, RATIOS - 1)).astype("u1")


def _state_odds(taken: int | None) -> np.ndarray:
    """Log odds of a one of each state, without one occurrence of the bit ``taken``."""
    counts = PAIRS.astype("f8")
    if taken is not None:
        counts[:, taken] = np.maximum(counts[:, taken] - 1, 0)
    small = np.log((counts[:, 1] + 0.2) / (counts[:, 0] + 0.2))
    return np.concatenate([small, (np.arange(RATIOS) - RATIOS // 2) * STEP]).astype("f4")


#: By 256 * (0: as it is, 1: without a zero, 2: without a one) + state.
STATE_ODDS = np.concatenate([_state_odds(None), _state_odds(0), _state_odds(1)])
STATE_LEVEL = np.concatenate([np.digitize(np.append(np.maximum(PAIRS.sum(axis=1) - less, 0), np.full(RATIOS, 99)), (0.5, 2.5, 12.5)) for less in (0, 1, 1)]).astype("i1")


def _run_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and log odds of a follower by 16 * its count + the others' count, each up to 15."""
    c, o = np.divmod(np.arange(256), 16)
    kind = np.where(c == 0, 0, np.where(o == 0, np.where(c == 1, 1, np.where(c < 4, 2, 3)), np.where(c >= 2 * o, 4, 5)))
    return kind.astype("i1"), np.where(c > 0, np.log((c + 0.5) / (o + 0.5)).clip(0.1), 0).astype("f4")


RUN_CLASS, RUN_ODDS = _run_tables()
OWN_ODDS = np.float32(1.5)


# ---------------------------------------------------------------- the code
def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its path from the root: starts, and steps of twice a node and the bit taken there."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    step, node = np.zeros(2 * n, "i4"), n  # of each node the way to it from its parent
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        step[x], step[y] = (node - n) * 2, (node - n) * 2 + 1
        heapq.heappush(heap, (a + b, node))
        node += 1
    del heap
    root, at, live = node - 1, np.arange(n, dtype="i4"), np.arange(n, dtype="i4")
    size = np.zeros(n, "i8")
    while (live := live[at[live] != root]).size:  # all symbols climb together, first to count and then to write
        size[live] += 1
        at[live] = (step[at[live]] >> 1) + n
    starts = np.concatenate([[0], np.cumsum(size)])
    path, place = np.zeros(starts[-1], "i4"), starts[1:] - 1
    at, live = np.arange(n, dtype="i4"), np.arange(n, dtype="i4")
    while (live := live[at[live] != root]).size:
        way = step[at[live]]
        path[place[live]] = way
        place[live] -= 1
        at[live] = (way >> 1) + n
    return starts, path


def way_counts(path: tuple[np.ndarray, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """``nodes x 2`` zeros and ones when symbols occur ``counts`` times."""
    starts, ways = path
    n = max(1, len(starts) - 2)
    some = np.nonzero(counts)[0]
    out, at = np.zeros(2 * n), 0
    size = np.diff(starts)[some]
    edges = np.searchsorted(np.cumsum(size), np.arange(CHUNK, int(size.sum()) + CHUNK, CHUNK)) + 1
    for end in edges:  # paths of many symbols at once, but not of all
        who = some[at:end]
        k = size[at:end]
        places = np.arange(int(k.sum())) + np.repeat(starts[who] - (np.cumsum(k) - k), k)
        out += np.bincount(ways[places], weights=np.repeat(counts[who], k).astype("f8"), minlength=2 * n)
        at = end
    return out.reshape(n, 2)


def make_code(folder: str, hashes: np.ndarray, counts: np.ndarray, ends: int, others: int, letters: np.ndarray) -> None:
    """Write the code of frequent words (hashes and counts), the end and the escape, and that of bytes by their counts."""
    counts = np.append(counts, [ends, others]).astype("i8")
    order = np.argsort(hashes)
    bits = max(1, int(np.ceil(np.log2(max(2, len(hashes))))) + 1)
    parts = {"hashes": hashes[order], "ids": order.astype("i4"), "counts": counts, "starts": np.searchsorted(hashes[order] >> u(64 - bits), np.arange((1 << bits) + 1, dtype="u8")).astype("i4")}
    for name, weights in (("word", np.maximum(counts, 1)), ("byte", letters + 1)):
        starts, ways = huffman(weights)
        seen = way_counts((starts, ways), weights)
        odds = lambda zeros, ones: np.log((np.maximum(ones, 0) + 0.2) / (np.maximum(zeros, 0) + 0.2))
        plain = np.repeat(odds(seen[:, 0], seen[:, 1]), 2)
        without = np.stack([odds(seen[:, 0] - 1, seen[:, 1]), odds(seen[:, 0], seen[:, 1] - 1)], axis=1).ravel()
        parts |= {f"{name}_starts": starts, f"{name}_ways": ways, f"{name}_odds": np.concatenate([plain, without]).astype("f4")}
    for name, x in parts.items():
        np.save(f"{folder}/{name}.npy", x)


def found(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key between its begin and end, or -1."""
    out = np.full(len(wanted), -1, "i8")
    live = np.nonzero(begin < end)[0]
    at, end, wanted = begin[live], end[live], wanted[live]
    while live.size:
        hit = keys[at] == wanted
        out[live[hit]] = at[hit]
        at = at + 1
        go = ~hit & (at < end)
        live, at, end, wanted = live[go], at[go], end[go], wanted[go]
    return out


class Book:
    """The code and the tables in the shared folder, mapped to memory."""

    def __init__(self, folder: str):
        read = lambda name: np.load(f"{folder}/{name}.npy", mmap_mode="r")
        self.hashes, self.ids, self.counts, self.starts = (np.asarray(read(x)) for x in ("hashes", "ids", "counts", "starts"))
        self.paths = [tuple(np.asarray(read(f"{kind}_{x}")) for x in ("starts", "ways", "odds")) for kind in ("word", "byte")]
        self.end, self.escape = len(self.counts) - 2, len(self.counts) - 1
        p = self.counts / max(1, int(self.counts.sum()))
        self.share = np.log(np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12)).astype("f4")  # log odds of each symbol
        self.leaf = max(8, (len(self.counts)).bit_length())
        self.nodes = len(self.counts) - 1
        self.filled = os.path.exists(f"{folder}/layout.npz")
        if self.filled:
            layout = np.load(f"{folder}/layout.npz")
            self.part_bits, self.bucket_bits = int(layout["part_bits"]), int(layout["bucket_bits"])
            self.base = [layout[f"base{t}"] for t in range(TABLES)]
            mapped = lambda name, d: np.memmap(f"{folder}/{name}", d, "r") if os.path.getsize(f"{folder}/{name}") else np.zeros(0, d)
            self.marked = mapped("0.states", "u1")
            self.run = mapped("1.ends", "u4"), mapped("1.entries", "u8")
            self.slots = [mapped(f"{t}.slots", "u2") for t in range(2, TABLES)]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word's hash, -1 for one without a code."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        b = (h >> u(65 - len(self.starts).bit_length())).astype("i8")
        at = found(self.hashes, self.starts[b], self.starts[b + 1], h)
        return np.where(at >= 0, self.ids[at], -1)

    def followers(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context the most frequent follower's symbol, its count and the others' count (each up to 15, 0 if none)."""
        ends, entries = self.run
        if not len(entries):
            return np.zeros(len(context), "i8"), np.zeros(len(context), "i8"), np.zeros(len(context), "i8")
        bucket = (context >> u(64 - self.bucket_bits)).astype("i8")
        base = self.base[1][bucket >> (self.bucket_bits - self.part_bits)]
        first = bucket & ((1 << (self.bucket_bits - self.part_bits)) - 1) == 0
        begin, end = np.where(first, 0, ends[bucket - 1]) + base, ends[bucket] + base
        out, check = np.zeros(len(context), "u8"), context >> u(48 - self.bucket_bits) & u(0xFFFF)
        live = np.nonzero(begin < end)[0]
        at, end, check = begin[live], end[live], check[live]
        while live.size:
            got = entries[at]
            hit = got >> u(48) == check
            out[live[hit]] = got[hit]
            at = at + 1
            go = ~hit & (at < end)
            live, at, end, check = live[go], at[go], end[go], check[go]
        return (out >> u(8) & u(0xFFFFFFFFFF)).astype("i8"), (out >> u(4) & u(15)).astype("i8"), (out & u(15)).astype("i8")

    def slot_states(self, t: int, context: np.ndarray, item: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The states of (context, node), each bit's context being that of its item, in a table of slots; 0 where it was never seen."""
        slots, base = self.slots[t - 2], self.base[t]
        if not len(slots):
            return np.zeros(len(node), "i2")
        part = (context >> u(64 - self.part_bits)).astype("i8")
        h = _slot_hash(context[item], node)
        begin = base[part]
        at = (h >> u(40)) * (base[part + 1] - begin).astype("u8")[item] >> u(24)
        got = slots.take(np.minimum(at.astype("i8") + begin[item], len(slots) - 1))
        return np.where(got >> np.uint16(8) == (h >> u(32)).astype("u1"), got & np.uint16(255), np.uint16(0)).astype("i2")


def _slot_hash(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (context + node.astype("u8") * u(0xC2B2AE3D27D4EB4F)) * u(0x9E3779B97F4A7C15)


_books: dict[str, Book] = {}


def _book(folder: str, filled: bool = True) -> Book:
    if folder not in _books or (filled and not _books[folder].filled):
        _books.clear()
        _books[folder] = Book(folder)
    return _books[folder]


# ---------------------------------------------------------------- texts as symbols
@dataclass
class Tokens:
    """Words and ends of texts in order: owning text, hash, symbol (-1: spelt); spelt words' places and bytes."""

    sizes: np.ndarray
    owner: np.ndarray
    hash: np.ndarray
    symbol: np.ndarray
    rare: np.ndarray
    letters: np.ndarray
    lengths: np.ndarray


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined lower-case bytes, each word's start and end there, its hash, and each text's number of words."""
    joined = np.frombuffer(b" ".join([*texts, b""]).lower() or b" ", "u1")
    gap = SPACE[joined]
    edge = np.nonzero(gap[1:] != gap[:-1])[0] + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(BYTE[joined] * _power(BASE, len(joined)), dtype="u8")])
    h = _mix((total[end] - total[start]) * _power(BASE_INVERSE, len(joined) + 1)[start] + (end - start).astype("u8"))
    bounds = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return joined, start, end, h, np.diff(np.concatenate([[0], bounds]))


def tokens_of(book: Book, texts: list[bytes]) -> Tokens:
    joined, start, end, h, n = words_in(texts)
    sizes = n + 1
    total, owner = int(sizes.sum()), np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)
    hashes, symbol = np.full(total, END), np.full(total, book.end, "i8")
    hashes[place] = h
    symbol[place] = own = book.symbols(h)
    spelt = np.nonzero(own < 0)[0]
    lengths = end[spelt] - start[spelt] + 1  # with the space behind
    begin = np.cumsum(lengths) - lengths
    letters = joined[np.arange(int(lengths.sum())) + np.repeat(start[spelt] - begin, lengths)].copy()
    letters[begin + lengths - 1] = 32
    return Tokens(sizes, owner, hashes, symbol, place[spelt], letters, lengths)


def pair_contexts(t: Tokens) -> np.ndarray:
    """The hash of the two words before each token."""
    first = np.concatenate([[True], t.owner[1:] != t.owner[:-1]])
    before = np.where(first, BEFORE, np.concatenate([[BEFORE], t.hash[:-1]]))
    earlier = np.where(first, BEFORE, np.concatenate([[BEFORE], before[:-1]]))
    return _mix(before * u(0xC2B2AE3D27D4EB4F) + (earlier ^ (earlier >> u(32))) * u(0x165667B19E3779F9) + u(7))


def markers_of(book: Book, t: Tokens) -> np.ndarray:
    """One more than the symbol of the last marker before each token of the same text, or 0."""
    if not len(t.symbol):
        return np.zeros(0, "i8")
    at = np.arange(len(t.symbol))
    last = np.maximum.accumulate(np.where((t.symbol >= 0) & (t.symbol < min(MARKERS, book.end)), at, -1))
    last = np.concatenate([[-1], last[:-1]])
    start = (np.cumsum(t.sizes) - t.sizes)[t.owner]
    return np.where(last >= start, t.symbol[last] + 1, 0)


def byte_contexts(t: Tokens) -> list[np.ndarray]:
    """The hashed contexts of the spelt words' bytes; nothing is seen across the start of a word."""
    size = len(t.letters)
    behind = np.arange(size) - np.repeat(np.cumsum(t.lengths) - t.lengths, t.lengths)
    x, out = t.letters.astype("u8"), []
    for k in SPANS:
        h = np.full(size, k, "u8")
        for i in range(1, k + 1):
            past = np.concatenate([np.zeros(min(i, size), "u8"), x[:-i]]) if i < size else np.zeros(size, "u8")
            h = h * u(257) + np.where(behind >= i, past, u(32))
        out.append(_mix(h * u(0xD6E8FEB86659FD93) + u(0x51ED270B)))
    return out


def _masked(context: np.ndarray, leaf: int) -> np.ndarray:
    return context >> u(leaf) << u(leaf)


# ---------------------------------------------------------------- bits
@dataclass
class Bits:
    """Bits of one kind, by step and then by text: bit, gate, the predictors' log odds, and the refinement's context.

    ``runs`` has (step, text, bits) of each run of one text's bits; a text's own weights move between its steps.
    """

    runs: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    odds: np.ndarray
    node: np.ndarray


def word_predictions(book: Book, t: Tokens, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token: the symbol coded, the pair's follower (-1: none) with its counts, and the own text's follower (-1: none).

    ``own`` says which texts are training texts, whose own followers are taken out of the counts.
    """
    symbol = np.where(t.symbol < 0, book.escape, t.symbol)
    n = len(symbol)
    context = _masked(pair_contexts(t), book.leaf)
    guess, c, o = book.followers(context)
    # the same context in the same text: places sorted by it, which also shows where it was last
    low = max(1, n.bit_length())
    key = np.sort(_mix(context + t.owner.astype("u8") * u(0x2545F4914F6CDD1D)) >> u(low) << u(low) | np.arange(n, dtype="u8"))
    place, group = (key & u((1 << low) - 1)).astype("i8"), key >> u(low)
    new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    last = np.full(n, -1, "i8")
    last[place[1:]] = np.where(new[1:], -1, place[:-1])
    if own.any():
        number = np.cumsum(new) - 1
        times = np.bincount(number, minlength=1)[number]
        right = np.bincount(number, weights=symbol[place] == guess[place], minlength=1)[number]
        take = own[t.owner[place]] & (c[place] < 15) & (o[place] < 15)  # counts that are cut at 15 stay
        c[place] = np.maximum(c[place] - np.where(take, right, 0), 0)
        o[place] = np.maximum(o[place] - np.where(take, times - right, 0), 0)
    return symbol, np.where(c > 0, guess, -1), c * 16 + o, np.where(last >= 0, symbol[np.maximum(last, 0)], -1)


def steps_of(t: Tokens) -> np.ndarray:
    """Each token's step along its text: the first ``STEP_WORDS`` words, then stretches that double."""
    place = np.arange(len(t.owner)) - np.repeat(np.cumsum(t.sizes) - t.sizes, t.sizes)
    return np.frexp((place // STEP_WORDS).astype("f8"))[1]


def _runs(step: np.ndarray, text: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """``(step, text, bits)`` of consecutive items with the same step and text."""
    if not len(step):
        return np.zeros((3, 0), "i8")
    first = np.nonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (text[1:] != text[:-1])]))[0]
    out = np.stack([step[first], text[first], np.add.reduceat(bits, first)])
    return out[:, out[2] > 0]


def _expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of ``n`` bits each: every bit's item, and its number within the item less its number within all."""
    return np.repeat(np.arange(len(n)), n), n - np.cumsum(n)


def bits_of(book: Book, t: Tokens, own: np.ndarray) -> list[Bits]:
    """The bits that say whether a guessed follower is right, the codes of words where none is, and the bits of spelt words."""
    symbol, guess, seen, again = word_predictions(book, t, own)
    step, marker = steps_of(t), markers_of(book, t)
    order = np.argsort((step * len(own) + t.owner).astype("i4"), kind="stable")
    symbol, guess, seen, again, step, owner, marker = (x[order] for x in (symbol, guess, seen, again, step, t.owner, marker))

    # the pair's follower, then that of the text itself if it is another
    first, other = guess >= 0, (again >= 0) & (again != guess)
    hit = first & (guess == symbol)
    second = other & ~hit
    found = hit | second & (again == symbol)
    n = first.astype("i8") + second
    item, back = _expanded(n)
    place = np.arange(len(item)) + back[item]
    is_first = (place == 0) & first[item]
    picked = np.where(is_first, guess[item], again[item])
    bit = (picked == symbol[item]).astype("i1")
    agree = np.where(is_first, np.where(again[item] < 0, 0, np.where(other[item], 2, 1)), 3 + first[item])
    gate = np.where(is_first, RUN_CLASS[seen][item] * 3 + agree, 18 + agree - 3)
    odds = np.stack([
        book.share[picked], np.ones(len(item), "f4"), np.where(is_first, RUN_ODDS[seen][item], 0).astype("f4"),
        OWN_ODDS * np.array([0, 1, -1, 1, 1], "f4")[agree],
    ])
    out = [Bits(_runs(step, owner, n), bit, gate, odds, gate)]

    starts, ways, odds = book.paths[0]
    coded = np.nonzero(~found)[0]
    what, mine = symbol[coded], own[owner[coded]]
    n = starts[what + 1] - starts[what]
    word, back = _expanded(n)
    run = np.arange(len(word))
    way = ways.take(run + (starts[what] + back)[word])
    depth = (run + back[word]).astype("i2")
    b, node = (way & np.int32(1)).astype("i1"), way >> np.int32(1)
    state = book.marked.take((marker[coded] * book.nodes)[word] + node) if len(book.marked) else np.zeros(len(way), "u1")
    if mine.all():
        state, x0 = state + np.int16(256) * (b + np.int16(1)), odds[len(odds) // 2 :].take(way)
    else:
        state = state + np.where(mine, 256, 0).astype("i2").take(word) * (b + np.int16(1))
        x0 = odds.take(way + np.where(mine, len(odds) // 2, 0).astype("i4").take(word))
    state = state.astype("i8")
    gate = (np.int16(FLAG_GATES) + np.minimum(depth >> np.int16(1), np.int16(3)) * np.int16(4) + STATE_LEVEL.take(state)).astype("i8")
    out.append(Bits(_runs(step[coded], owner[coded], n), b, gate, np.stack([x0, STATE_ODDS.take(state)]), _node_context(node, 0)))
    out.append(_spelt_bits(book, t, own))
    return out


def _spelt_bits(book: Book, t: Tokens, own: np.ndarray) -> Bits:
    """The bits of words without a code, whether an escape was guessed or coded."""
    starts, ways, odds = book.paths[1]
    step = steps_of(t)[t.rare]
    order = np.argsort(step * len(own) + t.owner[t.rare], kind="stable")
    lengths, text = t.lengths[order], t.owner[t.rare][order]
    word, back = _expanded(lengths)
    place = np.arange(len(word)) + ((np.cumsum(t.lengths) - t.lengths)[order] + back)[word]
    letters = t.letters[place]
    n = (starts[1:] - starts[:-1])[letters]
    letter, back = _expanded(n)
    way = ways.take(np.arange(len(letter)) + (starts[letters] + back)[letter])
    b, node = (way & np.int32(1)).astype("i1"), way >> np.int32(1)
    less = own[text][word]
    taken = np.where(less, 256, 0).astype("i2").take(letter) * (b + np.int16(1))
    x = [odds.take(way + np.where(less, len(odds) // 2, 0).astype("i4").take(letter))]
    gate = np.full(len(way), FLAG_GATES + WORD_GATES, "i8")
    for i, context in enumerate(byte_contexts(t)):
        state = (book.slot_states(2 + i, _masked(context, book.leaf)[place], letter, node) + taken).astype("i8")
        x.append(STATE_ODDS.take(state))
        gate += STATE_LEVEL.take(state).astype("i8") << (2 * (len(SPANS) - 1 - i))
    each = np.add.reduceat(n, np.cumsum(lengths) - lengths) if len(n) else np.zeros(0, "i8")
    return Bits(_runs(step[order], text, each), b, gate, np.stack(x), _node_context(node, 1))


def _node_context(node: np.ndarray, kind: int) -> np.ndarray:
    return ((node.view("u4") * np.uint32(2) + np.uint32(kind)) * np.uint32(0x9E3779B1) >> np.uint32(22)).astype("i8")


# ---------------------------------------------------------------- mixing
def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def mix(weights: np.ndarray, at: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The mixed log odds; ``weights`` has a row for each input."""
    total = weights[0].take(at) * odds[0]
    for t in range(1, len(odds)):
        total += weights[t].take(at) * odds[t]
    return total


def refined(mixed: np.ndarray, node: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability of a one: the mean of the mixed one and that of the refinement, between its two nearest points."""
    x = (np.clip(mixed, -REACH, REACH - 1e-3) + np.float32(REACH)) * np.float32((POINTS - 1) / (2 * REACH))
    low = x.astype("i4")
    flat, at = table.ravel(), node * POINTS + low
    near = flat.take(at)
    near += (flat.take(at + 1) - near) * (x - low.astype("f4"))
    return (near + squash(mixed)) * np.float32(0.5)


def refinement(counts: np.ndarray) -> np.ndarray:
    """``REFINED x POINTS`` probabilities from ``REFINED x POINTS x 2`` counts; without counts that of the point itself."""
    own = squash(np.linspace(-REACH, REACH, POINTS))
    return ((counts[..., 1] + START * own) / (counts.sum(axis=-1) + START)).astype("f4")


def along_texts(weights: np.ndarray, b: Bits, texts: int) -> np.ndarray:
    """The mixed log odds of bits, where each text adds to the weights what its earlier steps have taught.

    A text has one correction for each input, which starts at nothing; the same steps of all texts are taken together.
    """
    mixed = mix(weights, b.gate, b.odds)
    step, text, n = b.runs
    if not len(step):
        return mixed
    own = np.zeros((len(b.odds), texts), "f4")
    edges = np.concatenate([[0], np.cumsum(n)])
    firsts = np.concatenate([np.nonzero(np.concatenate([[True], step[1:] != step[:-1]]))[0], [len(step)]])
    for i, (lo, hi) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        s, who, size = slice(edges[lo], edges[hi]), text[lo:hi], n[lo:hi]
        x, now = b.odds[:, s], mixed[s]
        if i:
            for k in range(len(x)):
                now += np.repeat(own[k, who], size) * x[k]
        if hi < len(step):
            miss, begin = b.bit[s] - squash(now), edges[lo:hi] - edges[lo]
            for k in range(len(x)):
                own[k, who] += OWN_RATE * np.add.reduceat(miss * x[k], begin) / (np.add.reduceat(x[k] * x[k], begin) + OWN_HOLD)
    return mixed


def start_weights() -> np.ndarray:
    """``INPUTS x GATES``."""
    weights = np.full((INPUTS, GATES), 0.3)
    weights[:, :FLAG_GATES] = np.array([[0.1], [0.0], [1.0], [1.0]])
    weights[:2, FLAG_GATES : FLAG_GATES + WORD_GATES] = np.array([[0.3], [0.7]])
    return weights


# ---------------------------------------------------------------- the passes
def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of a bounded number of characters, with their texts."""
    for batch in batches:
        texts, at = batch.column("text"), 0
        while at < len(texts):
            raw, chars, start = [], 0, at
            while at < len(texts) and chars < SLICE_CHARS:
                text = texts[at].as_buffer() if texts[at].is_valid else b""
                raw.append(bytes(text))
                chars += len(raw[-1]) + 1
                at += 1
            yield batch.slice(start, at - start), raw


def count_words(training: DataFrame) -> DataFrame:
    """``h, c`` of the training texts' words and ends; ``h`` below 256 and negative ones less one count bytes of words and spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        letters, pending, ends = np.zeros(256, "i8"), 0, 0

        def out() -> pa.RecordBatch:
            h, c = _summed(held) if held else (np.zeros(0, "u8"), np.zeros(0, "i8"))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(c), pa.array(np.full(len(h), -1, "i4"))], names=["h", "c", "letter"])

        for _, texts in _slices(batches):
            joined, _, _, h, n = words_in(texts)
            letters += np.bincount(joined, minlength=256)
            codes, distinct = pd.factorize(h)
            held.append((np.append(distinct, END), np.append(np.bincount(codes, minlength=len(distinct)), len(texts)).astype("i8")))
            pending += len(distinct)
            if pending > PENDING // 4:
                yield out()
                pending = 0
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(256, "i8")), pa.array(letters), pa.array(np.arange(256, dtype="i4"))], names=["h", "c", "letter"])

    return training.select("text").mapInArrow(run, "h long, c long, letter int").groupBy("h", "letter").agg(F.sum("c").alias("c"))


def _summed(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, "i8")


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    keys = np.sort(keys)
    edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, "i8")
    return keys[edge], np.diff(np.append(edge, len(keys)))


def fill_tables(training: DataFrame, folder: str, words: int, slots: int = SLOTS) -> None:
    """Write the tables of all training texts: counts of (context, symbol) summed by ranges of contexts."""
    part_bits = min(16, max(4, (words // WORDS_A_PART).bit_length()))
    bucket_bits = min(30, max(part_bits + 1, (words // 4).bit_length()))
    kinds = {0: (("states", "u1"),), 1: (("ends", "u4"), ("entries", "u8"))} | {t: (("slots", "u2"),) for t in range(2, TABLES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(folder, filled=False)
        leaf = u(book.leaf)
        pending: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(TABLES)]

        def out() -> Iterator[pa.RecordBatch]:
            for t in range(TABLES):
                if not pending[t]:
                    continue
                keys, counts = _summed(pending[t])
                pending[t].clear()
                part = (keys >> (leaf if t == 0 else u(64 - part_bits))).astype("i8")
                edges = np.union1d(np.arange(0, len(keys), BLOCK), np.nonzero(np.diff(part))[0] + 1)
                for lo, hi in zip(edges[:-1] if len(edges) and edges[-1] == len(keys) else edges, [*edges[1:], len(keys)], strict=False):
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([part[lo]], pa.int32()), pa.array([keys[lo:hi].tobytes()], pa.binary()), pa.array([counts[lo:hi].astype("u4").tobytes()], pa.binary())], names=["t", "part", "keys", "counts"])

        for _, texts in _slices(batches):
            t = tokens_of(book, texts)
            symbol = np.where(t.symbol < 0, book.escape, t.symbol).astype("u8")
            pending[0].append(_counted(markers_of(book, t).astype("u8") << leaf | symbol))
            pending[1].append(_counted(_masked(pair_contexts(t), book.leaf) | symbol))
            if len(t.letters):
                for i, context in enumerate(byte_contexts(t)):
                    pending[2 + i].append(_counted(_masked(context, book.leaf) | t.letters.astype("u8")))
            if sum(len(k) for p in pending for k, _ in p) > PENDING:
                yield from out()
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(folder, filled=False)
        at, blocks = None, []

        def out() -> pa.RecordBatch:
            keys, counts = _summed(blocks)
            blocks.clear()
            t, part = at
            context, symbol = _masked(keys, book.leaf), (keys & u((1 << book.leaf) - 1)).astype("i8")
            if t == 0:
                whole = np.zeros(len(book.counts), "i8")
                whole[symbol] = counts
                made, size = (states(*way_counts(book.paths[0][:2], whole).T.astype("i8")),), book.nodes
            elif t == 1:
                made = _run_part(context, symbol, counts, part_bits, bucket_bits)
                size = len(made[1])
            else:
                size = slots * len(keys) + 16
                made = (_slot_part(book, context, symbol, counts, size),)
            for (name, d), x in zip(kinds[t], made, strict=True):
                with open(f"{folder}/{t}.{name}.{part}.part", "wb") as f:
                    f.write(x.astype(d).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64())], names=["t", "part", "size"])

        for batch in batches:
            for t, part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at != (t, part):
                    yield out()
                at = (t, part)
                blocks.append((np.frombuffer(keys, "u8"), np.frombuffer(counts, "u4").astype("i8")))
        if blocks:
            yield out()

    blocks = training.select("text").mapInArrow(run, "t int, part int, keys binary, counts binary")
    written = {(r.t, r.part): r.size for r in blocks.repartition(max(int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << part_bits), "t", "part").sortWithinPartitions("t", "part").mapInArrow(add, "t int, part int, size long").collect()}
    nodes = _book(folder, filled=False).nodes
    layout = {"part_bits": part_bits, "bucket_bits": bucket_bits}
    for t in range(TABLES):
        parts = MARKERS + 1 if t == 0 else 1 << part_bits
        layout[f"base{t}"] = np.concatenate([[0], np.cumsum([written.get((t, p), 0) for p in range(parts)])]).astype("i8")
        for name, d in kinds[t]:
            with open(f"{folder}/{t}.{name}", "wb") as whole:
                for p in range(parts):
                    if (t, p) in written:
                        with open(f"{folder}/{t}.{name}.{p}.part", "rb") as f:
                            shutil.copyfileobj(f, whole, 1 << 24)
                        os.remove(f.name)
                    elif name in ("states", "ends"):  # these have entries for what is not there too
                        whole.write(bytes(nodes if t == 0 else 4 << (bucket_bits - part_bits)))
    np.savez(f"{folder}/layout.npz", **layout)


def _run_part(context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, part_bits: int, bucket_bits: int) -> tuple[np.ndarray, ...]:
    """The most frequent follower of each context (ties: the first symbol), with counts up to 15."""
    first = np.nonzero(np.concatenate([[True], context[1:] != context[:-1]]))[0]
    own = np.cumsum(np.concatenate([[True], context[1:] != context[:-1]])) - 1
    most = np.maximum.reduceat(counts, first)
    tops = np.nonzero(counts == most[own])[0]
    top = tops[np.searchsorted(own[tops], np.arange(len(first)))]
    others = np.add.reduceat(counts, first) - most
    bucket = (context[first] >> u(64 - bucket_bits)).astype("i8") & ((1 << (bucket_bits - part_bits)) - 1)
    ends = np.cumsum(np.bincount(bucket, minlength=1 << (bucket_bits - part_bits)))
    entries = (context[first] >> u(48 - bucket_bits) & u(0xFFFF)) << u(48) | symbol[top].astype("u8") << u(8) | (np.minimum(most, 15) * 16 + np.minimum(others, 15)).astype("u8")
    return ends, entries


def _slot_part(book: Book, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Slots of check and state for the nodes of each context's symbols; where two meet, the one seen more stays."""
    starts, ways = book.paths[1][:2]
    n = starts[symbol + 1] - starts[symbol]
    who = np.repeat(np.arange(len(symbol)), n)
    way = ways[np.arange(len(who)) + np.repeat(starts[symbol] - (np.cumsum(n) - n), n)]
    h, code = _slot_hash(context[who], way >> 1), way & 1
    order = np.argsort(h)
    h, code, c = h[order], code[order], counts[who][order]
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    ones = np.add.reduceat(c * code, first)
    total = np.add.reduceat(c, first)
    h = h[first]
    slot = (h >> u(40)).astype("i8") * size >> 24
    out, turn = np.zeros(size, "u2"), np.argsort(total, kind="stable")  # the last one written stays
    out[slot[turn]] = ((h >> u(32)).astype("u1").astype("u2") << 8 | states(total - ones, ones).astype("u2"))[turn]
    return out


def lessons(training: DataFrame, folder: str) -> DataFrame:
    """``i, w, n``: each task's weights, times the bits that their gate has learned from, and those bits.

    Negative ``i`` are the refinement's counts, w of ones among n bits, of cell -1 - i.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, weights, used = _book(folder), start_weights().astype("f4"), np.zeros(GATES)
        cells, squares, turn = np.zeros(2 * REFINED * POINTS, "i8"), np.ones((INPUTS, GATES)), 0
        for _, texts in _slices(batches):
            for b in bits_of(book, tokens_of(book, texts), np.ones(len(texts), bool)):
                points = np.empty(len(b.bit), "i8")
                for lo in range(0, len(b.bit), GROUP):
                    s = slice(lo, lo + GROUP)
                    x, g = b.odds[:, s], b.gate[s]
                    mixed = mix(weights, g, x)
                    points[s] = (np.clip(mixed, -REACH, REACH) + np.float32(REACH)) * np.float32((POINTS - 1) / (2 * REACH)) + np.float32(0.5)
                    miss, n = b.bit[s] - squash(mixed), np.bincount(g, minlength=GATES)
                    for t in range(len(x)):
                        if turn % 8 == 0:  # what scales the steps is measured on every eighth group, the steps are taken on all
                            squares[t] = (squares[t] + np.bincount(g, weights=x[t] * x[t], minlength=GATES) / np.maximum(n, 1)) / 2
                        weights[t] += RATE * np.bincount(g, weights=miss * x[t], minlength=GATES) / (n * (1 + squares[t]) + 10.0)
                    used += n
                    turn += 1
                cells += np.bincount((b.node * POINTS + points) * 2 + b.bit, minlength=len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES * INPUTS, dtype="i4")), pa.array((weights * used).astype("f8").ravel()), pa.array(np.tile(used, INPUTS))], names=["i", "w", "n"])
        pairs = cells.reshape(-1, 2)
        some = np.nonzero(pairs.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array((-1 - some).astype("i4")), pa.array(pairs[some, 1].astype("f8")), pa.array(pairs[some].sum(axis=1).astype("f8"))], names=["i", "w", "n"])

    return training.select("text").mapInArrow(run, "i int, w double, n double")


def teach(training: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The gates' weights, averaged over tasks by the bits that each has learned from, and the refinement."""
    sums = lessons(training, folder).groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    out, cells = start_weights().ravel(), np.zeros((REFINED * POINTS, 2))
    for r in sums:
        if r.i < 0:
            cells[-1 - r.i] = r.n - r.w, r.w
        elif r.n:
            out[r.i] = r.w / r.n
    # sums of tasks in another order give the same weights
    return np.round(out, 5).reshape(INPUTS, GATES).astype("f4"), refinement(cells.reshape(REFINED, POINTS, 2))


def learn(training: DataFrame, slots: int = SLOTS) -> tuple[str, str, np.ndarray, np.ndarray, int, int]:
    """Of the texts: the folder of words' hashes and counts, the folder of the code and the tables, weights, refinement, words, distinct ones."""
    spark = training.sparkSession
    folder = f"{checkpoint_dir(spark)}/words-{uuid.uuid4().hex}"
    count_words(training).write.parquet(folder)
    read = spark.read.parquet(folder)
    letters = np.zeros(256, "i8")
    for r in read.where("letter >= 0").collect():
        letters[r.letter] = r.c
    counts = read.where("letter < 0").select("h", "c")
    end = int(END.astype("i8"))
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == end, F.col("c"))).alias("ends")).first()
    n, v, ends = whole.n or 0, whole.v if whole.n else 0, whole.ends or 0
    top = counts.where(F.col("h") != end).orderBy(F.col("c").desc(), "h").limit(max(VOCABULARY, int(WORDS_A_POWER * n**GROWTH))).toArrow()
    hashes, frequent = top.column("h").to_numpy().astype("i8").view("u8"), top.column("c").to_numpy().astype("i8")
    book_folder = f"{checkpoint_dir(spark).removeprefix('file:')}/mixing-{uuid.uuid4().hex}"
    os.makedirs(book_folder)
    make_code(book_folder, hashes, frequent, ends, max(1, n - ends - int(frequent.sum())), letters)
    fill_tables(training, book_folder, n, slots)
    return folder, book_folder, *teach(training, book_folder), n, v


def costs(book: Book, t: Tokens, own: np.ndarray, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The cost of each text in nats."""
    total = np.zeros(len(own))
    for b in bits_of(book, t, own):
        p = refined(along_texts(weights, b, len(own)), b.node, table)
        cost = np.log(np.abs(1 - b.bit - p))
        if len(cost):
            total -= np.bincount(b.runs[1], weights=np.add.reduceat(cost, np.cumsum(b.runs[2]) - b.runs[2], dtype="f8"), minlength=len(own))
    return total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row."""
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    words_folder, book_folder, weights, table, n, v = learn(own.where(~F.col("held_out")))
    least = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        book = _book(book_folder)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch, texts in _slices(batches):
            t, size = tokens_of(book, texts), len(texts)
            total = costs(book, t, ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), weights, table)
            c = np.where(t.symbol >= 0, book.counts[t.symbol], 0)
            sure = np.bincount(t.owner, weights=c > 0, minlength=size).astype("i8")
            base = np.bincount(t.owner, weights=np.where(t.symbol >= 0, np.log10(c + 1.0) - least, -least), minlength=size)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(t.rare, np.append(np.cumsum(t.sizes) - t.sizes, len(t.owner))).astype("i4")), pa.array(t.hash[t.rare].view("i8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + size)), batch.column("id"), batch.column("held_out"), pa.array(t.sizes), pa.array(sure), pa.array(base), pa.array(-total / np.log(10)), pa.array([max(1, len(x)) for x in texts], pa.int64()), lists],
                names=["row", "id", "held_out", "n_tokens", "sure", "base", "score", "size", "rare"],
            )
            row += size

    kind = docs.schema[id_col].dataType.simpleString()
    scored = cut(own.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, sure long, base double, score double, size long, rare array<long>"))
    delete_folder(spark, book_folder)
    rows = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    counts = spark.read.parquet(words_folder).where("letter < 0").select("h", "c")
    known = rows.join(counts, "h").groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = scored.drop("rare").join(cut(known), "row", "left")
    delete_folder(spark, words_folder)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("sure") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
